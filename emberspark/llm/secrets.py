"""Secret scan in DataFrame functions alone.

Three patterns give the base spans: an assignment to a secret's name, an access key
and a long run of hex digits.  The entropy method adds spans: every run of at least
``WINDOW`` token characters is a candidate; a window slides over it, the count of each
character is kept up to date with the one that enters and the one that leaves, and so
is sum(c * log2 c), from which the window's Shannon entropy follows without a recount.
Windows at or above the threshold of the candidate's character class (hex digits, or
base-64 characters) are joined into spans.

The allow list suppresses a candidate that it explains from end to end (a UUID, a digest of
a web page).  It suppresses a span, looked at together with the rest of the parts between
``/ _ -`` in which it begins and ends, if that has no letter, looks like words, or bears a mark of a
made-up value; a folder's name such as ``samples/`` marks nothing but itself.  Like words are
spans without digits whose case changes at most once in four letters, with a vowel in five letters
or more and no seven lower-case consonants in a row.

Positions come from the texts between the matches, so a text is split by each pattern
once; nothing is shuffled.  Running sums are kept in parts of ``PART`` elements, which
keeps them linear for texts with very many matches.

Defined cases: a null or empty text has no spans; repeated rows are scanned alike; an
empty table gives no rows; input columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import table

NAMES = ("password", "passwd", "secret", "token", "api_?key")


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # 18 characters and more
HEX = "[0-9a-f]{16,}"
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_-]{%d,}" % WINDOW
#: class -> alphabet and least entropy of a window in bits
CLASSES = {"entropy_hex": ("0123456789abcdef", 3.05),
           "entropy_base64": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-", 3.72)}
KINDS = ["assign", "access", "hex", *CLASSES]
#: Candidates that one of these explains from end to end are not secrets.
ALLOW = (
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUIDs
    "^(sha256-[A-Za-z0-9+/_-]{43}|sha384-[A-Za-z0-9+/_-]{64}|sha512-[A-Za-z0-9+/_-]{86})$",  # integrity digests of web pages
)
#: Marks of made-up values of manuals; as a part of its own (a folder's name) one explains only itself.
MADE_UP = "(?i)(example|sample|dummy|placeholder|changeme)"
FOLDER = "(?i)(^|[/_-])(examples?|samples?|dummy|placeholders?|changeme)(?=$|[/_-])"
PART = 256
SPANS = "array<struct<start:int,end:int,ord:int>>"


def _running(values: Column, step) -> Column:
    """Array of ``step(position, value)`` structs; its field ``next`` is the following position."""
    kept = "array<struct<start:int,end:int,at:int,next:int>>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{kept}>").alias("done"), F.array().cast(kept).alias("last"))

    def add(acc, v):
        one = step(acc["pos"], v)
        full = F.size(acc["last"]) >= PART
        return F.struct(one["next"].alias("pos"),
                        F.when(full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"]).alias("done"),
                        F.when(full, F.array(one)).otherwise(F.concat(acc["last"], F.array(one))).alias("last"))

    return F.aggregate(values, zero, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]))))


def matches(text: Column, pattern: str, found: Column) -> Column:
    """start, end and number of each match, in code points; ``found`` are the matched strings."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("size"),
                         F.sequence(F.lit(0), F.size(found) - 1).alias("at"))
    steps = F.slice(sizes, F.lit(1), F.size(found))

    def step(pos, v):
        start = pos + v["gap"]
        return F.struct(start.alias("start"), (start + v["size"]).alias("end"), v["at"].alias("at"), (start + v["size"]).alias("next"))

    return F.when(F.size(found) > 0, _running(steps, step))


def entropy_spans(s: Column, alphabet: str, least: float, window: int = WINDOW) -> Column:
    """Joined windows of ``s`` whose entropy reaches ``least``, as (start, end) within it."""
    clog = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    pair = "array<struct<start:int,end:int>>"
    # each step: the code that enters, the code that leaves (-1 at first), and the number of codes so far
    moves = F.transform(codes, lambda k, i: F.struct(
        k.alias("new"), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1)).alias("old"), (i + 1).alias("n")))
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"),
                    F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(pair).alias("done"))

    def slide(acc, m):
        up = F.get(acc["counts"], m["new"])
        down = F.get(acc["counts"], m["old"])
        total = F.when(m["old"] == m["new"], acc["total"]).otherwise(
            acc["total"] + F.get(clog, up + 1) - F.get(clog, up)
            + F.when(m["old"] >= 0, F.get(clog, down - 1) - F.get(clog, down)).otherwise(F.lit(0.0)))
        counts = F.when(m["old"] == m["new"], acc["counts"]).otherwise(F.transform(
            acc["counts"], lambda c, j: c + (j == m["new"]).cast("int") - (j == m["old"]).cast("int")))
        hit = (m["n"] >= window) & (F.lit(math.log2(window)) - total / window >= least)
        fresh = hit & (m["n"] - window > acc["end"])
        return F.struct(
            counts.alias("counts"), total.alias("total"),
            F.when(fresh, m["n"] - window).otherwise(acc["start"]).alias("start"),
            F.when(hit, m["n"]).otherwise(acc["end"]).alias("end"),
            F.when(fresh & (acc["start"] >= 0), F.concat(acc["done"], F.array(
                F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["done"]).alias("done"))

    def last(acc):
        return F.when(acc["start"] >= 0, F.concat(acc["done"], F.array(
            F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["done"])

    return F.aggregate(moves, zero, slide, last)


def _explained(part: Column) -> Column:
    """Whether a span with the parts around it is a number, words or a made-up value."""

    def without(pattern):
        return F.length(F.regexp_replace(part, pattern, ""))

    letters, vowels = without("[^A-Za-z]"), without("[^AEIOUYaeiouy]")
    turns = F.length(part) - without("(?<=[a-z])[A-Z]|(?<=[A-Z][A-Z])[a-z]")
    words = (~part.rlike("[0-9]") & (turns * 4 <= letters) & (vowels * 5 >= letters)
             & ~part.rlike("[bcdfghjklmnpqrstvwxz]{7}"))
    return ~part.rlike("[A-Za-z]") | words | F.regexp_replace(part, FOLDER, "$1").rlike(MADE_UP)


def _candidate_spans(found: Column, at: Column, allow: tuple[str, ...], window: int) -> Column:
    """Spans of one candidate, in positions of the text."""
    s = F.get(found, at["at"])
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | s.rlike(pattern)
    is_hex = s.rlike("^[0-9A-Fa-f]+$")
    out = F.array().cast(SPANS)

    def part(x):
        before, after = F.substring(s, F.lit(1), x["start"]), F.substring(s, x["end"] + 1, F.length(s))
        return F.concat(F.regexp_extract(before, "[^/_-]*$", 0), F.substring(s, x["start"] + 1, x["end"] - x["start"]),
                        F.regexp_extract(after, "^[^/_-]*", 0))

    def moved(name, folded):
        alphabet, least = CLASSES[name]
        spans = F.filter(entropy_spans(folded, alphabet, least, window), lambda x: ~_explained(part(x)))
        return F.transform(spans, lambda x: F.struct(
            (at["start"] + x["start"]).alias("start"), (at["start"] + x["end"]).alias("end"),
            F.lit(KINDS.index(name)).alias("ord")))

    return F.when(allowed, out).when(is_hex, moved("entropy_hex", F.lower(s))).otherwise(moved("entropy_base64", s))


def _base_spans(at: Column, kind: str) -> Column:
    return F.transform(at, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                              F.lit(KINDS.index(kind)).alias("ord")))


def scan(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans`` (all): (start, end, ord), ordered by start, then kind.

    ``ord`` is the number of the kind in ``KINDS``; positions are code points, ends exclusive.
    """
    none = F.array().cast(SPANS)
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    at = {k: f"__{k} positions of scan" for k in patterns}
    found = {k: f"__{k} of scan" for k in patterns}
    added = [*at.values(), *found.values()]
    df = docs.drop("base_spans", "secret_spans", *added)
    df = df.withColumns({found[k]: F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(0))
                         for k, p in patterns.items()})
    df = df.withColumns({at[k]: matches(F.col(text), p, F.col(found[k])) for k, p in patterns.items()})
    secret = F.filter(F.col(at["assign"]), lambda x: F.length(
        F.regexp_extract(F.get(F.col(found["assign"]), x["at"]), ASSIGN, 2)) >= ASSIGN_LEAST)
    kept = {"assign": secret, "access": F.col(at["access"]), "hex": F.col(at["hex"])}
    df = df.withColumn("base_spans", F.array_sort(F.concat(*[
        F.coalesce(_base_spans(x, k), none) for k, x in kept.items()]), _by_start))
    more = F.flatten(F.transform(F.col(at["candidate"]), lambda x: _candidate_spans(F.col(found["candidate"]), x, allow, WINDOW)))
    df = df.withColumn("secret_spans", F.when(F.size(F.col(found["candidate"])) > 0, F.array_sort(
        F.concat("base_spans", F.coalesce(more, none)), _by_start)).otherwise(F.col("base_spans")))
    return df.drop(*added)


def _by_start(a: Column, b: Column) -> Column:
    x, y = F.struct(a["start"], a["ord"], a["end"]), F.struct(b["start"], b["ord"], b["end"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["ord"]), x["start"], x["end"])), ",")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The text with every span of ``secret_spans`` replaced by ``mark`` (overlapping spans by one)."""
    body = F.col(text)
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))

    def take(acc, x):
        apart = (x["start"] >= acc["pos"]) | (F.size(acc["parts"]) == 0)
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(apart, F.concat(acc["parts"], F.array(
            F.substring(body, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit(mark)))).otherwise(acc["parts"]).alias("parts"))

    whole = F.aggregate("secret_spans", zero, take, lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring(body, acc["pos"] + 1, F.length(body))))
    return scanned.withColumn(text, F.when(F.size("secret_spans") > 0, whole).otherwise(body))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    ords = F.transform("base_spans", lambda x: x["ord"])
    count = [(F.size(ords) - F.size(F.array_remove(ords, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *count, F.sha2(as_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
                        as_text(F.col("secret_spans")).alias("spans"))


SQL: dict[str, str] = {}
