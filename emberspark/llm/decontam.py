"""Benchmark decontamination: one Aho-Corasick automaton over the test items.

Every window of ``n`` consecutive normalised words of an item is a pattern (a
shorter item is one window).  A document is normalised once, scanned once, and
the word positions that the hits cover are mapped back to the original text.

The test set is small beside the corpus; its windows are dealt into slices of at
most ``slice_bytes`` of pattern text, one automaton each, so what a task holds is
bounded whatever the size of the test set.  Normally there is one slice.

Defined cases: a null or empty text has no words and no hit; an item without
words has no window; the words of an item without id are hit, but it is no item of a document; repeated items each count; several documents with one id
give one row each; an empty table on either side gives no hits; other columns of
documents are kept, those named like the added ones replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import TEXT, add_columns, small, table, utf8, with_bytes

WINDOW = 10
SLICE_BYTES = 32 << 20
# Lower-cases A-Z and turns every ASCII byte that is not a letter or digit into a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def item_windows(text: bytes, n: int) -> list[bytes]:
    """The distinct patterns of one item: words between single blanks, blanks at both ends."""
    words = text.translate(NORMAL).split()
    if not words:
        return []
    return list({b" " + b" ".join(words[i:i + n]) + b" " for i in range(max(1, len(words) - n + 1))})


def build_automaton(patterns: dict[bytes, list]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for key, items in patterns.items():
        auto.add_word(key.decode("latin-1"), (key.count(b" ") - 1, tuple(items)))
    auto.make_automaton()
    return auto


def scan(words: list[bytes], auto) -> tuple[np.ndarray, set]:
    """Which words lie in an occurrence of a pattern, and the items with occurrences."""
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    items: set = set()
    line = b" " + b" ".join(words) + b" "
    found = list(auto.iter(line.decode("latin-1"))) if len(auto) else []
    if found:
        # blank k of the line stands before word k, so the blank that ends a match counts its words
        blank = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        ends = np.searchsorted(blank, [end for end, _ in found])
        for last, (_, (length, ids)) in zip(ends, found):
            hit[last - length] += 1
            hit[last] -= 1
            items.update(ids)
    return np.cumsum(hit)[:-1] > 0, items


def hit_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans (end exclusive) of the original text for each run of hit words."""
    spans: list[tuple[int, int]] = []
    before = False
    for m, h in zip(WORD.finditer(text), hit):
        if h:
            spans.append((spans.pop()[0] if before else m.start(), m.end()))
        before = bool(h)
    lead = np.cumsum([0] + [(b & 0xC0) != 0x80 for b in text])
    return [(int(lead[a]), int(lead[b])) for a, b in spans]


def _slices(benchmark: DataFrame, item_id: str, text: str, n: int, slice_bytes: int) -> list[DataFrame]:
    """The item texts in parts whose patterns take at most about ``slice_bytes``."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), utf8(text).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size * (n + 1) / slice_bytes))
    if parts == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with ``n_words, n_hit, item_ids, spans``.

    ``item_ids`` are the items with an occurring window (as text, sorted),
    ``spans`` the code-point ranges of the original text that are hit.
    """
    spark = docs.sparkSession
    added = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"
    frame, schema = with_bytes(docs, text, keep, added)
    autos = []
    for part in _slices(benchmark, item_id, item_text, n, slice_bytes):
        patterns: dict[bytes, list] = {}
        for row in part.toLocalIterator():
            for key in item_windows(bytes(row.text), n):
                patterns.setdefault(key, []).extend([] if row.item is None else [row.item])
        autos.append(spark.sparkContext.broadcast(patterns))

    def run(batches):
        # automata are built one slice at a time; a batch is scanned against each
        one = build_automaton(autos[0].value) if len(autos) == 1 else None
        for b in small(batches):
            texts = b.column(TEXT).to_pylist()
            words = [t.translate(NORMAL).split() for t in texts]
            hits = [np.zeros(len(w), bool) for w in words]
            items: list[set] = [set() for _ in words]
            for a in autos:
                auto = one or build_automaton(a.value)
                for i, w in enumerate(words):
                    h, s = scan(w, auto)
                    hits[i] |= h
                    items[i] |= s
            yield add_columns(
                b, [pa.array([len(w) for w in words], pa.int64()),
                 pa.array([int(h.sum()) for h in hits], pa.int64()),
                 pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                 pa.array([[{"start": x, "end": y} for x, y in hit_spans(t, h)] if h.any() else []
                           for t, h in zip(texts, hits)],
                          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["n_words", "n_hit", "item_ids", "spans"])

    return frame.mapInArrow(run, schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against every benchmark item."""
    found = decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"),
                          table(spark, sf_dir, "benchmark", "item_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


# Words, windows and hits in SQL: windows are joined on their text, then hit words are counted once.
SQL = {"op10_decontaminate": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS key
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS key
    FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw USING (k, key)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""}
