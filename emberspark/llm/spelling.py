"""Spelling variants: words that differ by one edit, by dense prefix-suffix tiling.

Two words are near if the lengths of their common prefix and common suffix together reach the
longer length minus one: then one inserted, deleted or replaced code point separates them.
Words lie in padded matrices of code points, left-aligned for prefixes and right-aligned for
suffixes, and blocks of words are compared with blocks, all pairs of a tile at a time.

Which words meet in a tile: for the longer length m of a pair the possible places of the edit
are cut into ``RANGES`` ranges.  An edit within places lo..hi leaves the first lo and the last
m - 1 - hi code points as they are, so each word is keyed by these for every range, for m its
own length (as the longer word) and its length plus one (as the shorter).  A pair is taken
from the range that holds its common prefix's length and from no other, so it is found once.
A key of more than ``SPLIT`` words is split by single places: words that agree in all but one
place are at most as many as there are different code points, and one.  So no group in a task
grows with the vocabulary, and no pair is given up.

Defined cases: a null text has no words; a null document id counts as an empty one; of forms
with equal counts the smallest word in code-point order is taken; chains of forms end, since
every step is to a word at least ``ratio`` times as frequent (``ratio`` above 1); an empty
table has no words; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import cut, gathered, table

RANGES = 4
SPLIT = 4096
BLOCKS = (4, 16, 64)
#: Rows of a chunk in a task, and pairs of a tensor.
ROWS, PAIRS = 1 << 17, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, min_chars: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """``word, n``: runs of letters, lower-cased, one code point deleted where ``every`` divides the run's hash.

    Shorter runs than ``min_chars`` can give no word, as a deletion only shortens.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    deleted = F.expr("concat(left(run, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % every == 0, deleted).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def _keyed(words: DataFrame) -> DataFrame:
    """``m, lo, hi, key, word, n``: every word under each range of places, as the longer and as the shorter of a pair."""
    size = F.length("word")
    places = [F.struct((size + more).alias("m"), F.floor((size + more) * r / RANGES).cast("int").alias("lo"),
                       (F.floor((size + more) * (r + 1) / RANGES) - 1).cast("int").alias("hi"))
              for more in (0, 1) for r in range(RANGES)]
    rows = words.select("word", "n", F.explode(F.array(*places)).alias("p")).select("word", "n", "p.*").where("lo <= hi")
    return rows.withColumn("key", _key())


def _key():
    return F.expr("xxhash64(m, lo, hi, left(word, lo), right(word, m - 1 - hi))")


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """Keys of more than ``limit`` words by single places instead of their range."""
    hot = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > limit).select("key", F.lit(True).alias("hot"))
    rows = rows.join(hot, "key", "left")
    at = F.explode(F.when(F.col("hot"), F.sequence("lo", "hi")).otherwise(F.array(F.lit(-1)))).alias("at")
    rows = rows.select("word", "n", "m", "lo", "hi", "key", at)
    rows = rows.withColumns({"lo": F.when(F.col("at") < 0, F.col("lo")).otherwise(F.col("at")),
                             "hi": F.when(F.col("at") < 0, F.col("hi")).otherwise(F.col("at"))})
    return rows.select("m", F.when(F.col("at") < 0, F.col("key")).otherwise(_key()).alias("key"), "lo", "hi", "word", "n")


def _matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points left- and right-aligned, one row a place, and the words' lengths."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(np.uint8 if not len(points) or points.max() < 256 else np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    left, right = np.zeros((width, len(words)), points.dtype), np.zeros((width, len(words)), points.dtype)
    left[place, row] = points
    right[np.repeat(size, size) - 1 - place, row] = points
    return left, right, size


def _common(points: np.ndarray, a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of all pairs of a tile that are alive; a and b hold row numbers by block."""
    length = np.zeros(alive.shape, np.int32)
    alive = alive.copy()
    for column in points:
        alive &= column[a][:, :, None] == column[b][:, None, :]
        if not alive.any():
            break
        length += alive
    return length


def _tiles(start: np.ndarray, size: np.ndarray):
    """Pairs of blocks (row numbers, -1 beyond the end) that cover all pairs of each group's rows."""
    for k, width in enumerate(BLOCKS):
        mine = (size > (BLOCKS[k - 1] if k else 1)) & ((size <= width) | (k == len(BLOCKS) - 1))
        a, b = [], []
        for lo, n in zip(start[mine].tolist(), size[mine].tolist()):
            firsts = range(lo, lo + n, width)
            for i, x in enumerate(firsts):
                for y in firsts[i:]:
                    a.append((x, lo + n))
                    b.append((y, lo + n))
        step = max(1, PAIRS // width ** 2)
        for at in range(0, len(a), step):
            yield tuple(np.where((rows := np.array(side)[:, :1] + np.arange(width)) < np.array(side)[:, 1:], rows, -1)
                        for side in (a[at:at + step], b[at:at + step]))


def _near(t: pa.Table):
    """Row numbers of the near pairs of a chunk of whole groups, sorted by m and key."""
    m, key = t.column("m").to_numpy(), t.column("key").to_numpy()
    edges = np.flatnonzero((key[1:] != key[:-1]) | (m[1:] != m[:-1])) + 1
    start = np.concatenate([[0], edges])
    size = np.diff(np.concatenate([start, [len(key)]]))
    of = np.repeat(np.arange(len(size)), size)
    keep = size[of] > 1
    if not keep.any():
        return
    rows = np.flatnonzero(keep)
    words = t.column("word").take(rows).to_pylist()
    m, lo, hi = m[rows], t.column("lo").to_numpy()[rows], t.column("hi").to_numpy()[rows]
    left, right, length = _matrices(words, int(m.max()))
    size = size[size > 1]
    for a, b in _tiles(np.cumsum(size) - size, size):
        longest = np.maximum(length[a][:, :, None], length[b][:, None, :])
        alive = (a[:, :, None] >= 0) & (a[:, :, None] < b[:, None, :]) & (longest == m[a][:, :, None])
        prefix = _common(left, a, b, alive)
        alive &= (lo[a][:, :, None] <= prefix) & (prefix <= hi[a][:, :, None])
        near = alive & (prefix + _common(right, a, b, alive) >= longest - 1)
        tile, i, j = np.nonzero(near)
        if len(tile):
            yield rows[a[tile, i]], rows[b[tile, j]]


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """``word, other, other_n``: both directions of every pair of words one edit apart; ``words`` has distinct ``word`` and ``n``."""

    def chunk(t: pa.Table):
        for x, y in _near(t):
            one, two = np.concatenate([x, y]), np.concatenate([y, x])
            yield pa.RecordBatch.from_arrays(
                [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                 for c in (t.column("word").take(one), t.column("word").take(two), t.column("n").take(two))],
                names=["word", "other", "other_n"])

    def run(batches):
        held, count = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            count += b.num_rows
            if count < ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            last = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1
            if last:
                yield from chunk(t.slice(0, last).combine_chunks())
                held, count = t.slice(last).to_batches(), t.num_rows - last
        if held:
            yield from chunk(pa.Table.from_batches(held).combine_chunks())

    rows = _split(_keyed(words), split)
    return gathered(rows, ["m", "key"]).mapInArrow(run, "word string, other string, other_n long")


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root``: the end of the chain of forms from each word that has one, by doubling."""
    roots = cut(forms)
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = cut(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")))
    return roots


def spelling_variants(words: DataFrame, ratio: int = 10, split: int = SPLIT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    ``form`` is the most frequent near word, if ``ratio`` times as frequent as the word; ``root`` the last of the chain of forms.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, split).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(
        -F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("n"))).alias("f"))
    found = cut(found.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 1
    forms = found.where("form is not null").select("word", F.col("form").alias("root"))
    roots = _roots(forms, math.floor(math.log(most, ratio)) + 1)
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of all documents."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents", "doc_id", "text")))


# Near words by their deletions: equal with the same place left out, or one word is the other with a place left out.
SQL = {"op13_spelling": """
WITH RECURSIVE bits AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM range(256) r(i))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
      lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [192 | (unicode(s) >> 6), 128 | (unicode(s) & 63)] END))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM r, bits WHERE length(run) >= 7),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0
      THEN left(run, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS MATERIALIZED (SELECT word, i, left(word, i) || substring(word, i + 2) AS cut FROM (SELECT word, CAST(unnest(range(length(word))) AS INT) AS i FROM w)),
e AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS other FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.cut = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.cut = w.word),
g AS MATERIALIZED (SELECT e.word, count(*) AS n_near, arg_min(struct_pack(o := e.other, n := w.n), struct_pack(a := -w.n, b := e.other)) AS best
  FROM e JOIN w ON w.word = e.other GROUP BY e.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN best.o END AS form,
  CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM w LEFT JOIN g USING (word)),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT c.word, c.root FROM c JOIN f x ON x.word = c.root WHERE x.form IS NULL) USING (word)
"""}
