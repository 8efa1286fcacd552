"""SimHash near-duplicates by the general pigeonhole principle with unequal thresholds.

A fingerprint's 64 bits are grouped into parts, correlated bits together.  If thresholds
t_1..t_m of the parts add up to tau - m + 1, then two fingerprints that differ in at most tau
bits differ in at most t_i bits in some part i (a threshold of -1 leaves its part out).  Every
fingerprint chooses its own thresholds by dynamic programming over the parts, for the least
estimated cost: the values it probes in a part (all within t_i bits of its own) and the
candidates it meets there.  A part in which it has many neighbours it leaves out or keeps
narrow, and widens a rarer one.  Estimates come from a bounded sample of ``SAMPLE``
fingerprints, scaled to their number; so do the grouping of bits and the number of parts (the
one with the least estimated cost).  The sample steers cost only: any choice finds every link.

Each fingerprint is a member of the bucket of its value in every part and probes the buckets
it chose.  A bucket compares probes with members in its task and gives a spanning forest of
the links that it verified on all 64 bits; unverified pairs leave no task.  Buckets of more
than ``LIMIT`` rows are dealt into blocks, and every pair of blocks is a task's work of its own.
Classes are connected components of the forests; equal fingerprints are one node throughout.

Defined cases: texts without words (or null) have fingerprint zero and are linked like any
other; documents with one id are one node, and join the classes of all their fingerprints; a
null id is in class null and links nothing; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import LOWER, cut, gathered, small, table, utf8
from emberspark.llm.components import components

BITS, TAU = 64, 2
SAMPLE = 2048
PARTS = (1, 2, 3)
#: Cost of a probed value against that of a compared candidate.
PROBE = 200.0
LIMIT = 1 << 14
#: Words of a text handled at a time, and rows of a task's chunk.
WORDS, ROWS = 1 << 18, 1 << 18


def fingerprint(text: bytes, k: int = 3, seed: int = 42) -> int:
    """64 bits, each set where more than half of the hashes of all k-word shingles have it set."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    k = min(k, len(words))
    total, count = len(words) - k + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, WORDS):
        part = words[at:at + WORDS + k - 1]
        flat = b" ".join(part)
        size = np.fromiter(map(len, part), np.int64, len(part))
        start = np.cumsum(size + 1) - size - 1
        ends = (start + size)[k - 1:].tolist()
        view, digest = memoryview(flat), xxhash.xxh64_intdigest
        h = np.array([digest(view[a:b], seed) for a, b in zip(start.tolist(), ends)], np.uint64)
        count += _bit_counts(h)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    out = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, k: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in small(batches, "text"):
            fp = np.array([fingerprint(t, k) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[np.ndarray]:
    """Masks of ``parts`` groups of bits: each starts with the free bit of most correlation and takes those closest to it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits ** 2).sum(axis=0))
    alike = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(alike, 0)
    free, out = list(range(BITS)), []
    for p in range(parts):
        size = len(free) if p == parts - 1 else round(len(free) / (parts - p))
        group = [free.pop(int(alike[np.ix_(free, free)].sum(axis=1).argmax()))]
        while len(group) < size:
            group.append(free.pop(int(alike[np.ix_(free, group)].sum(axis=1).argmax())))
        out.append(np.bitwise_or.reduce(np.uint64(1) << np.array(sorted(group), np.uint64)))
    return out


def _flips(mask: np.uint64, t: int) -> np.ndarray:
    """All ways to change exactly 1..t bits of a part."""
    bits = [np.uint64(1) << np.uint64(i) for i in range(BITS) if int(mask) >> i & 1]
    return np.array([np.bitwise_or.reduce(np.array(c)) for n in range(1, t + 1) for c in combinations(bits, n)], np.uint64)


def thresholds(fp: np.ndarray, masks: list[np.ndarray], sample: np.ndarray, scale: float, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint's thresholds by part, adding up to tau - m + 1, and their estimated cost."""
    m, levels = len(masks), tau + 2  # -1..tau
    values = [sum(_choose(int(mask).bit_count(), n) for n in range(t + 1)) for mask in masks for t in range(tau + 1)]
    cost = np.zeros((m, levels, len(fp)))
    for i, mask in enumerate(masks):
        for at in range(0, len(fp), 512):
            apart = np.bitwise_count((fp[at:at + 512, None] ^ sample[None, :]) & mask)
            for t in range(tau + 1):
                cost[i, t + 1, at:at + 512] = (apart <= t).sum(axis=1) * scale
        for t in range(tau + 1):
            cost[i, t + 1] += PROBE * values[i * (tau + 1) + t]
    # best[s]: least cost of the parts so far with thresholds of sum s - (parts so far)
    top = tau + 1
    best, chosen = np.full((top + 1, len(fp)), np.inf), []
    best[0] = 0
    for i in range(m):
        options = np.full((levels, top + 1, len(fp)), np.inf)
        for level in range(levels):
            options[level, level:] = best[:top + 1 - level] + cost[i, level]
        chosen.append(options.argmin(axis=0))
        best = options.min(axis=0)
    out, s, every = np.zeros((len(fp), m), np.int64), np.full(len(fp), top), np.arange(len(fp))
    for i in range(m - 1, -1, -1):
        level = chosen[i][s, every]
        out[:, i] = level - 1
        s = s - level
    return out, best[top]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def plan(sample: np.ndarray, total: int, tau: int = TAU) -> tuple[list[np.ndarray], float]:
    """Masks of the parts that cost the sample least, and how many fingerprints a sampled one stands for."""
    scale = total / max(1, len(sample))
    found = []
    for parts in PARTS:
        masks = group_bits(sample, parts)
        found.append((thresholds(sample, masks, sample, scale, tau)[1].sum() + PROBE * parts * len(sample), masks))
    return min(found, key=lambda x: x[0])[1], scale


def _entries(prints: DataFrame, masks: list[np.ndarray], sample: np.ndarray, scale: float, tau: int) -> DataFrame:
    """``part, value, fp, probe, member``: what each fingerprint puts into buckets."""

    def run(batches):
        flips = [[_flips(mask, t) for t in range(tau + 1)] for mask in masks]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fp = b.column("fp").slice(at, 4096).to_numpy().view(np.uint64)
                chosen, _ = thresholds(fp, masks, sample, scale, tau)
                for i, mask in enumerate(masks):
                    t = chosen[:, i]
                    yield _rows(i, fp & mask, fp, t >= 0, True)
                    for level in range(1, tau + 1):
                        own = fp[t == level]
                        for lo in range(0, len(own), 64):
                            some = own[lo:lo + 64]
                            yield _rows(i, ((some & mask)[:, None] ^ flips[i][level]).ravel(), np.repeat(some, len(flips[i][level])),
                                        np.ones(len(some) * len(flips[i][level]), bool), False)

    return prints.mapInArrow(run, "part int, value long, fp long, probe boolean, member boolean")


def _rows(part: int, value: np.ndarray, fp: np.ndarray, probe: np.ndarray, member: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(fp), part, np.int32)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(probe),
         pa.array(np.full(len(fp), member))], names=["part", "value", "fp", "probe", "member"])


def _dealt(entries: DataFrame, limit: int) -> DataFrame:
    """``part, value, x, y, own`` and the entry: buckets above ``limit`` rows as pairs x <= y of blocks, others as one."""
    hot = entries.groupBy("part", "value").agg(F.count("*").alias("rows")).where(F.col("rows") > limit).select(
        "part", "value", F.ceil(F.col("rows") * 2 / limit).cast("int").alias("blocks"))
    rows = entries.join(hot, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("part", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp", "probe", "member")


class _Forest:
    """Classes of a chunk's rows; joins give the edges of a spanning forest."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        apart = root[a] != root[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            x, y = self._find(i), self._find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                self.edges.append((i, j))
        if apart.any():
            while (root != (up := root[root])).any():
                root[:] = up

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)


def _links(t: pa.Table, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints at both ends of a spanning forest of the links within whole buckets."""
    cols = [t.column(c).to_numpy() for c in ("part", "value", "x", "y")]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    start = np.flatnonzero(new)
    end = np.repeat(np.append(start[1:], len(new)), np.diff(np.append(start, len(new))))
    fp = t.column("fp").to_numpy().view(np.uint64)
    probe, member = (t.column(c).to_numpy(zero_copy_only=False) for c in ("probe", "member"))
    own, crossing = t.column("own").to_numpy(), cols[2] != cols[3]
    forest, at, k = _Forest(len(fp)), np.arange(len(fp)), 1
    while True:
        at = at[at + k < end[at]]
        if not len(at):
            break
        to = at + k
        close = np.bitwise_count(fp[at] ^ fp[to]) <= tau
        close &= (probe[at] & member[to]) | (member[at] & probe[to])
        close &= ~crossing[at] | (own[at] != own[to])
        forest.join(at[close], to[close])
        k += 1
    e = np.array(forest.edges, np.int64).reshape(-1, 2)
    return fp[e[:, 0]], fp[e[:, 1]]


def links(prints: DataFrame, tau: int = TAU, limit: int = LIMIT) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``), enough to connect all that are linked."""
    prints = cut(prints)
    total = prints.count()
    # a bounded sample: the fingerprints with the smallest hashes
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    masks, scale = plan(sample, total, tau)
    rows = _dealt(_entries(prints, masks, sample, scale, tau), limit)
    keys = ["part", "value", "x", "y"]

    def run(batches):
        held, count = [], 0

        def flush(t: pa.Table):
            a, b = _links(t, tau)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            count += b.num_rows
            if count < ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            differs = np.any([(c := t.column(k).to_numpy()) != c[-1] for k in keys], axis=0)
            last = int(np.flatnonzero(differs).max(initial=-1)) + 1
            if last:
                yield flush(t.slice(0, last).combine_chunks())
                held, count = t.slice(last).to_batches(), t.num_rows - last
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return gathered(rows, keys).mapInArrow(run, "a long, b long")


def simhash_classes(docs: DataFrame, k: int = 3, tau: int = TAU, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links) of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    found = cut(fingerprints(docs, k, doc_id, text))
    named = found.where("doc_id is not null")
    least = cut(named.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # an id with several texts: its fingerprints are linked as they stand
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id", "a")
    given = named.join(several, "doc_id").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    labels = cut(components(links(least.select("fp"), tau, limit).unionByName(given)))
    label = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = label.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return found.join(ids, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).cast(kind).alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents."""
    return simhash_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


# XXH64 and majority bits are beyond SQL's functions; the tests compare with a plain version.
SQL = {"op11_simhash": None}
