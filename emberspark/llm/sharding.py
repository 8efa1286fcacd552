"""Sharding: a uniform random shuffle into shards of exact sizes.

The rows lie in P partitions of known counts.  How many rows partition p sends to
bucket b follows a multivariate hypergeometric law, so the whole communication
matrix is drawn exactly without looking at a row: a seeded binary tree over the
partitions splits the bucket sizes between its halves, and a task finds its own
row of the matrix by walking down the tree (O(buckets * log P) per task, nothing
but P counts is held anywhere).  Each task permutes its rows and deals them out by
its row, the buckets are exchanged and permuted again; every permutation of the
table is then equally likely.

A shard is one or more buckets, so no task holds more than ``bucket_rows`` rows,
and since bucket sizes are fixed beforehand a row's slot is its bucket's offset
plus its place there: gapless, with no global sort.  Keys play no part, so equal
or hot keys cannot skew the exchange.

Defined cases: an empty table gives no rows; null ids and repeated rows are rows
like any other; null texts have size 1 and the CRC of no bytes; input columns
named like the added ones are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberspark.llm.common import pin, table, utf8

SHARDS = 16
BUCKET_ROWS = 100_000
SEED = 20240229
#: NumPy draws hypergeometric counts of populations below this.
LARGE = 1_000_000_000


def bucket_sizes(rows: int, shards: int, bucket_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, shard and first slot of every bucket; shard sizes differ by one at most."""
    size, shard, first = [], [], []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        parts = max(1, -(-n // bucket_rows))
        own = [n // parts + (k < n % parts) for k in range(parts)]
        size += own
        shard += [s] * parts
        first += [0, *np.cumsum(own)[:-1]]
    return np.array(size, np.int64), np.array(shard, np.int32), np.array(first, np.int64)


def _log_choose_error(n: float) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    n2 = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n2) / n2) / n2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is close to the mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            j += 2
            if total + term / j == total:
                return total
            total += term / j
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: int, n: int, p: float) -> float:
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    return (_log_choose_error(n) - _log_choose_error(x) - _log_choose_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
            + 0.5 * math.log(n / (2 * math.pi * x * (n - x))))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good, for counts of any size.

    NumPy draws below 1e9; beyond, a ratio of uniforms is accepted by the probability itself, written as
    binomials whose logarithms keep their digits at any size.
    """
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    p = drawn / total

    def log_mass(x):
        return _log_binomial(x, good, p) + _log_binomial(drawn - x, bad, p)

    mean = drawn * good / total
    width = math.sqrt(mean * (bad / total) * ((total - drawn) / (total - 1)) + 0.5)
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    top, span = log_mass(mode), 2 * (math.sqrt(2 / math.e) * width + 1.5 - math.sqrt(3 / math.e))
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + span * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_mass(x) - top:
            return x


def draw_counts(rng: np.random.Generator, left: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows come from each of ``left``'s buckets."""
    rest = int(left.sum())
    if rest < LARGE:
        return rng.multivariate_hypergeometric(left, drawn, method="marginals")
    out = np.zeros(len(left), np.int64)
    for i, n in enumerate(left.tolist()):
        rest -= n
        out[i] = hypergeometric(rng, n, rest, drawn) if n and drawn else 0
        drawn -= int(out[i])
    return out


def matrix_row(sizes: np.ndarray, before: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row ``p`` of the matrix; ``before[i]`` is the number of rows in partitions below i."""
    left = sizes.copy()
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=seed, counter=[lo, hi, 0, 0]))
        low = draw_counts(rng, left, int(before[mid] - before[lo]))
        if p < mid:
            left, hi = low, mid
        else:
            left, lo = left - low, mid
    return left


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED,
                        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in its shard).

    ``df`` is written to the checkpoint folder first: the counts and both
    permutations then see the same rows in the same partitions on every attempt.
    """
    spark = df.sparkSession
    df = pin(df.drop("shard", "slot"))
    counts = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}  # one number a partition
    parts = max(1, df.rdd.getNumPartitions())
    before = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(parts)])]).astype(np.int64)
    sizes, shard_of, first = bucket_sizes(int(before[-1]), shards, bucket_rows)
    plan = spark.sparkContext.broadcast((sizes, shard_of, first, before))
    fields = [f for f in df.schema.fields if f.name != "__bucket of sharding"]

    def deal(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches)  # one input split
        p = whole.column("__part of sharding")[0].as_py()
        sizes, _, _, before = plan.value
        to = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(sizes, before, p, seed))
        rng = np.random.Generator(np.random.Philox(key=seed + 1, counter=[p, 0, 0, 0]))
        whole = whole.drop_columns(["__part of sharding"]).append_column("__bucket of sharding", pa.array(rng.permutation(to)))
        yield from whole.append_column("__at of sharding", pa.array(p * (1 << 32) + np.arange(whole.num_rows))).to_batches()

    def settle(rows: pa.Table) -> pa.Table:
        b = rows.column("__bucket of sharding")[0].as_py()
        _, shard_of, first, _ = plan.value
        rows = rows.sort_by("__at of sharding").drop_columns(["__bucket of sharding", "__at of sharding"])  # arrival order differs between attempts
        rng = np.random.Generator(np.random.Philox(key=seed + 2, counter=[b, 0, 0, 0]))
        slot = first[b] + rng.permutation(rows.num_rows)
        rows = rows.append_column("shard", pa.array(np.full(rows.num_rows, shard_of[b], np.int32)))
        return rows.append_column("slot", pa.array(slot))

    dealt = df.withColumn("__part of sharding", F.spark_partition_id()).mapInArrow(
        deal, T.StructType([*fields, T.StructField("__bucket of sharding", T.IntegerType()), T.StructField("__at of sharding", T.LongType())]))
    return dealt.groupBy("__bucket of sharding").applyInArrow(
        settle, T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document dealt to 16 shards whose row counts are at most one apart."""
    text = utf8("text")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


SQL: dict[str, str] = {}
