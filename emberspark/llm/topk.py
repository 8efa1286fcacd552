"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments; of each segment the mean and the deviation are kept, at
several resolutions.  For a segment of length l,

    |q - x|^2  >=  l * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)

so statistics bound every distance from below, and with the norms they bound the
inner product from above: q.x <= sum l * (mean_q * mean_x + dev_q * dev_x).  A block of
queries meets a block of candidates: the coarsest bound of all pairs names promising
candidates, their exact scores set each query's threshold, finer bounds drop pairs that
cannot reach it, and the survivors are scored exactly.  Bounds carry a margin for
rounding, so ties at the threshold survive and the result is exact.

Queries are a stated subset; blocks of ``QUERY_BLOCK`` queries are sent to every block
of ``BLOCK`` candidates (an equality join on the block's number), each pair of blocks
returns its best k, and these are merged by query.  Equal vectors cannot pile up: blocks
are dealt by row number.

Defined cases: vectors that are null, hold null or non-finite components, or whose id
is null take no part; a query without candidates has no row; vectors of several lengths
are searched within their own length; repeated ids are separate candidates, but none
with the query's own id; an empty table gives no rows; other columns are ignored.
Scores must fit a signed 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import cut, table

SCALE = 64
BLOCK = 8192
QUERY_BLOCK = 512
RESOLUTIONS = (1, 4, 16)


def quantize(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v, n``: floor(scale * x) of every component, for vectors that take part."""
    values = F.col(embedding).cast("array<double>")
    whole = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (embeddings.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & whole)
            .select(F.col(vec_id).cast("long").alias("vec_id"),
                    F.transform(values, lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size(embedding).alias("n")))


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """sqrt(l) * mean and sqrt(l) * deviation of each of ``parts`` segments, side by side."""
    out = []
    for seg in np.array_split(x, min(parts, x.shape[1]), axis=1):
        root = np.sqrt(seg.shape[1])
        out += [root * seg.mean(axis=1), root * seg.std(axis=1)]
    return np.stack(out, axis=1)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple]:
    """(query, candidate, score) of each query's best k candidates of the block."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    exact = np.float64 if size < 2 ** 52 else np.int64  # whole numbers in float64 are exact below 2**53
    qe, ce = q.astype(exact), c.astype(exact)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    margin = 1e-6 * (1 + np.linalg.norm(qf, axis=1) * max(1.0, np.linalg.norm(cf, axis=1).max(initial=0)))
    levels = [(statistics(qf, r), statistics(cf, r)) for r in RESOLUTIONS if r == 1 or r < q.shape[1]]
    own = qid[:, None] == cid[None, :]
    bound = levels[0][0] @ levels[0][1].T
    bound[own] = -np.inf
    rows = []
    first = min(len(cid), 4 * k)
    for i in range(len(qid)):
        alive = np.flatnonzero(bound[i] > -np.inf)
        if len(alive) > first:
            fine = levels[-1][0][i] @ levels[-1][1][(near := alive[np.argpartition(-bound[i][alive], first)[:first]])].T
            near = near[np.argsort(-fine)]
            floor = np.partition(ce[near] @ qe[i], -k)[-k] if len(near) >= k else -np.inf
            alive = alive[bound[i][alive] >= floor - margin[i]]
            for qs, cs in levels[1:]:
                if len(alive) > first:
                    alive = alive[cs[alive] @ qs[i] >= floor - margin[i]]
        score = ce[alive] @ qe[i]
        top = best_of(score, cid[alive], k)
        rows += [(int(qid[i]), int(cid[alive[j]]), int(score[j])) for j in top]
    return rows


def _blocks(vectors: DataFrame, count: int, name: str) -> DataFrame:
    """Rows dealt into ``count`` blocks of vectors of one length: ids and values side by side."""
    number = F.pmod(F.xxhash64(F.lit(name), F.monotonically_increasing_id()), F.lit(count)).cast("int")
    return vectors.withColumn("block", number).groupBy("n", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias(name))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query.

    ``vectors`` and ``queries`` have the columns of :func:`quantize`.
    """
    blocks = max(1, -(-vectors.count() // block))
    right = _blocks(vectors, blocks, "c")
    left = _blocks(queries, max(1, -(-queries.count() // query_block)), "q").drop("block")
    sent = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = sent.join(right, ["n", "block"]).select("q", "c")

    def run(batches):
        def matrix(cell):
            rows = cell.values
            flat = rows.field("v")
            return rows.field("vec_id").to_numpy(), flat.flatten().to_numpy().reshape(len(rows), -1)

        for b in batches:
            for q, c in zip(b.column("q"), b.column("c")):
                found = search_block(*matrix(q), *matrix(c), k)
                cols = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    # at most k rows a query and block: the best k of these
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every query (vec_id divisible by 20)."""
    vectors = cut(quantize(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


SQL = {"op7_topk": """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""}
