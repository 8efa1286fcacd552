"""Global ranks without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task. The
rank here is the textbook distributed form:

1. range-partition by the sort key (Spark samples the key to balance the
   ranges) and sort inside each partition;
2. ``monotonically_increasing_id`` encodes (partition id, position in the
   partition) -- a per-partition counter with no Python;
3. count rows per partition (one row per partition), turn the counts into
   offsets with a window over that tiny table, broadcast it (its size is
   bounded by the partition count, not by the data) and add.

The tagged rows are checkpointed (reliably, into the shared checkpoint
folder) before they are read twice: the range partitioner's sampling seed
depends on the RDD id, so two independent evaluations of the same range
shuffle may draw different bounds and disagree about which row sits in which
partition. Reading one materialised copy makes counts and ids consistent and
also spares a recomputation if an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir
from ..functions.geo import pixel_lat, pixel_lon
from ..functions.scores import category_name, class_at_least, where_computed

_LOCAL_BITS = 33
#: Buckets (raster rows) of a block of the two-level prefix sum.
BLOCK_ROWS = 4096


def global_row_number(df: DataFrame, order: list[str], out: str = "row_idx",
                      num_partitions: int | None = None, total: str | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order``.

    ``order`` should be a total order (unique key) for a deterministic result.
    Optionally also attach the total row count as column ``total``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumns({
        "_pid": F.shiftright(mid, _LOCAL_BITS),
        "_local": mid.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
    })
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid")
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"))
    # Bounded by the number of partitions: safe to broadcast.
    ranked = tagged.join(F.broadcast(offsets), "_pid")
    ranked = ranked.withColumn(out, F.col("_off") + F.col("_local"))
    if total:
        ranked = ranked.withColumnRenamed("_total", total)
    return ranked.drop("_pid", "_local", "_off", "_total")


def systematic_sample(df: DataFrame, order: list[str], target: int = S.MARKER_TARGET,
                      out: str = "sample_rank", by: list[str] | None = None) -> DataFrame:
    """Every ``step``-th row in ``order`` with ``step = max(1, n // target)``
    (per group of ``by`` columns, e.g. per scene of an archive).

    This yields ``ceil(n / step)`` rows -- up to ``2 * target - 1`` (39 at
    n = 39), exactly as the published marker rule does; it is a sampling
    operator, so the row count is the feature.

    Only the sampled rows are ever ranked. ``order[0]`` is used as a bucket
    (for a raster: the pixel row, so a bucket holds at most one raster row):

    1. rows per bucket -- one partial aggregate, one row per bucket crosses
       the shuffle;
    2. bucket offsets, a two-level prefix sum -- buckets are summed by blocks of
       ``BLOCK_ROWS``, a running sum over the blocks gives each its start, and
       a window by block the offsets within: one task sees only one row a
       block (so ``order[0]`` must be a number);
    3. the wanted global positions ``k * step`` fall into at most
       ``2 * target`` buckets per group: those (bucket, position-in-bucket,
       k) triples form a small table, broadcast to fetch the candidate rows;
    4. a window ranks rows only inside those buckets.

    No full sort, no single-partition window over the rows, nothing
    materialised; every step is deterministic, so a lost executor recomputes
    the same answer.
    """
    by = list(by or [])
    bucket, within = order[0], list(order[1:])
    keys = [*by, bucket]
    counts = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
                .withColumn("_block", F.floor(F.col(bucket) / BLOCK_ROWS)))
    blocks = counts.groupBy(*by, "_block").agg(F.sum("_cnt").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
                           F.sum("_sum").over(Window.partitionBy(*by)).alias("_n"))
    within_block = Window.partitionBy(*by, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.join(starts, [*by, "_block"]).select(
        *keys, "_cnt", "_n",
        (F.col("_start") + F.coalesce(F.sum("_cnt").over(within_block), F.lit(0))).alias("_off"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(target)))
    # k values whose position k*step lies in [off, off + cnt)
    k_lo = F.ceil(F.col("_off") / step)
    k_hi = F.floor((F.col("_off") + F.col("_cnt") - 1) / step)
    targets = (offs.where(k_lo <= k_hi)
                   .select(*keys, step.alias("_step"), "_off",
                           F.explode(F.sequence(k_lo, k_hi)).alias(out))
                   .select(*keys, out, (F.col(out) * F.col("_step") - F.col("_off")).alias("_pos")))
    # At most 2 * target rows per group; without groups this is a fixed bound
    # and broadcast explicitly, with groups AQE decides by its runtime size.
    tb = targets if by else F.broadcast(targets)
    cand = df.join(tb.select(*keys), keys, "left_semi")
    ranked = cand.withColumn("_pos", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*within)) - 1) if within else cand.withColumn("_pos", F.lit(0))
    return ranked.join(tb, [*keys, "_pos"]).drop("_pos")


def popup_text(score, name, lat, lon) -> "F.Column":
    """Marker text: class, score with one decimal, position with four."""
    return F.format_string("%s hazard, score %.1f of 100, at latitude %.4f and longitude %.4f",
                           F.col(name), F.col(score), F.col(lat), F.col(lon))


def high_risk_markers(scored: DataFrame, height, width, bounds=S.STUDY_AREA,
                      target: int = S.MARKER_TARGET, popup: bool = False) -> DataFrame:
    """Marker feed: sampled class >= 4 pixels in row-major order with lat/lon,
    score and class name (and popup text). ``height``/``width`` are columns or
    scalar subqueries."""
    west, south, east, north = bounds
    # Only the columns the feed needs are ranked (and checkpointed).
    hr = where_computed(scored, class_at_least("risk_score", 4)).select(
        "px_row", "px_col", "risk_score", "risk_category")
    s = systematic_sample(hr, ["px_row", "px_col"], target)
    out = s.select(
        "sample_rank", "px_row", "px_col",
        pixel_lat("px_row", height, south, north).alias("lat"),
        pixel_lon("px_col", width, west, east).alias("lon"),
        "risk_score",
        category_name("risk_category").alias("category_name"),
    )
    if popup:
        out = out.withColumn("popup", popup_text("risk_score", "category_name", "lat", "lon"))
    return out


def batch_assignment(tiles: DataFrame, tile: str = "tile_id", size: int = S.TILES_PER_BATCH) -> DataFrame:
    """Consecutive runs of ``size`` tiles in tile order -> ``batch_id``."""
    cat = tiles.select(tile).distinct()
    ranked = global_row_number(cat, [tile], out="tile_ordinal")
    return ranked.withColumn("batch_id", F.floor(F.col("tile_ordinal") / F.lit(size)).cast("long"))
