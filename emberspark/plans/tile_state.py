"""Tile batches that read each tile file once (E-06).

``update`` keeps a table of partial aggregates, one row for each tile file, tile and
scoring model: counts, sums and extremes, which merge into those of tiles and batches.  A
later run lists the files and reads those whose path, size and modification time, or whose
model, are not in the table yet.  Rows of files that are gone or were written anew stay in
the table and are passed over, as ``tile_totals`` joins it with the files of today.

Rows are appended, so a run that failed leaves either its rows or none, and two runs at a
time at worst add equal rows, which count once.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scores import normalize_weights
from ..operators import indices as I
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import scoring as SCO
from ..operators import stats as ST

FILE = ["path", "bytes", "modified"]
STATE = ("path string, bytes long, modified timestamp, model string, tile string, pixels long, scored long, "
         "risk_sum double, risk_min double, risk_max double")


def tile_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, modified`` of the Parquet tile files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
                        F.col("_metadata.file_modification_time").alias("modified"))


def model_name(indices: list[str] | None, weights: dict | None) -> str:
    """The scoring model as text: another index list or other weights are another model."""
    return json.dumps({"indices": sorted(indices or S.INDEX_BANDS), "weights": dict(sorted(normalize_weights(weights).items()))})


def _state(spark: SparkSession, state: str) -> DataFrame:
    try:
        return spark.read.schema(STATE).parquet(state)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def update(spark: SparkSession, path: str, state: str, indices: list[str] | None = None, weights: dict | None = None,
           tile: str = "tile_id") -> int:
    """Add the tile files that are not in the table yet; how many were read.

    ``indices`` restricts the score to those indices (renormalised); the paths of new files pass through the driver, as
    Spark's own file listing does.
    """
    model = model_name(indices, weights)
    known = _state(spark, state).where(F.col("model") == model).select(*FILE)
    new = [r.path for r in tile_files(spark, path).join(known, FILE, "left_anti").collect()]
    if not new:
        return 0
    read = spark.read.parquet(*new).select("*", F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("_file"))
    scored = SCO.add_calibrated_score(I.add_all_indices(Q.ingest_bands(read), only=indices), weights)
    rows = scored.groupBy(F.col("_file.file_path").alias("path"), F.col("_file.file_size").alias("bytes"),
                          F.col("_file.file_modification_time").alias("modified"), F.col(tile).cast("string").alias("tile")).agg(
        F.count("*").alias("pixels"), F.count("risk_score").alias("scored"), F.sum("risk_score").alias("risk_sum"),
        F.min("risk_score").alias("risk_min"), F.max("risk_score").alias("risk_max"))
    names = [c.split()[0] for c in STATE.split(", ")]
    rows.withColumn("model", F.lit(model)).select(*names).write.mode("append").parquet(state)
    return len(new)


def tile_totals(spark: SparkSession, path: str, state: str, indices: list[str] | None = None, weights: dict | None = None) -> DataFrame:
    """``tile, pixels, tile_mean_risk, risk_min, risk_max`` of the files of today, from the table alone."""
    rows = _state(spark, state).where(F.col("model") == model_name(indices, weights)).dropDuplicates([*FILE, "tile"])
    rows = rows.join(tile_files(spark, path), FILE, "left_semi")
    return rows.groupBy("tile").agg(
        F.sum("pixels").alias("pixels"), F.round(F.sum("risk_sum") / F.sum("scored"), 2).alias("tile_mean_risk"),
        F.min("risk_min").alias("risk_min"), F.max("risk_max").alias("risk_max"))


def batches(totals: DataFrame, per_batch: int = S.TILES_PER_BATCH) -> DataFrame:
    """Reports by batch of consecutive tiles: tiles, and mean, least and greatest of their means."""
    own = R.batch_assignment(totals.select("tile"), "tile", per_batch).select("tile", "batch_id")
    return ST.batch_report(totals.join(own, "tile"), by=["batch_id"])
