"""Writers: index/score tables, assessment records, series and report exports.

All writers are bulk DataFrame writes (never a row at a time). Layout choices
are for the readers: pixel tables are partitioned by date and tile so a
scene's query prunes directories, and clustered by row within a file so
row-group statistics skip most of a tile for a bbox or row-range read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def metadata_json(processing_ts: Column | None = None, extra: dict | None = None) -> Column:
    """The caller's record metadata as JSON text; NULL when there is nothing to record.

    ``processing_date`` is ISO-8601 (``yyyy-MM-ddTHH:mm:ss``) of ``processing_ts``;
    ``extra`` holds values or columns. NULL entries are left out.
    """
    entries = [(k, v if isinstance(v, Column) else F.lit(v)) for k, v in (extra or {}).items()]
    if processing_ts is not None:
        entries.append(("processing_date", F.date_format(processing_ts, "yyyy-MM-dd'T'HH:mm:ss")))
    if not entries:
        return F.lit(None).cast("string")
    m = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in entries]),
                          F.array(*[v.cast("string") for _, v in entries]))
    m = F.map_filter(m, lambda k, v: v.isNotNull())
    return F.when(F.size(m) > 0, F.to_json(m))


# Column descriptions written with index tables (the band description of a raster).
INDEX_DESCRIPTIONS = {
    "ndvi": "NDVI (B08 - B04) / (B08 + B04), clipped to [-1, 1]",
    "ndmi": "NDMI (B08 - B11) / (B08 + B11), clipped to [-1, 1]",
    "nbr": "NBR (B08 - B12) / (B08 + B12), clipped to [-1, 1]",
    "risk_score": "risk score 0-100",
    "risk_category": "risk class 1-5, 0 = no data",
}


def write_index_table(df: DataFrame, path: str, index_cols: list[str],
                      keys=("tile_id", "px_row", "px_col"), partition_by=("scene_date",),
                      mode: str = "overwrite", num_files: int | None = None) -> None:
    """Index raster sink: one column per index, partitioned by scene.

    Requires scene metadata (a ``scene_date`` or the partition columns) like
    the raster writer requires a transform.
    """
    missing = [c for c in partition_by if c not in df.columns]
    if missing:
        raise ValueError(f"no scene metadata available: missing {missing}")
    keys = [k for k in keys if k in df.columns]
    described = [F.col(c).alias(c, metadata={"comment": INDEX_DESCRIPTIONS.get(c, c)}) for c in index_cols]
    cols = [*partition_by, *keys, *described]
    n = num_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range-partition on the composite key: a date holding a third of all
    # pixels is split over many tasks (hash-partitioning on the date alone
    # would send it to one), and each file covers a contiguous key range.
    (df.select(*cols)
       .repartitionByRange(n, *partition_by, *keys)
       .sortWithinPartitions(*partition_by, *keys)
       .write.mode(mode).partitionBy(*partition_by).parquet(path))


def write_risk_map(df: DataFrame, path: str, num_files: int | None = None,
                   order=("tile_id", "px_row", "px_col"), mode: str = "overwrite") -> None:
    """Risk map sink clustered by ``order``: range-partitioned so each file
    holds a contiguous key range, sorted inside the file."""
    order = [c for c in order if c in df.columns]
    n = num_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode(mode).parquet(path)


def assessment_ids(key_cols: list[str]) -> Column:
    """Idempotent record id: a 64-bit hash of the natural key, so re-running
    an ingest for the same scene produces the same id (no counter, no
    driver round trip, no collisions in practice at 64 bits)."""
    return F.xxhash64(*[F.col(c) for c in key_cols])


def record_ids(df: DataFrame, key_cols) -> Column:
    """Id of a record by its natural key, its content but the timestamps, and the run key if there is one."""
    content = [f.name for f in S.ASSESSMENT_SCHEMA.fields if f.name in df.columns and f.name not in ("id", "created_at", "updated_at")]
    named = [*dict.fromkeys([*key_cols, *content, *(["_run"] if "_run" in df.columns else [])])]
    # hashes pass over NULLs: which values are missing is part of the id
    return F.xxhash64(*[F.col(c) for c in named], *[F.col(c).isNull() for c in named])


def create_tables(spark: SparkSession, location: str) -> None:
    """``risk_assessments`` and ``pixel_results`` as Parquet tables.

    Constraints of the row store map to: CHECK -> ``operators.quality``,
    foreign key -> ``operators.spatial.orphans``; indexes -> sorted files and
    Parquet statistics.
    """
    for name, schema in (("risk_assessments", S.ASSESSMENT_SCHEMA),
                         ("pixel_results", S.PIXEL_RESULT_SCHEMA)):
        cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
                  f"LOCATION '{location.rstrip('/')}/{name}'")


def stored_ids(spark: SparkSession, path: str) -> DataFrame | None:
    """Ids in the table at ``path``; None if there is no table yet. Any other failure to read it is raised."""
    try:
        return spark.read.parquet(path).select("id")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_assessments(df: DataFrame, path: str, key_cols=("assessment_date", "geom_wkt"),
                       skip_existing: bool = True, run_key: str | None = None) -> DataFrame:
    """Append assessment records, ids from the natural key; returns the ids.

    The id covers the whole content but the timestamps: two different
    assessments of one area and day are both kept, a repeated one is written
    once. ``run_key`` names the run or scene and is part of the id too, so
    that an equal result of another run is a record of its own.

    With ``skip_existing`` (default) records whose id is already stored are
    not written again, so re-running a job (after a failure, or twice by
    mistake) leaves the table unchanged: the anti-join reads only the stored
    ``id`` column.
    """
    out = df
    if "id" not in out.columns:
        keyed = out if run_key is None else out.withColumn("_run", F.lit(run_key))
        out = keyed.withColumn("id", record_ids(keyed, key_cols)).drop("_run")
    out = out.dropDuplicates(["id"])
    if skip_existing:
        stored = stored_ids(df.sparkSession, path)
        if stored is not None:
            out = out.join(stored, "id", "left_anti")
            # Pin the rows to write (reliable checkpoint in the shared folder):
            # the returned ids must not be re-derived against the table after
            # this write has changed it.
            from ..session import ensure_checkpoint_dir
            ensure_checkpoint_dir(df.sparkSession)
            out = out.checkpoint(eager=True)
    now = F.current_timestamp()
    for c in ("created_at", "updated_at"):
        if c not in out.columns:
            out = out.withColumn(c, now)
    cols = [f.name for f in S.ASSESSMENT_SCHEMA.fields if f.name in out.columns]
    out.select(*cols).write.mode("append").parquet(path)
    return out.select("id")


def write_pixel_results(df: DataFrame, path: str, mode: str = "overwrite",
                        num_files: int | None = None) -> None:
    """Pixel results table, partitioned by scene (date, tile) when present.

    Rows are range-partitioned on (date, tile, position) first, so each task
    writes one contiguous slice into few partition folders -- without it,
    every scan task would write a small file into every folder it touches.
    """
    cols = [f.name for f in S.PIXEL_RESULT_SCHEMA.fields if f.name in df.columns]
    extra = [c for c in ("scene_date", "tile_id") if c in df.columns]
    order = [c for c in ("lat", "lon") if c in df.columns]
    out = df.select(*cols, *extra)
    if extra:
        n = num_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionByRange(n, *extra, *order).sortWithinPartitions(*extra, *order)
        out.write.mode(mode).partitionBy(*extra).parquet(path)
    else:
        out.write.mode(mode).parquet(path)


def write_series_json(series_arrays: DataFrame, path: str) -> None:
    """Struct-of-arrays series (one row) as a JSON document."""
    series_arrays.coalesce(1).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Batch report rows (tiny aggregate) as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)
