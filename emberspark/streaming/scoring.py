"""Score newly arriving pixel files incrementally.

Every per-pixel operator (ingest rule, cloud mask, indices, the three score
models, classes) is a stateless projection, so the very same functions apply
to a ``readStream`` DataFrame. Series are computed from what it has written.

Sinks write Parquet with a checkpoint location in the shared checkpoint
folder, so a restarted query (or lost executors) resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..operators import quality as Q
from ..operators import scoring as SCO
from ..session import shared_dir


def pixel_stream(spark: SparkSession, source_dir: str, schema=S.PIXEL_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet pixel files appearing under ``source_dir`` as a stream."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(source_dir)


def score_stream(pixels: DataFrame, model: str = "calibrated", cloud_mask: bool = True,
                 weights=None) -> DataFrame:
    """Stateless scoring of a (streaming or batch) pixel DataFrame."""
    px = Q.ingest_bands(pixels)
    if cloud_mask:
        px = Q.apply_cloud_mask(px)
    return SCO.score_pixels(px, model=model, weights=weights)


def start(df: DataFrame, sink_dir: str, name: str, checkpoint: str | None = None,
          partition_by: list[str] | None = None, available_now: bool = True,
          output_mode: str = "append") -> StreamingQuery:
    """Start a Parquet sink with a checkpoint in the shared folder."""
    ckpt = checkpoint or shared_dir(df.sparkSession, f"stream-{name}")
    w = (df.writeStream.format("parquet").option("checkpointLocation", ckpt)
           .outputMode(output_mode).queryName(name))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(sink_dir)
