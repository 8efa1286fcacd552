"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberspark.session import ensure_checkpoint_dir

# A-Z to a-z, every other byte unchanged (UTF-8 sequences are never touched).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def utf8(col: str):
    """A text column as its UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


#: The column that carries a text's bytes into a task.
TEXT = "__text of this task"


def with_bytes(docs: DataFrame, text: str, keep: list[str] | None, added: str) -> tuple[DataFrame, T.StructType]:
    """The columns ``keep`` (or all) but the added ones, with the text's bytes in ``TEXT``; and the schema of the result."""
    more = T.StructType.fromDDL(added)
    own = [c for c in (docs.columns if keep is None else keep) if c not in (*more.names, TEXT)]
    frame = docs.select(*[F.col(f"`{c}`") for c in own], utf8(text).alias(TEXT))
    return frame, T.StructType([*frame.schema.fields[:-1], *more.fields])


def add_columns(batch: pa.RecordBatch, values: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """A batch of :func:`with_bytes` without ``TEXT``, and with the given columns."""
    own = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != TEXT]
    return pa.RecordBatch.from_arrays([*(c for _, c in own), *values], names=[*(n for n, _ in own), *names])


def small(batches, column: str = TEXT, size: int = 4 << 20):
    """The batches cut into runs of rows with about ``size`` bytes of text (a longer text alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield b.slice(at, to - at)
            at = to


def crc32_text(col: str):
    """Unsigned CRC-32 of a column's value written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def held_out(col: str, modulus: int):
    """True where crc32(value as text) is divisible by ``modulus``; null ids are held out."""
    return F.coalesce(crc32_text(col) % modulus == 0, F.lit(True))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and go on from there; it is computed once."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint whose rows keep their partitions in every later job."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows that agree in ``keys`` in one partition, side by side, ordered by ``order`` within.

    The partitioning is by a hash of the keys: a plain repartition by columns on which the
    rows are joined already would be dropped as needless, and the join may then spread a
    key's rows again at run time.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *(order or []))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's written tables below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
