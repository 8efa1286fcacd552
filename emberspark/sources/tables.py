"""Parquet table access. Only the columns a plan uses are read (Catalyst prunes
the scan's ReadSchema) and comparisons on plain columns become PushedFilters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def stored(df: DataFrame, spread: bool = False) -> DataFrame:
    """``df`` written as a table below the shared checkpoint folder and read from there: computed once however often
    a plan reads it, and a lost executor costs no more than its own tasks.

    ``spread`` deals the rows over as many files as the session has shuffle partitions: for tables that are small in
    bytes and meet many partners in a join, which would otherwise run in few tasks.
    """
    if spread:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None,
                    lower: int | None = None, upper: int | None = None, partitions: int = 64,
                    properties: dict | None = None) -> DataFrame:
    """An assessment table held in a database, read in parallel.

    With ``key``/``lower``/``upper`` the read is split into ``partitions``
    range queries on the key (one per task); simple filters and column
    selections of the plan are pushed into each query by Spark's JDBC
    source. Needs the database's JDBC driver on the classpath.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if key is not None and lower is not None and upper is not None:
        r = (r.option("partitionColumn", key).option("lowerBound", str(lower))
              .option("upperBound", str(upper)).option("numPartitions", str(partitions)))
    return r.load()
