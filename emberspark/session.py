"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at archive scale; all are plain Spark SQL confs.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcasts are only ever chosen by size: AQE/Catalyst compare runtime
    # statistics with this threshold (bytes).
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT-compile methods above 8000 bytecodes; whole-stage
    # codegen falls back to per-operator code for larger ones instead of
    # running them interpreted (the value the Spark docs suggest for HotSpot).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, app: str = "emberspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the scale settings applied.

    On a cluster, pass ``master=None`` and let spark-submit decide; for tests
    ``local[*]`` with a small shuffle partition count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SCALE_CONF)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def sizing_conf(input_bytes: float, total_cores: int, target_partition_bytes: int = 256 * 1024 * 1024,
                shuffle_bytes_ratio: float = 0.25) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of Parquet on
    ``total_cores`` executor cores.

    * scan splits of ``target_partition_bytes`` (compressed) keep a task's
      decoded batch well inside executor memory; at 100 TB that is ~400k
      tasks, a few hundred waves on 8,000 cores;
    * the initial shuffle partition count is sized for the *largest* shuffle
      (only the spatial join, the global rank and the long-to-wide pivot
      move pixel-sized data; the class/date/tile reports move one row per
      key and task) at ~``target_partition_bytes`` each, never fewer than
      two per core; AQE then coalesces small ones and splits skewed ones.
    """
    shuffle_parts = max(2 * total_cores, int(input_bytes * shuffle_bytes_ratio / target_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 * 1024 * 1024),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (unit tests on one machine) do we fall back to a fresh temp folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no JVM context reachable (e.g. a remote session)
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc is not None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if sc is not None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="emberspark-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir()
    return named


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    path = os.path.join(base, name)
    return path
