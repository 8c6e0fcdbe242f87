"""Session helpers: local sessions for tests/bench and the checkpoint folder.

Library code never invents storage on a cluster: lineage is cut in the
folder the cluster names in ``spark.checkpoint.dir``.  Only a local-mode
session without that setting (tests, bench) gets a fresh /tmp folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "shopgauge", driver_memory: str = "16g",
                  extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the benchmark; gets its own checkpoint folder."""
    scratch = tempfile.mkdtemp(prefix="shopgauge-ckpt-", dir="/tmp")
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .config("spark.checkpoint.dir", scratch)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Order: the context's checkpoint dir, then ``spark.checkpoint.dir``;
    a local-mode session with neither gets its own /tmp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        conf = tempfile.mkdtemp(prefix="shopgauge-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_and_reload(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise ``df`` as parquet in the shared checkpoint folder and read it back.

    Unlike ``persist`` this survives lost executors, and unlike an RDD
    checkpoint the reloaded table is columnar, so later filters and
    projections are pushed into the scan again.
    """
    return write_at(df, new_path(df.sparkSession, name), partition_by)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_at(df: DataFrame, path: str, partition_by: list[str] | None = None, only_partitions: bool = False) -> DataFrame:
    """Writes ``df`` as parquet at ``path`` and reads the whole table there.

    ``only_partitions`` replaces just the partitions that ``df`` has rows of.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only_partitions else "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # a table without rows may have no file to infer from


def write_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``write_and_reload``, and the rows written, counted on the way."""
    seen = Observation()
    table = write_and_reload(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return table, seen.get["rows"]


def remove_written(df: DataFrame) -> None:
    """Deletes a table made by ``write_and_reload``; its DataFrame can no longer be read.

    Only folders in the session's own checkpoint folder are deleted.
    """
    spark = df.sparkSession
    own = checkpoint_dir(spark).rstrip("/") + "/"
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = folder.find(own.removeprefix("file:").lstrip("/"))
        if at < 0:
            continue
        top = folder[:at] + own.removeprefix("file:").lstrip("/") + folder[at + len(own.removeprefix("file:").lstrip("/")):].split("/")[0]
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tune_for_scale(spark: SparkSession, fact_bytes: int, target_partition_mb: int = 256) -> dict:
    """Set the runtime SQL options for a fact table of ``fact_bytes`` (compressed).

    Shuffle partitions are sized so one partition holds ~``target_partition_mb``
    of input, never fewer than the cluster's cores; AQE coalesces what turns
    out smaller and splits skewed partitions of joins.  Returns the settings it applied.
    """
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, int(fact_bytes // (target_partition_mb * 2**20)) + 1)
    settings = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": f"{target_partition_mb}m",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    return settings
