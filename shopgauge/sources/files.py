"""File sources and sinks: CSV load (A1), idempotent stage writes (A2), BI export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

CORRUPT = "_corrupt_record"


OPTIONS = {"mode": "PERMISSIVE", "dateFormat": "yyyy-MM-dd", "columnNameOfCorruptRecord": CORRUPT}


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_csv(spark: SparkSession, path: str, schema, keep_unreadable: bool = False) -> DataFrame:
    """CSV with header and an explicit schema; bad fields become NULL (A1).

    A malformed date therefore reaches rule D as a NULL date.  With
    ``keep_unreadable`` a column ``_corrupt_record`` has the raw text of each
    line with a field that does not parse, and NULL for the others;
    ``checks.unreadable_rows`` counts them.
    """
    return (spark.read.schema(_with_corrupt(schema) if keep_unreadable else schema)
            .options(header=True, **OPTIONS).csv(path))


def parse_csv(lines: DataFrame, schema, column: str = "value") -> DataFrame:
    """``read_csv`` with ``keep_unreadable`` for a column of CSV lines without header (A1)."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _with_corrupt(schema))
    return lines.select(F.from_csv(F.col(column), ddl, OPTIONS).alias("_row")).select("_row.*")


def read_raw(spark: SparkSession, regions_path: str, stores_path: str, sales_path: str):
    """Load the three raw tables (regions, stores, sales) from CSV files or folders."""
    return (read_csv(spark, regions_path, schemas.REGIONS),
            read_csv(spark, stores_path, schemas.STORES),
            read_csv(spark, sales_path, schemas.SALES))


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet") -> None:
    """Rebuild a stage table idempotently (DROP + CREATE AS ≙ overwrite) (A2)."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def export_views(views: dict[str, DataFrame], base_path: str) -> list[str]:
    """Write each named result table as parquet under ``base_path``.

    The BI views of the reference (overview, regional, league, lifecycle,
    risk) become one parquet table per result; nothing passes the driver.
    """
    written = []
    for name, df in views.items():
        path = f"{base_path.rstrip('/')}/{name}"
        write_stage(df, path)
        written.append(path)
    return written


def balance(df: DataFrame, key: str) -> DataFrame:
    """Hash-distribute a scan that yields fewer splits than the cluster has cores.

    A big table arrives in many splits and is returned untouched (no
    shuffle).  A small file stored as one row group would otherwise run
    every narrow stage after the scan - joins, flags, map-side partial
    aggregation - in a single task.  Hash partitioning on a well-spread
    key is deterministic, so a retried task sees the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
