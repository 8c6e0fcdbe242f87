"""Continuous outlier flagging (the README's "flag outliers continuously").

The reference is batch only; this job applies the stateless part of the
cleaning to sales files as they arrive: the dimension joins (B1, a
stream-static broadcast join), the four anomaly flags (B2) and the core
rule (B5).  Exact repeats of a record are dropped within a watermark on
the sale date.  Winsorisation thresholds, keep-best dedupe and the KPI
tables need whole store-days and stay batch jobs over the written
output (``foreachBatch`` or a scheduled run of ``RetailModel``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Params
from ..operators import cleaning
from ..sources import schemas


def read_sales_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Sales files arriving in ``path`` (raw schema: store_id, date, revenue, transactions)."""
    reader = spark.readStream.schema(schemas.SALES).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def flag_stream(sales: DataFrame, stores: DataFrame, regions: DataFrame,
                params: Params = Params(), watermark: str = "3 days") -> DataFrame:
    """B1 + B2 + B5 on a sales stream; exact repeats dropped within the watermark.

    NULL-date rows cannot carry event time, so they are flagged and passed
    through without the repeat filter (rule D keeps them out of the core).
    """
    flagged = cleaning.sales_flagged(sales, stores, regions, params)
    flagged = flagged.withColumn("keep_core", cleaning.core_rule())
    dated = (flagged.where(F.col("date").isNotNull())
             .withColumn("event_time", F.col("date").cast("timestamp"))
             .withWatermark("event_time", watermark)
             .dropDuplicatesWithinWatermark(["store_id", "date", "revenue", "transactions"])
             .drop("event_time"))
    undated = flagged.where(F.col("date").isNull())
    return dated.unionByName(undated)


def start_flagging(flagged: DataFrame, sink_path: str, checkpoint: str,
                   trigger_seconds: int | None = None) -> StreamingQuery:
    """Append flagged rows as parquet; the checkpoint folder must be shared storage."""
    writer = (flagged.writeStream.format("parquet").outputMode("append")
              .option("path", sink_path).option("checkpointLocation", checkpoint))
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
