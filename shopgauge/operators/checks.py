"""Validation (A3–A6) and QA (B13–B15) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import money_sum, safe_div
from ..sources.files import CORRUPT
from . import rollup


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """A3: primary-key check → rows (issue, cnt): duplicated keys and NULL keys."""
    any_null = None
    for k in keys:
        c = F.col(k).isNull()
        any_null = c if any_null is None else any_null | c
    # one pass: rows per key, then both counts from that small table
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    both = per_key.agg(F.count_if(~any_null & (F.col("_c") > 1)).alias("dup"),
                       F.coalesce(F.sum(F.when(any_null, F.col("_c"))), F.lit(0)).alias("nul"))
    return both.select(F.explode(F.array(
        F.struct(F.lit("DUPLICATE_KEY").alias("issue"), F.col("dup").cast("bigint").alias("cnt")),
        F.struct(F.lit("NULL_KEY").alias("issue"), F.col("nul").cast("bigint").alias("cnt")))).alias("r")
    ).select("r.issue", "r.cnt")


def check_missing_region(stores: DataFrame, regions: DataFrame) -> DataFrame:
    """A4: stores whose region is absent from regions (a NULL region counts)."""
    missing = stores.join(regions.select("region"), "region", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("cnt")).select(
        F.lit("MISSING_REGION_IN_REGIONS").alias("issue"), "cnt")


def check_duplicate_store_date(sales: DataFrame) -> DataFrame:
    """A5: number of (store_id, date) keys with more than one row (keys, not rows)."""
    dups = sales.groupBy("store_id", "date").count().where(F.col("count") > 1)
    return dups.agg(F.count(F.lit(1)).alias("rows_affected")).select(
        F.lit("DUPLICATE_STORE_DATE").alias("issue"), "rows_affected")


def check_date_span(sales: DataFrame) -> DataFrame:
    """First and last sale date."""
    return sales.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def orphan_sales(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Sales rows whose store is unknown (silently dropped by B1)."""
    return sales.join(stores.select("store_id"), "store_id", "left_anti").agg(
        F.count(F.lit(1)).alias("orphan_rows"))


def unreadable_rows(loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and unreadable rows of a load with kept raw lines, by key (NULL keys are one)."""
    return loaded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("loaded_rows"), F.count(CORRUPT).alias("unreadable_rows"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        money_sum("revenue").alias("revenue"), F.sum("transactions").alias("transactions"))


def qa_excluded_share(enriched: DataFrame) -> DataFrame:
    """Share of rows outside the core; NULL on empty input."""
    return enriched.agg(safe_div(F.count_if(F.col("keep_core") == 0), F.count(F.lit(1)))
                        .alias("excluded_share"))


def qa_region_sanity(last90: DataFrame) -> DataFrame:
    """Mean of daily (row-level) aov, tx and revenue per region."""
    return rollup.qa_region_sanity(rollup.by_store(last90))


def qa_age_mix(last90: DataFrame) -> DataFrame:
    """Rows per store-age bucket, most rows first."""
    return rollup.qa_age_mix(rollup.by_day(last90))
