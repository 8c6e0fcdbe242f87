"""Core views B9–B12 over the enriched sales, relative to an explicit as-of date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params

PARTITION_COLUMN = "sale_month"


def _date_range(df: DataFrame, start, end=None) -> DataFrame:
    """Date filter; on a table written partitioned by month the month column
    is filtered too, so whole partitions are pruned at planning time."""
    cond = F.col("date") >= F.lit(start)
    if end is not None:
        cond = cond & (F.col("date") <= F.lit(end))
    if PARTITION_COLUMN in df.columns:
        cond = cond & (F.col(PARTITION_COLUMN) >= F.lit(start.replace(day=1)))
    return df.where(cond)


def visible(df: DataFrame) -> DataFrame:
    return df.drop(PARTITION_COLUMN) if PARTITION_COLUMN in df.columns else df


def sales_last90(enriched: DataFrame, params: Params = Params()) -> DataFrame:
    """B9 ``v_sales_last90``: date >= as_of - window_days, keep_core = 1.

    No upper bound, as in the reference (T1); ``closed_window`` adds one.
    NULL dates never pass (T21).
    """
    end = params.as_of if params.closed_window else None
    return visible(_date_range(enriched, params.window_start, end).where(F.col("keep_core") == 1))


def core(enriched: DataFrame) -> DataFrame:
    return enriched.where(F.col("keep_core") == 1)


def sales_clean_alltime(enriched: DataFrame) -> DataFrame:
    """B10 ``v_sales_clean_alltime``."""
    return visible(core(enriched))


def sales_anomalies(enriched: DataFrame) -> DataFrame:
    """B11 ``v_sales_anomalies``: outside the core, or rule C (kept in core)."""
    return visible(enriched.where((F.col("keep_core") == 0) | (F.col("flag_rev_nonpos_txpos") == 1)))


def current_quarter(clean_alltime: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows from the start of the as-of quarter on (C9), no upper bound unless closed."""
    end = params.as_of if params.closed_window else None
    return visible(_date_range(clean_alltime, params.quarter_start, end))


def register_views(views: dict[str, DataFrame]) -> None:
    """Expose DataFrames as temp views (``v_stores``, ``v_regions``, …)."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
