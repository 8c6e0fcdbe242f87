"""KPI core (C1–C16): network, region, store, calendar and lifecycle KPIs.

Input is the last-90 view unless stated.  Tables over the facts are merged
from the states of ``rollup`` (partial + final aggregation); peer statistics
are joined back from their small per-region aggregate instead of a
window over a whole region, so a region holding most stores is still
spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.measures import kpi_aggs, mean, money_avg
from ..functions.stats import safe_corr, safe_intercept, safe_slope, z_score
from . import rollup
from .joins import attach
from .ranking import add_ntiles, desc_first


def exec_kpi(base: DataFrame) -> DataFrame:
    """Network revenue, transactions and aov*."""
    return rollup.exec_kpi(rollup.by_store(base))


def regional_kpis(base: DataFrame) -> DataFrame:
    """Region KPIs plus the mean of daily per-capita revenue."""
    return rollup.regional_kpis(rollup.by_store(base))


def store_kpis(base: DataFrame) -> DataFrame:
    """Store KPIs over the window."""
    return rollup.store_kpis(rollup.by_store(base))


def region_bench(stores: DataFrame) -> DataFrame:
    """C4: peer benchmark per region over store KPIs (unweighted by store)."""
    return stores.groupBy("region").agg(
        money_avg("revenue").alias("avg_rev_store"),
        mean("aov").alias("avg_aov_store"),
        F.avg("transactions").alias("avg_tx_store"),
        F.stddev_pop("revenue").alias("std_rev_store"),
        F.stddev_pop("aov").alias("std_aov_store"),
        F.stddev_pop("transactions").alias("std_tx_store"),
    )


def stores_vs_region(stores: DataFrame, bench: DataFrame, params: Params = Params(),
                     region_rows: int | None = None) -> DataFrame:
    """Gaps and z-scores of each store against its region's peers."""
    j = attach(stores, bench, ["region"], max_rows=params.broadcast_max_rows,
               known_rows=region_rows)
    return j.select(
        "store_id", "region", "revenue", "transactions", "aov",
        "avg_rev_store", "avg_aov_store", "avg_tx_store",
        (F.col("revenue") - F.col("avg_rev_store")).alias("gap_rev_vs_region"),
        (F.col("aov") - F.col("avg_aov_store")).alias("gap_aov_vs_region"),
        (F.col("transactions") - F.col("avg_tx_store")).alias("gap_tx_vs_region"),
        z_score("revenue", "avg_rev_store", "std_rev_store").alias("z_rev_vs_region"),
        z_score("aov", "avg_aov_store", "std_aov_store").alias("z_aov_vs_region"),
        z_score("transactions", "avg_tx_store", "std_tx_store").alias("z_tx_vs_region"),
    )


def weekday_seasonality(base: DataFrame) -> DataFrame:
    """KPIs by ISO weekday (1 = Monday)."""
    return rollup.weekday_seasonality(rollup.by_day(base))


def daily_trend(base: DataFrame) -> DataFrame:
    """C7."""
    return rollup.daily_trend(rollup.by_day(base))


def weekly_trend(base: DataFrame) -> DataFrame:
    """Weeks start on Monday; edge weeks are partial, as in the reference."""
    return rollup.weekly_trend(rollup.by_day(base))


def quarter_kpis(quarter: DataFrame) -> DataFrame:
    """Store KPIs since the start of the as-of quarter (all-time core view)."""
    return (quarter.where(F.col("keep_core") == 1).groupBy("store_id", "region")
            .agg(*kpi_aggs(names=("q_rev", "q_tx", "q_aov"))))


def quarter_league(qk: DataFrame, params: Params = Params()) -> DataFrame:
    """Quartiles within region by q_rev, q_aov and q_tx (1 = best).

    DESC sorts NULLs first as PostgreSQL does; store_id breaks ties.
    """
    return add_ntiles(qk, ["region"], {f"quartile_by_{c}": (4, desc_first(f"q_{c}", "store_id")) for c in ("rev", "aov", "tx")})


def lifecycle_kpis(base: DataFrame) -> DataFrame:
    """C11: KPIs by store-age bucket (pre-open included)."""
    return rollup.lifecycle_kpis(rollup.by_day(base))


def aov_by_region(base: DataFrame) -> DataFrame:
    """Mean of row-level AOV per region (not aov*; trap T8)."""
    return rollup.aov_by_region(rollup.by_store(base))


def income_vs_aov(aov_region: DataFrame, regions: DataFrame, params: Params = Params(),
                  region_rows: int | None = None) -> DataFrame:
    """Region income beside its mean daily AOV (scatter data)."""
    r = regions.select("region", F.col("avg_income").cast("double").alias("avg_income"))
    return attach(aov_region, r, ["region"], max_rows=params.broadcast_max_rows,
                  known_rows=region_rows).select(
        "region", "avg_income", "avg_aov")


def regression(df: DataFrame, y: str, x: str,
               names=("n_regions", "corr", "slope", "intercept")) -> DataFrame:
    """Count of rows (NULL y included, T19), corr, slope, intercept of y on x;
    NULL instead of an error when x or y is constant (T9)."""
    n, c, s, i = names
    return df.agg(F.count(F.lit(1)).alias(n), safe_corr(y, x).alias(c),
                  safe_slope(y, x).alias(s), safe_intercept(y, x).alias(i))


def income_aov_regression(iva: DataFrame) -> DataFrame:
    return regression(iva, "avg_aov", "avg_income")


REGION_COLS = ["region", "aov", "revenue", "transactions", "avg_rev_per_capita"]


def top_regions(regional: DataFrame, n: int = 5) -> DataFrame:
    """C15 top: by aov DESC (NULLs first, as PostgreSQL)."""
    return regional.orderBy(F.col("aov").desc_nulls_first(), "region").limit(n).select(*REGION_COLS)


def bottom_regions(regional: DataFrame, n: int = 5) -> DataFrame:
    """C15 bottom: by aov ASC (NULLs last)."""
    return regional.orderBy(F.col("aov").asc_nulls_last(), "region").limit(n).select(*REGION_COLS)


STORE_COLS = ["store_id", "region", "revenue", "z_rev_vs_region", "gap_rev_vs_region"]


def top_stores(svr: DataFrame, n: int = 20) -> DataFrame:
    """C16 top: z_rev_vs_region DESC NULLS LAST (TakeOrderedAndProject, no full sort)."""
    return (svr.orderBy(F.col("z_rev_vs_region").desc_nulls_last(), "store_id")
            .limit(n).select(*STORE_COLS))


def bottom_stores(svr: DataFrame, n: int = 20) -> DataFrame:
    """C16 bottom: z_rev_vs_region ASC NULLS LAST."""
    return (svr.orderBy(F.col("z_rev_vs_region").asc_nulls_last(), "store_id")
            .limit(n).select(*STORE_COLS))

