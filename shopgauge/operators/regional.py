"""Regional drivers (D1–D8): per-capita, income and population bins, gap decomposition.

All tables here are at region grain (one row per region), so windows
without a partition (NTILE over all regions) run over an aggregated,
region-sized input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.measures import mean, money_avg, safe_div
from . import rollup
from .kpi import regression
from .ranking import add_ntiles, asc_last


def region_agg(base: DataFrame) -> DataFrame:
    """Region totals, aov*, mean population and income over its rows."""
    return rollup.region_agg(rollup.by_store(base))


def network_bench(base: DataFrame) -> DataFrame:
    """Network totals and aov* (always exactly one row)."""
    return rollup.network_bench(rollup.by_store(base))


def _per_capita() -> F.Column:
    return F.when(F.col("population") > 0, F.col("revenue") / F.col("population"))


def region_income_bins(ra: DataFrame, params: Params = Params()) -> DataFrame:
    """D3: per-capita revenue and income quintile (NTILE(5) by income ASC, NULLs last)."""
    out = ra.withColumn("revenue_per_capita", _per_capita())
    return add_ntiles(out, [], {"income_quintile": (5, asc_last("avg_income", "region"))}).select(
        "region", "revenue", "transactions", "aov", "population", "avg_income",
        "revenue_per_capita", "income_quintile")


def income_aov_stats(ra: DataFrame) -> DataFrame:
    """Regression of aov* on income (differs from C14, trap T8)."""
    return regression(ra, "aov", "avg_income",
                      ("n_regions", "corr_income_aov", "slope_aov_per_income", "intercept"))


def revenue_decomposition(ra: DataFrame, nb: DataFrame) -> DataFrame:
    """Region revenue gap against network totals (trap T15).

    aov_component = (aov_r - aov_n) * tx_n, tx_component = (tx_r - tx_n) * aov_n,
    cross = (aov_r - aov_n) * (tx_r - tx_n); they sum to rev_r - rev_n.
    The network row and the region count are one-row aggregates, so the
    cross join is a broadcast of exactly one row.
    """
    n_regions = ra.agg(F.count(F.lit(1)).alias("_regions"))
    one = nb.crossJoin(n_regions)
    j = ra.crossJoin(F.broadcast(one))
    d_aov = F.col("aov") - F.col("net_aov")
    d_tx = F.col("transactions") - F.col("net_transactions")
    return j.select(
        "region", "revenue", "transactions", "aov", "net_revenue", "net_transactions", "net_aov",
        (F.col("revenue") - safe_div(F.col("net_revenue"), F.col("_regions")))
        .alias("gap_vs_equal_share"),
        (d_aov * F.col("net_transactions")).alias("aov_component"),
        (d_tx * F.col("net_aov")).alias("tx_component"),
        (d_aov * d_tx).alias("cross_component"))


def income_quintile_summary(bins: DataFrame) -> DataFrame:
    """Means over the regions of each income quintile."""
    return bins.groupBy("income_quintile").agg(
        F.count(F.lit(1)).alias("regions_in_bin"),
        F.avg("avg_income").alias("bin_avg_income"),
        mean("aov").alias("bin_avg_aov"),
        money_avg("revenue").alias("bin_avg_revenue"),
        F.avg("transactions").alias("bin_avg_tx"),
        mean("revenue_per_capita").alias("bin_avg_rev_per_capita"))


def population_bins(ra: DataFrame, params: Params = Params()) -> DataFrame:
    """Population tercile, NTILE(3) by population ASC (NULLs last)."""
    return add_ntiles(ra, [], {"population_tercile": (3, asc_last("population", "region"))})


def population_tercile_summary(pb: DataFrame) -> DataFrame:
    """Means over the regions of each population tercile."""
    return pb.groupBy("population_tercile").agg(
        F.count(F.lit(1)).alias("regions_in_bin"),
        F.avg("population").alias("bin_avg_population"),
        mean("aov").alias("bin_avg_aov"),
        money_avg("revenue").alias("bin_avg_revenue"),
        F.avg("transactions").alias("bin_avg_tx"),
        mean(_per_capita()).alias("bin_avg_rev_per_capita"))
