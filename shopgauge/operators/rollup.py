"""A roll-up lattice: mergeable states of the last days by store and by day.

The facts are aggregated to two small tables, by store (with its region's
facts) and by (day, age bucket).  All coarser tables are merged from these:
network, region and store KPIs from the first, calendar and age KPIs from the
second.  A state holds exact sums and counts, so merging gives what
aggregating the facts gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_weekday, week_start
from ..functions.measures import EXACT, ratio_of_sums, row_aov

#: Sums keep the four exact decimals of money; 28 digits hold any total.
MONEY_SUM = "decimal(28,4)"
STORE_GRAIN = ["store_id", "region", "population", "avg_income"]
DAY_GRAIN = ["date", "store_age_bucket"]


def _states() -> list[Column]:
    return [F.sum(F.col("revenue").cast(EXACT)).cast(MONEY_SUM).alias("s_revenue"), F.count("revenue").alias("n_revenue"),
            F.sum("transactions").alias("s_transactions"), F.count("transactions").alias("n_transactions"),
            F.count(F.lit(1)).alias("n_rows")]


def _grain(base: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that the base has: a narrower base gives fewer facts, the same sums."""
    return [c for c in columns if c in base.columns]


def by_store(base: DataFrame) -> DataFrame:
    aov = row_aov()
    people = F.col("population") if "population" in base.columns else F.lit(None).cast("bigint")
    per_capita = F.when(people > 0, F.col("revenue") / people.cast("double"))
    return base.groupBy(*_grain(base, STORE_GRAIN)).agg(
        *_states(), F.sum(aov).alias("s_aov"), F.count(aov).alias("n_aov"),
        F.sum(per_capita).alias("s_per_capita"), F.count(per_capita).alias("n_per_capita"))


def by_day(base: DataFrame) -> DataFrame:
    return base.groupBy(*_grain(base, DAY_GRAIN)).agg(*_states())


def _revenue() -> Column:
    return F.sum("s_revenue").cast("double")


def _transactions() -> Column:
    return F.sum("s_transactions").cast("bigint")


def kpis(names=("revenue", "transactions", "aov")) -> list[Column]:
    """The (revenue, transactions, aov*) triple from states."""
    r, t, a = names
    return [_revenue().alias(r), _transactions().alias(t), ratio_of_sums(_revenue(), F.sum("s_transactions")).alias(a)]


def merged_mean(name: str) -> Column:
    """A plain mean of the rows from the states' sums and counts."""
    return F.try_divide(F.sum(f"s_{name}").cast("double"), F.sum(f"n_{name}").cast("double"))


def exec_kpi(stores: DataFrame) -> DataFrame:
    """C1 / D2 (other names): network revenue, transactions and aov*."""
    return stores.agg(*kpis(("total_revenue", "total_transactions", "network_aov")))


def network_bench(stores: DataFrame) -> DataFrame:
    """D2 (always exactly one row)."""
    return stores.agg(*kpis(("net_revenue", "net_transactions", "net_aov")))


def regional_kpis(stores: DataFrame) -> DataFrame:
    """Region KPIs plus the mean of daily per-capita revenue."""
    return stores.groupBy("region").agg(*kpis(), merged_mean("per_capita").alias("avg_rev_per_capita"))


def store_kpis(stores: DataFrame, names=("revenue", "transactions", "aov")) -> DataFrame:
    """Store KPIs over the window."""
    return stores.groupBy("store_id", "region").agg(*kpis(names))


def aov_by_region(stores: DataFrame) -> DataFrame:
    """Mean of row-level AOV per region (not aov*; trap T8)."""
    return stores.groupBy("region").agg(merged_mean("aov").alias("avg_aov"))


def region_agg(stores: DataFrame) -> DataFrame:
    """Region totals, aov*, mean population and income over its rows."""
    def over_rows(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.try_divide(F.sum(x * F.col("n_rows")), F.sum(F.when(x.isNotNull(), F.col("n_rows"))).cast("double"))
    return stores.groupBy("region").agg(*kpis(), over_rows("population").alias("population"),
                                        over_rows("avg_income").alias("avg_income"))


def weekday_seasonality(days: DataFrame) -> DataFrame:
    """KPIs by ISO weekday (1 = Monday)."""
    return days.groupBy(iso_weekday("date").alias("weekday")).agg(*kpis())


def daily_trend(days: DataFrame) -> DataFrame:
    """C7."""
    return days.groupBy("date").agg(*kpis())


def weekly_trend(days: DataFrame) -> DataFrame:
    """Weeks start on Monday; edge weeks are partial, as in the reference."""
    return days.groupBy(week_start("date").alias("week")).agg(*kpis())


def lifecycle_kpis(days: DataFrame) -> DataFrame:
    """C11: KPIs by store-age bucket (pre-open included)."""
    return days.groupBy("store_age_bucket").agg(*kpis())


def qa_region_sanity(stores: DataFrame) -> DataFrame:
    """Mean of daily (row-level) aov, tx and revenue per region."""
    return (stores.groupBy("region").agg(merged_mean("aov").alias("avg_aov"), merged_mean("transactions").alias("avg_tx"),
                                         merged_mean("revenue").alias("avg_rev"))
            .orderBy(F.col("avg_aov").desc_nulls_first(), "region"))


def qa_age_mix(days: DataFrame) -> DataFrame:
    """Rows per store-age bucket, most rows first."""
    return (days.groupBy("store_age_bucket").agg(F.sum("n_rows").alias("rows"))
            .orderBy(F.col("rows").desc(), "store_age_bucket"))
