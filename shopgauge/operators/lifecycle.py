"""Store lifecycle (E1–E9): store-weeks, ramp curves, time to benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.dates import days_between, month_start, week_start
from ..functions.measures import EXACT, kpi_aggs
from . import rollup
from .percentiles import group_percentiles


def store_weeks(clean: DataFrame, params: Params = Params()) -> DataFrame:
    """Store-weeks since opening from the all-time core view.

    Pre-open rows are dropped.  Rows are grouped by weeks_since_open *and*
    calendar week, so a store-week crossing a Monday gives two partial
    rows, as in the reference (T11); ``whole_weeks`` groups by
    weeks_since_open only (``week`` is then the first calendar week).
    """
    days = F.greatest(days_between("date", "opening_date"), F.lit(0))
    base = clean.where(F.col("date") >= F.col("opening_date")).select(
        "store_id", "region",
        week_start("opening_date").alias("cohort_week0"),
        month_start("opening_date").alias("cohort_month"),
        F.floor(days / 7).cast("int").alias("weeks_since_open"),
        week_start("date").alias("week"), "revenue", "transactions")
    keys = ["store_id", "region", "cohort_week0", "cohort_month", "weeks_since_open"]
    aggs = kpi_aggs(names=("week_revenue", "week_tx", "week_aov"))
    if params.whole_weeks:
        return base.groupBy(*keys).agg(F.min("week").alias("week"), *aggs)
    return base.groupBy(*keys, "week").agg(*aggs)


def store_totals(base: DataFrame, names=("rev90", "tx90", "aov90")) -> DataFrame:
    """Store totals over the last-90 view."""
    return rollup.store_kpis(rollup.by_store(base), names)


def network_medians(totals: DataFrame, params: Params = Params()) -> DataFrame:
    """Medians over stores of aov90 and tx90 (NULLs ignored; one row)."""
    return group_percentiles(totals, [], specs=[("aov90", {"median_aov90_store": 0.5}),
                                                ("tx90", {"median_tx90_store": 0.5})])


def ttb_flagged(weeks: DataFrame, medians: DataFrame, params: Params = Params()) -> DataFrame:
    """1 when a store-week meets both network medians (>=); NULL → 0.

    The reference compares one week's transactions with a 90-day median
    (T12); ``weekly_benchmark`` scales that median to a week (7/91).
    """
    tx_bench = F.col("median_tx90_store")
    if params.weekly_benchmark:
        tx_bench = tx_bench * F.lit(7.0 / (params.window_days + 1))
    # medians is a global aggregate: exactly one row
    j = weeks.crossJoin(F.broadcast(medians))
    meets = (F.col("week_aov").isNotNull() & F.col("week_tx").isNotNull()
             & (F.col("week_aov") >= F.col("median_aov90_store")) & (F.col("week_tx") >= tx_bench))
    return j.select("store_id", "region", "cohort_month", "weeks_since_open", "week_aov", "week_tx",
                    F.when(meets, 1).otherwise(0).alias("meets_benchmark"))


def time_to_benchmark(flagged: DataFrame) -> DataFrame:
    """E5: first qualifying weeks_since_open per store; NULL if never."""
    first = F.min(F.when(F.col("meets_benchmark") == 1, F.col("weeks_since_open")))
    return flagged.groupBy("store_id", "region", "cohort_month").agg(
        first.alias("weeks_to_benchmark"))


def ramp_states(weeks: DataFrame) -> DataFrame:
    """Mergeable states by cohort, region and week since opening: sums, counts, and the stores as exact bitmaps.

    A bitmap has the 32,768 store ids of one bucket, so a state is bounded and
    distinct stores are counted by OR, whatever is merged.
    """
    def both(c: str, name: str) -> list[F.Column]:
        return [F.sum(c).alias(f"s_{name}"), F.count(c).alias(f"n_{name}")]
    revenue = F.col("week_revenue").cast(EXACT)
    return weeks.withColumn("_revenue", revenue).groupBy(
        "cohort_month", "region", "weeks_since_open", F.bitmap_bucket_number("store_id").alias("bucket")).agg(
        *both("_revenue", "revenue"), *both("week_tx", "tx"), *both("week_aov", "aov"),
        F.bitmap_construct_agg(F.bitmap_bit_position("store_id")).alias("stores"))


def ramp(states: DataFrame, *keys: str) -> DataFrame:
    """Ramp curves by any of cohort_month and region: unweighted means of store-week rows, distinct active stores."""
    sums = [F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in ("revenue", "tx", "aov") for k in "sn"]
    by_bucket = states.groupBy(*keys, "weeks_since_open", "bucket").agg(
        *sums, F.bitmap_count(F.bitmap_or_agg("stores")).alias("active"))

    def merged(c: str) -> F.Column:
        return F.try_divide(F.sum(f"s_{c}").cast("double"), F.sum(f"n_{c}").cast("double")).alias(f"avg_week_{c}")
    return by_bucket.groupBy(*keys, "weeks_since_open").agg(
        merged("revenue"), merged("tx"), merged("aov"), F.sum("active").alias("stores_active"))


def cohort_ramp(weeks: DataFrame) -> DataFrame:
    """Unweighted means of store-week rows per opening-month cohort."""
    return ramp(ramp_states(weeks), "cohort_month")


def regional_ramp(weeks: DataFrame) -> DataFrame:
    """The same per region."""
    return ramp(ramp_states(weeks), "region")


def ttb_summary(ttb: DataFrame, key: str, params: Params = Params()) -> DataFrame:
    """Stores hitting the benchmark, all stores, mean, p50, p90 of weeks."""
    return group_percentiles(
        ttb, [key], "weeks_to_benchmark", {"p50_weeks_to_bench": 0.5, "p90_weeks_to_bench": 0.9},
        extra_aggs=[F.count("weeks_to_benchmark").alias("stores_hit_bench"),
                    F.count(F.lit(1)).alias("stores_total"),
                    F.avg("weeks_to_benchmark").alias("avg_weeks_to_bench")]).select(
        key, "stores_hit_bench", "stores_total", "avg_weeks_to_bench",
        "p50_weeks_to_bench", "p90_weeks_to_bench")
