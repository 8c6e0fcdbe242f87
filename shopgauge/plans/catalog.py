"""Registrations of the KPI, regional, lifecycle, risk and summary queries.

Intermediate tables shared by several queries (store totals, z-scores,
store-weeks …) are built once per model and reused as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kpi, lifecycle, regional, risk, rollup, sketches, summaries
from ..session import write_and_reload
from .registry import register
from .stages import RetailModel


def memo(fn):
    """An intermediate, built once per model.

    ``f(m)`` is a plan, or the written table once there is one; ``f.written(m)``
    writes it first.  Tables that a result needs more than once (to join a
    group's aggregate to its rows, to number rows, for percentiles) are
    written, as the reference's temporary tables are, so nothing is computed
    again.  With ``share_intermediates`` all of them are.
    """
    name = fn.__name__

    def build(m: RetailModel, write: bool) -> DataFrame:
        cache = m.__dict__.setdefault("_memo", {})
        if name not in cache or (write and not cache[name][1]):
            plan = cache[name][0] if name in cache else fn(m)
            cache[name] = (m.keep(write_and_reload(plan, name)) if write else plan, write)
        return cache[name][0]

    def wrapper(m: RetailModel) -> DataFrame:
        return build(m, m.share_intermediates)
    wrapper.__name__ = name
    wrapper.written = lambda m: build(m, True)
    return wrapper


# ---- the roll-up lattice ------------------------------------------------------
@memo
def store_states(m):
    return rollup.by_store(m.last90)


@memo
def day_states(m):
    return rollup.by_day(m.last90)


register("rollup_by_store")(store_states)
register("rollup_by_day")(day_states)
register("qa_region_sanity")(lambda m: rollup.qa_region_sanity(store_states(m)))
register("qa_age_mix")(lambda m: rollup.qa_age_mix(day_states(m)))


# ---- C: KPI core ---------------------------------------------------------
@memo
def store_kpis(m):
    return rollup.store_kpis(store_states(m))


@memo
def stores_vs_region(m):
    stores = store_kpis.written(m)
    return kpi.stores_vs_region(stores, kpi.region_bench(stores), m.params, m.dim_rows["regions"])


@memo
def regional_kpis(m):
    return rollup.regional_kpis(store_states(m))


@memo
def income_vs_aov(m):
    return kpi.income_vs_aov(rollup.aov_by_region(store_states(m)), m.regions, m.params,
                             m.dim_rows["regions"])


@memo
def quarter_kpis(m):
    return kpi.quarter_kpis(m.quarter)


register("exec_kpi")(lambda m: rollup.exec_kpi(store_states(m)))
register("regional_kpis")(regional_kpis)
register("store_kpis")(store_kpis)
register("region_bench")(lambda m: kpi.region_bench(store_kpis(m)))
register("stores_vs_region")(stores_vs_region)
register("weekday_seasonality")(lambda m: rollup.weekday_seasonality(day_states(m)))
register("daily_trend")(lambda m: rollup.daily_trend(day_states(m)))
register("weekly_trend")(lambda m: rollup.weekly_trend(day_states(m)))
register("quarter_kpis")(quarter_kpis)
@memo
def quarter_league(m):
    return kpi.quarter_league(quarter_kpis.written(m), m.params)


register("quarter_league")(quarter_league)
register("lifecycle_kpis")(lambda m: rollup.lifecycle_kpis(day_states(m)))
register("aov_by_region")(lambda m: rollup.aov_by_region(store_states(m)))
register("income_vs_aov")(income_vs_aov)
register("income_aov_regression")(lambda m: kpi.income_aov_regression(income_vs_aov(m)))
register("top5_regions")(lambda m: kpi.top_regions(regional_kpis(m), m.params.top_regions))
register("bottom5_regions")(lambda m: kpi.bottom_regions(regional_kpis(m), m.params.top_regions))
register("top20_stores")(lambda m: kpi.top_stores(stores_vs_region(m), m.params.top_stores))
register("bottom20_stores")(lambda m: kpi.bottom_stores(stores_vs_region(m), m.params.top_stores))


@memo
def day_sketches(m):
    return sketches.day_sketches(m.flagged)


@register("sketch_rank_errors")
def sketch_rank_errors(m: RetailModel) -> DataFrame:
    """B3's opt-in sketches: by region and quantile, rows and whether the merged days' estimate keeps its rank error."""
    probs = {"p01_rev": m.params.winsor_lo, "p50_rev": 0.5, "p99_rev": m.params.winsor_hi}
    near = sketches.thresholds(day_sketches.written(m), ["region"], probs)
    errors = sketches.rank_errors(m.flagged, near, ["region"], probs)
    return errors.select("region", "name", (F.col("error") <= sketches.RANK_ERROR).alias("within"))


# ---- D: regional drivers ---------------------------------------------------
@memo
def region_agg(m):
    return rollup.region_agg(store_states(m))


@memo
def network_bench(m):
    return rollup.network_bench(store_states(m))


@memo
def region_income_bins(m):
    return regional.region_income_bins(region_agg.written(m), m.params)


@memo
def population_bins(m):
    return regional.population_bins(region_agg.written(m), m.params)


register("region_agg")(region_agg)
register("network_bench")(network_bench)
register("region_income_bins")(region_income_bins)
register("income_aov_stats")(lambda m: regional.income_aov_stats(region_agg(m)))
register("revenue_decomposition")(
    lambda m: regional.revenue_decomposition(region_agg.written(m), network_bench(m)))
register("income_quintile_summary")(
    lambda m: regional.income_quintile_summary(region_income_bins(m)))
register("population_bins")(population_bins)
register("population_tercile_summary")(
    lambda m: regional.population_tercile_summary(population_bins(m)))


# ---- E: lifecycle ------------------------------------------------------------
@memo
def store_weeks(m):
    return lifecycle.store_weeks(m.clean_alltime, m.params)


@memo
def store_last90(m):
    return rollup.store_kpis(store_states(m), ("rev90", "tx90", "aov90"))


@memo
def network_medians(m):
    return lifecycle.network_medians(store_last90.written(m), m.params)


@memo
def ttb_flagged(m):
    return lifecycle.ttb_flagged(store_weeks(m), network_medians(m), m.params)


@memo
def time_to_benchmark(m):
    return lifecycle.time_to_benchmark(ttb_flagged(m))


@memo
def ttb_flagged_weekly(m):
    return lifecycle.ttb_flagged(store_weeks(m), network_medians(m), m.params.with_(weekly_benchmark=True))


@memo
def time_to_benchmark_weekly(m):
    return lifecycle.time_to_benchmark(ttb_flagged_weekly(m))


register("store_weeks")(store_weeks)
register("store_last90")(store_last90)
register("network_medians")(network_medians)
register("ttb_flagged")(ttb_flagged)
register("time_to_benchmark")(time_to_benchmark)
register("time_to_benchmark_weekly")(time_to_benchmark_weekly)
@memo
def ramp_states(m):
    return lifecycle.ramp_states(store_weeks(m))


register("cohort_ramp")(lambda m: lifecycle.ramp(ramp_states(m), "cohort_month"))
register("regional_ramp")(lambda m: lifecycle.ramp(ramp_states(m), "region"))
register("cohort_region_ramp")(lambda m: lifecycle.ramp(ramp_states(m), "cohort_month", "region"))
register("network_ramp")(lambda m: lifecycle.ramp(ramp_states(m)))
register("ttb_region_summary")(
    lambda m: lifecycle.ttb_summary(time_to_benchmark.written(m), "region", m.params))
register("ttb_cohort_summary")(
    lambda m: lifecycle.ttb_summary(time_to_benchmark.written(m), "cohort_month", m.params))
register("ttb_region_summary_weekly")(
    lambda m: lifecycle.ttb_summary(time_to_benchmark_weekly.written(m), "region", m.params))
register("ttb_cohort_summary_weekly")(
    lambda m: lifecycle.ttb_summary(time_to_benchmark_weekly.written(m), "cohort_month", m.params))
register("ttb_flagged_weekly")(ttb_flagged_weekly)


# ---- F: league and risk ------------------------------------------------------
@memo
def store_totals90(m):
    return rollup.store_kpis(store_states(m), risk.TOTALS)


@memo
def store_z(m):
    totals = store_totals90.written(m)
    return risk.store_z(totals, risk.region_stats(totals), m.params, m.dim_rows["regions"])


@memo
def store_league(m):
    return risk.store_league(store_z.written(m), m.params)


@memo
def store_risk(m):
    return risk.store_risk(store_league(m), m.params)


@memo
def watchlist_full(m):
    return risk.watchlist(store_risk(m), m.params)


@memo
def store_result(m):
    return risk.store_result(watchlist_full(m))


register("region_stats")(lambda m: risk.region_stats(store_totals90(m)))
register("store_z")(store_z)
register("store_league")(store_league)
register("store_risk")(store_risk)
register("watchlist")(store_result)
register("region_risk_summary")(
    lambda m: risk.region_risk_summary(watchlist_full.written(m), m.params))
register("region_leaders_top10")(
    lambda m: risk.region_leaders(store_result(m), m.params.board_size))
register("region_watchlist_top10")(
    lambda m: risk.region_watch_board(store_result(m), m.params.board_size))


@register("region_boards")
def region_boards(m: RetailModel) -> DataFrame:
    """F11's nested boards: a row for each region with both boards as JSON arrays."""
    return risk.region_boards(watchlist_full.written(m), m.params.board_size)


# ---- G: README summaries -----------------------------------------------------
@memo
def new_store_sums(m):
    return summaries.new_store_horizons(m.clean_alltime, m.params)


@memo
def new_store_horizons(m):
    return summaries.with_complete(new_store_sums.written(m), m.params)


@memo
def aov_counts(m):
    return summaries.aov_counts(m.last90)


register("aov_distribution")(lambda m: summaries.aov_distribution(aov_counts.written(m), m.params))
register("aov_histogram")(lambda m: summaries.aov_histogram(aov_counts.written(m), m.params))
register("income_aov_fit")(lambda m: summaries.income_aov_fit(
    income_vs_aov.written(m), kpi.income_aov_regression(income_vs_aov.written(m))))
register("below_peer_heatmap")(lambda m: summaries.below_peer_heatmap(store_z(m)))
register("new_store_30_60_90")(new_store_horizons)
register("new_store_benchmarks")(
    lambda m: summaries.new_store_benchmarks(new_store_horizons.written(m), m.params))


def register_views(m: RetailModel) -> None:
    """B12 + E10: the core views and the optional lifecycle views as temp views,
    so the results can also be queried with ``spark.sql``."""
    from ..operators import views
    m.register()
    views.register_views({
        "v_store_weeks": store_weeks(m),
        "v_cohort_ramp": lifecycle.cohort_ramp(store_weeks(m)),
        "v_regional_ramp": lifecycle.regional_ramp(store_weeks(m)),
        "v_time_to_benchmark": time_to_benchmark(m),
    })


@register("sql_cohorts")
def sql_cohorts(m: RetailModel) -> DataFrame:
    """SQL over the lifecycle views."""
    register_views(m)
    return m.sales.sparkSession.sql("""
        SELECT cohort_month, COUNT(*) AS weeks, MAX(stores_active) AS most_active, stores
        FROM v_cohort_ramp JOIN (SELECT cohort_month, COUNT(*) AS stores FROM v_time_to_benchmark
                                 GROUP BY cohort_month) USING (cohort_month)
        GROUP BY cohort_month, stores""")
