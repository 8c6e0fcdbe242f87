"""The five reports of the reference, one function each.

A user of the reference runs five scripts in order: cleaning, KPI core,
regional drivers, store lifecycle, league and risk.  Each function here
returns the named result tables of one script (lazy DataFrames) plus its
one-row JSON bundle, so the same outputs can be shown, queried or written
with ``sources.files.export_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import checks, kpi, lifecycle, regional, risk, summaries
from . import bundles, catalog
from .stages import RetailModel


def cleaning_report(m: RetailModel) -> dict[str, DataFrame]:
    return {
        "check_unique_store": checks.check_unique(m.stores, ["store_id"]),
        "check_unique_region": checks.check_unique(m.regions, ["region"]),
        "check_missing_region": checks.check_missing_region(m.stores, m.regions),
        "check_duplicate_store_date": checks.check_duplicate_store_date(m.sales),
        "check_date_span": checks.check_date_span(m.sales),
        "sales_enriched": m.enriched_view,
        "v_sales_anomalies": m.anomalies,
        "qa_excluded_share": checks.qa_excluded_share(m.enriched_view),
        "qa_region_sanity": checks.qa_region_sanity(m.last90),
        "qa_age_mix": checks.qa_age_mix(m.last90),
    }


def kpi_report(m: RetailModel) -> dict[str, DataFrame]:
    b = m.last90
    return {
        "exec_kpi": kpi.exec_kpi(b),
        "regional_kpis": catalog.regional_kpis(m),
        "stores_vs_region": catalog.stores_vs_region(m),
        "weekday_seasonality": kpi.weekday_seasonality(b),
        "daily_trend": kpi.daily_trend(b),
        "weekly_trend": kpi.weekly_trend(b),
        "quarter_league": catalog.quarter_league(m),
        "lifecycle_kpis": kpi.lifecycle_kpis(b),
        "income_vs_aov": catalog.income_vs_aov(m),
        "income_aov_fit": summaries.income_aov_fit(
            catalog.income_vs_aov.written(m), kpi.income_aov_regression(catalog.income_vs_aov.written(m))),
        "aov_distribution": summaries.aov_distribution(catalog.aov_counts.written(m), m.params),
        "kpi_bundle": bundles.bundle(m, "kpi_bundle"),
    }


def regional_report(m: RetailModel) -> dict[str, DataFrame]:
    ra = catalog.region_agg(m)
    return {
        "region_income_bins": catalog.region_income_bins(m),
        "income_aov_stats": regional.income_aov_stats(ra),
        "revenue_decomposition": regional.revenue_decomposition(catalog.region_agg.written(m), catalog.network_bench(m)),
        "income_quintile_summary": regional.income_quintile_summary(catalog.region_income_bins(m)),
        "population_tercile_summary": regional.population_tercile_summary(
            catalog.population_bins(m)),
        "driver_bundle": bundles.bundle(m, "driver_bundle"),
    }


def lifecycle_report(m: RetailModel) -> dict[str, DataFrame]:
    ttb = catalog.time_to_benchmark.written(m)
    return {
        "store_weeks": catalog.store_weeks(m),
        "network_medians": catalog.network_medians(m),
        "time_to_benchmark": ttb,
        "cohort_ramp": lifecycle.cohort_ramp(catalog.store_weeks(m)),
        "regional_ramp": lifecycle.regional_ramp(catalog.store_weeks(m)),
        "ttb_region_summary": lifecycle.ttb_summary(ttb, "region", m.params),
        "ttb_cohort_summary": lifecycle.ttb_summary(ttb, "cohort_month", m.params),
        "new_store_30_60_90": catalog.new_store_horizons(m),
        "new_store_benchmarks": summaries.new_store_benchmarks(catalog.new_store_horizons.written(m),
                                                               m.params),
        "lifecycle_bundle": bundles.bundle(m, "lifecycle_bundle"),
    }


def risk_report(m: RetailModel) -> dict[str, DataFrame]:
    result = catalog.store_result(m)
    return {
        "store_league_risk": result,
        "region_risk_summary": risk.region_risk_summary(catalog.watchlist_full.written(m), m.params),
        "region_leaders_top10": risk.region_leaders(result, m.params.board_size),
        "region_watchlist_top10": risk.region_watch_board(result, m.params.board_size),
        "below_peer_heatmap": summaries.below_peer_heatmap(catalog.store_z(m)),
        "risk_bundle": bundles.bundle(m, "risk_bundle"),
    }


REPORTS = {"cleaning": cleaning_report, "kpi": kpi_report, "regional": regional_report,
           "lifecycle": lifecycle_report, "risk": risk_report}
