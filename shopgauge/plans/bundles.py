"""The scripts' closing JSON bundles (C17, D9, E11, F11) as JSON lines.

The reference folds each script's result tables into one row of JSON arrays.
Some of those tables have a row for each store, week or cohort, so folding
them takes one task for the whole chain.  Here a bundle is a table of
(section, json): one line of JSON for each row of each section, made where
the row is.  Sections have any number of rows, an empty one has none, and NULL
fields are written as null.  Lines carry the fields that arrays are ordered by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import QUERIES, comparable, register
from .stages import RetailModel

#: Sections of each bundle: name of the section -> registered query that has its rows.
BUNDLES = {
    "kpi_bundle": {
        "exec_kpi": "exec_kpi", "top5_regions_by_aov": "top5_regions", "bottom5_regions_by_aov": "bottom5_regions",
        "top20_stores_vs_region_rev": "top20_stores", "bottom20_stores_vs_region_rev": "bottom20_stores",
        "weekday_seasonality": "weekday_seasonality", "daily_trend": "daily_trend", "weekly_trend": "weekly_trend",
        "store_league": "quarter_league", "lifecycle_kpis": "lifecycle_kpis",
        "income_aov_regression": "income_aov_regression"},
    "driver_bundle": {
        "regions_percap_incomebins": "region_income_bins", "income_aov_regression": "income_aov_stats",
        "regional_revenue_decomposition": "revenue_decomposition",
        "income_quintile_summary": "income_quintile_summary",
        "population_tercile_summary": "population_tercile_summary"},
    "lifecycle_bundle": {
        "network_benchmarks": "network_medians", "cohort_ramp_curves": "cohort_ramp",
        "regional_ramp_curves": "regional_ramp", "store_time_to_benchmark": "time_to_benchmark",
        "ttb_region_summary": "ttb_region_summary", "ttb_cohort_summary": "ttb_cohort_summary"},
    "risk_bundle": {
        "store_league_risk": "watchlist", "region_risk_summary": "region_risk_summary",
        "region_leaders": "region_leaders_top10", "region_watchlist": "region_watchlist_top10"},
}
#: Amounts in JSON have six decimals.
AMOUNT = "decimal(38,6)"


def json_lines(df: DataFrame, section: str) -> DataFrame:
    """(section, json): each row of df as one line of JSON."""
    fields = [F.col(f.name).cast(AMOUNT).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
              for f in comparable(df).schema.fields]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return comparable(df).select(F.lit(section).alias("section"), line.alias("json"))


def bundle(m: RetailModel, name: str) -> DataFrame:
    """All sections of one bundle, from shared written intermediates: facts are cleaned once and then rolled up.

    Store-weeks need the whole history, so its bundle writes all of ``sales_enriched``.
    """
    shared = m.sharing(whole_history=name == "lifecycle_bundle")
    return reduce(DataFrame.unionAll, [json_lines(QUERIES[q](shared), s) for s, q in BUNDLES[name].items()])


for _name in BUNDLES:
    register(_name)(lambda m, name=_name: bundle(m, name))
