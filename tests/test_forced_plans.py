"""The model under other plans, checked against the oracle.

* lazy: without a written table, each query cleans for itself;
* no broadcasts: every join of a detail table with an aggregate or a
  dimension becomes a shuffle join.
"""

import pytest

from compare import digest, duck  # noqa: E402  (tools/ is on the path via conftest)

from shopgauge.config import Params
from shopgauge.plans import bundles, catalog  # noqa: F401
from shopgauge.plans.oracle import all_sql
from shopgauge.plans.registry import QUERIES, comparable
from shopgauge.plans.stages import RetailModel
from shopgauge.sources import tpch_adapter

SF = "/root/testdata/sf0.001"
SQL = all_sql()
LAZY = ["rev_thresholds", "sales_dedup", "exec_kpi", "quarter_league", "watchlist", "ttb_region_summary", "aov_distribution",
        "new_store_benchmarks", "population_bins", "kpi_bundle", "risk_bundle", "driver_bundle", "lifecycle_bundle"]
NO_BCAST = ["sales_enriched", "stores_vs_region", "store_z", "income_vs_aov", "region_risk_summary",
            "ttb_region_summary", "watchlist", "region_leaders_top10"]


def _check(m, con, name):
    df = comparable(QUERIES[name](m))
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert len(rows) == len(orows)
    assert digest(rows, df.columns) == digest(orows, ocols)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", LAZY)
def test_unmaterialized_queries_match_oracle(spark, con, name):
    _check(RetailModel.from_testdata(spark, SF), con, name)


def _jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_query_over_the_window_builds_with_two_jobs(spark):
    def build():
        return QUERIES["exec_kpi"](RetailModel.from_testdata(spark, SF))
    assert _jobs(spark, "build-exec", build)[1] <= 2


@pytest.mark.parametrize("name", [*bundles.BUNDLES])
def test_bundles_read_few_tables(spark, name):
    df = QUERIES[name](RetailModel.from_testdata(spark, SF))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Relation [") <= 14


@pytest.mark.parametrize("name", NO_BCAST)
def test_shuffle_joins_match_oracle(spark, con, name):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        m = RetailModel.from_testdata(spark, SF, Params(as_of=tpch_adapter.AS_OF, broadcast_max_rows=0))
        _check(m, con, name)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["sales_enriched", "weekly_trend", "store_weeks", "new_store_30_60_90"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        _check(RetailModel.from_testdata(spark, SF), con, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
