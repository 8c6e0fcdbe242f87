"""Hand-written fixtures with expected results (FIXTURES.md #1-#46)."""

import decimal
from datetime import date

import pytest
from pyspark.sql import functions as F

from shopgauge.config import Params
from shopgauge.operators import checks, cleaning, kpi, lifecycle, regional, risk, views
from shopgauge.plans import bundles
from shopgauge.sources import schemas

D = date.fromisoformat


def regions(spark, rows=(("North", 1000, 2000.0),)):
    return spark.createDataFrame([(r, p, None if i is None else decimal.Decimal(str(i)))
                                  for r, p, i in rows], schemas.REGIONS)


def stores(spark, rows=((1, "c", "North", D("2020-01-01")),)):
    return spark.createDataFrame(list(rows), schemas.STORES)


def sales(spark, rows):
    return spark.createDataFrame(
        [(s, d, None if r is None else decimal.Decimal(str(r)), t) for s, d, r, t in rows],
        schemas.SALES)


def flagged(spark, rows, **kw):
    return cleaning.sales_flagged(sales(spark, rows), stores(spark, **kw), regions(spark))


# ---- A: checks ----------------------------------------------------------------
def test_checks_clean_tables_one_row_each(spark):
    s = stores(spark)
    r = regions(spark)
    sa = sales(spark, [(1, D("2024-01-01"), 5, 1)])
    assert checks.check_missing_region(s, r).collect()[0]["cnt"] == 0
    assert checks.check_duplicate_store_date(sa).collect()[0]["rows_affected"] == 0
    rows = {r["issue"]: r["cnt"] for r in checks.check_unique(s, ["store_id"]).collect()}
    assert rows == {"DUPLICATE_KEY": 0, "NULL_KEY": 0}


def test_missing_region_counts_unknown_and_null(spark):
    s = stores(spark, [(1, "a", "North", None), (2, "b", "Nowhere", None), (3, "c", None, None)])
    assert checks.check_missing_region(s, regions(spark)).first()["cnt"] == 2


def test_duplicate_store_date_counts_keys(spark):
    d = D("2024-01-01")
    sa = sales(spark, [(1, d, 1, 1), (1, d, 2, 1), (1, d, 3, 1), (2, d, 1, 1)])
    assert checks.check_duplicate_store_date(sa).first()["rows_affected"] == 1


# ---- B: flags, thresholds, dedupe, derive -----------------------------------
@pytest.mark.parametrize("rev,tx,date_,flags,core", [
    (5, 0, D("2024-01-01"), (1, 0, 0, 0), 0),
    (5, -1, D("2024-01-01"), (0, 1, 0, 0), 0),
    (0, 3, D("2024-01-01"), (0, 0, 1, 0), 1),
    (-5, 3, D("2024-01-01"), (0, 0, 1, 0), 1),
    (5, 3, None, (0, 0, 0, 1), 0),
    (5, None, D("2024-01-01"), (0, 0, 0, 0), 1),
    (None, 3, D("2024-01-01"), (0, 0, 0, 0), 1),
])
def test_flags_and_core(spark, rev, tx, date_, flags, core):
    f = flagged(spark, [(1, date_, rev, tx)])
    c = f.select(*schemas.FLAG_COLUMNS, cleaning.core_rule().alias("k")).first()
    assert tuple(c[x] for x in schemas.FLAG_COLUMNS) == flags and c["k"] == core


def _clean(spark, rows, params=Params()):
    f = flagged(spark, rows)
    return cleaning.sales_cleaned(f, cleaning.rev_thresholds(f, params), params)


def test_thresholds_and_capping(spark):
    d = D("2024-01-01")
    th = cleaning.rev_thresholds(flagged(spark, [(1, d, 10, 1), (1, d, 20, 1), (1, d, 30, 1)])).first()
    assert th["p01_rev"] == pytest.approx(10.2) and th["p99_rev"] == pytest.approx(29.8)
    got = sorted(r["revenue_capped"] for r in _clean(spark, [(1, d, 10, 1), (1, d, 20, 1),
                                                            (1, d, 30, 1)]).collect())
    assert got == pytest.approx([10.2, 20.0, 29.8])


def test_capping_edges(spark):
    d = D("2024-01-01")
    one = _clean(spark, [(1, d, 17, 1)]).first()["revenue_capped"]
    assert one == 17
    nul = _clean(spark, [(1, d, None, 1), (1, d, 5, 1), (1, d, 7, 1)]).collect()
    assert sorted([r["revenue_capped"] for r in nul], key=lambda x: (x is not None, x))[0] is None
    big = _clean(spark, [(1, None, 1e9, 1), (1, None, 1, 1), (1, None, 2, 1)]).collect()
    assert max(r["revenue_capped"] for r in big) == 1e9


def _dedup(spark, rows):
    return cleaning.sales_dedup(_clean(spark, rows)).collect()


def test_dedupe_keeps_best(spark):
    d = D("2024-01-01")
    assert [r["transactions"] for r in _dedup(spark, [(1, d, 100, 5), (1, d, 100, 7)])] == [7]
    r = _dedup(spark, [(1, d, 100, 5), (1, d, None, 1)])
    assert len(r) == 1 and r[0]["revenue_capped"] is None  # T4: NULL sorts first on DESC
    r = _dedup(spark, [(1, d, 100, 0), (1, d, 50, 2)])
    assert len(r) == 1 and r[0]["keep_core"] == 0  # T5
    r = _dedup(spark, [(1, None, 1, 1), (1, None, 2, 1), (1, None, 3, 1)])
    assert len(r) == 1 and r[0]["rn"] == 1  # T6


def test_derive_age_and_buckets(spark):
    days = ["2023-12-31", "2024-01-01", "2024-06-28", "2024-06-29", "2024-12-30", "2024-12-31",
            "2025-12-30", "2025-12-31"]
    rows = [(1, D(x), 10, 1) for x in days] + [(1, None, 10, 1)]
    st = [(1, "c", "North", D("2024-01-01"))]
    f = cleaning.sales_flagged(sales(spark, rows), stores(spark, st), regions(spark))
    th = cleaning.rev_thresholds(f)
    e = cleaning.derive(cleaning.sales_dedup(cleaning.sales_cleaned(f, th)).drop("rn"))
    got = {r["date"]: (r["store_age_days"], r["store_age_bucket"]) for r in e.collect()}
    exp_age = [0, 0, 179, 180, 364, 365, 729, 730]
    exp_b = ["pre-open", "0-6m", "0-6m", "6-12m", "6-12m", "1-2y", "1-2y", "2y+"]
    for x, a, b in zip(days, exp_age, exp_b):
        assert got[D(x)] == (a, b)
    assert got[None] == (0, "2y+")


def test_derive_null_ratios(spark):
    rows = [(1, D("2024-01-01"), 10, 0)]
    f = cleaning.sales_flagged(sales(spark, rows), stores(spark), regions(spark, [("North", 0, 1.0)]))
    e = cleaning.derive(cleaning.sales_dedup(cleaning.sales_cleaned(f, cleaning.rev_thresholds(f)))
                        .drop("rn")).first()
    assert e["aov"] is None and e["rev_per_capita"] is None


def test_last90_window_open_and_closed(spark):
    p = Params(as_of=D("2024-03-31"))
    rows = [(1, D(x), 10, 1) for x in ("2023-12-31", "2024-01-01", "2024-01-02", "2024-04-15")]
    f = flagged(spark, rows)
    e = cleaning.derive(cleaning.sales_dedup(cleaning.sales_cleaned(f, cleaning.rev_thresholds(f)))
                        .drop("rn"))
    open_ = {r["date"] for r in views.sales_last90(e, p).collect()}
    assert open_ == {D("2024-01-01"), D("2024-01-02"), D("2024-04-15")}
    closed = {r["date"] for r in views.sales_last90(e, p.with_(closed_window=True)).collect()}
    assert closed == {D("2024-01-01"), D("2024-01-02")}


def test_excluded_share_empty_is_null(spark):
    empty = spark.createDataFrame([], "keep_core int")
    assert checks.qa_excluded_share(empty).first()["excluded_share"] is None


# ---- C / D: KPI and regional ----------------------------------------------------
def _base(spark, rows, cols="store_id long, region string, date date, revenue double, "
                            "transactions long, population long"):
    return spark.createDataFrame(rows, cols)


def test_aov_of_sums_null_when_no_positive_tx(spark):
    b = _base(spark, [(1, "N", D("2024-01-01"), 10.0, 0, 1), (2, "S", D("2024-01-01"), 10.0, -2, 1)])
    assert all(r["aov"] is None for r in kpi.regional_kpis(b).collect())


def test_peer_z_and_single_store_region(spark):
    b = _base(spark, [(1, "N", D("2024-01-01"), 10.0, 1, 1), (2, "N", D("2024-01-01"), 20.0, 1, 1),
                      (3, "N", D("2024-01-01"), 30.0, 1, 1), (4, "S", D("2024-01-01"), 5.0, 1, 1)])
    sk = kpi.store_kpis(b)
    svr = {r["store_id"]: r for r in kpi.stores_vs_region(sk, kpi.region_bench(sk)).collect()}
    assert [svr[i]["z_rev_vs_region"] for i in (1, 2, 3)] == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert svr[4]["z_rev_vs_region"] is None
    t = lifecycle.store_totals(b, risk.TOTALS)
    sc = risk.store_risk(risk.store_league(risk.store_z(t, risk.region_stats(t))))
    assert {r["store_id"]: r["risk_score"] for r in sc.collect()}[4] == 50.0


def test_weekday_and_week(spark):
    b = _base(spark, [(1, "N", D("2024-01-07"), 1.0, 1, 1), (1, "N", D("2024-01-08"), 1.0, 1, 1)])
    assert sorted(r["weekday"] for r in kpi.weekday_seasonality(b).collect()) == [1, 7]
    assert sorted(r["week"] for r in kpi.weekly_trend(b).collect()) == [D("2024-01-01"), D("2024-01-08")]


def test_quartile_null_aov_first(spark):
    qk = spark.createDataFrame([(1, "N", 10.0, 1, None), (2, "N", 20.0, 2, 10.0), (3, "N", 5.0, 1, 5.0)],
                               "store_id long, region string, q_rev double, q_tx long, q_aov double")
    got = {r["store_id"]: r["quartile_by_aov"] for r in kpi.quarter_league(qk).collect()}
    assert got[1] == 1


def test_regression_and_constant_income(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (4.0, 3.5), (3.0, None)], "x double, y double")
    r = kpi.regression(df, "y", "x").first()
    assert r["n_regions"] == 4
    assert r["corr"] == pytest.approx(0.928571, abs=1e-6)
    assert r["slope"] == pytest.approx(0.464286, abs=1e-6)
    assert r["intercept"] == pytest.approx(1.75, abs=1e-6)
    c = kpi.regression(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "y", "x").first()
    assert c["corr"] is None and c["slope"] is None and c["intercept"] is None
    one = kpi.regression(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "y", "x").first()
    assert one["corr"] is None and one["slope"] is None


def test_top_bottom_null_z_last(spark):
    svr = spark.createDataFrame([(1, "N", 1.0, None, 0.0), (2, "N", 2.0, 1.0, 0.0), (3, "N", 3.0, -1.0, 0.0)],
                                "store_id long, region string, revenue double, z_rev_vs_region double, "
                                "gap_rev_vs_region double")
    assert [r["store_id"] for r in kpi.top_stores(svr).collect()] == [2, 3, 1]
    assert [r["store_id"] for r in kpi.bottom_stores(svr).collect()] == [3, 2, 1]


def test_ntile_sizes_over_regions(spark):
    ra = spark.createDataFrame([(f"R{i:02d}", float(i), float(i)) for i in range(12)],
                               "region string, avg_income double, population double")
    ra = ra.withColumn("revenue", F.lit(1.0)).withColumn("transactions", F.lit(1)) \
           .withColumn("aov", F.lit(1.0))
    q = [r["income_quintile"] for r in regional.region_income_bins(ra).collect()]
    assert sorted(q.count(i) for i in range(1, 6)) == [2, 2, 2, 3, 3]
    assert [q.count(i) for i in range(1, 6)] == [3, 3, 2, 2, 2]
    t = [r["population_tercile"] for r in regional.population_bins(ra).collect()]
    assert [t.count(i) for i in range(1, 4)] == [4, 4, 4]


def test_decomposition(spark):
    ra = spark.createDataFrame([("A", 100.0, 10, 10.0), ("B", 600.0, 30, 20.0)],
                               "region string, revenue double, transactions long, aov double")
    nb = spark.createDataFrame([(700.0, 40, 17.5)], "net_revenue double, net_transactions long, net_aov double")
    got = {r["region"]: r for r in regional.revenue_decomposition(ra, nb).collect()}
    a, b = got["A"], got["B"]
    assert (a["aov_component"], a["tx_component"], a["cross_component"], a["gap_vs_equal_share"]) == \
        pytest.approx((-300, -525, 225, -250))
    assert (b["aov_component"], b["tx_component"], b["cross_component"], b["gap_vs_equal_share"]) == \
        pytest.approx((100, -175, -25, 250))
    for r, tot in ((a, -600), (b, -100)):
        assert r["aov_component"] + r["tx_component"] + r["cross_component"] == pytest.approx(tot)


# ---- E: lifecycle --------------------------------------------------------------
def _clean_view(spark, rows, opening=D("2024-01-03")):
    return spark.createDataFrame([(1, "N", opening, d, r, t) for d, r, t in rows],
                                 "store_id long, region string, opening_date date, date date, "
                                 "revenue double, transactions long")


def test_store_weeks_split_at_monday(spark):
    sw = lifecycle.store_weeks(_clean_view(spark, [(D("2024-01-07"), 1.0, 1), (D("2024-01-08"), 1.0, 1)]))
    got = sorted((r["weeks_since_open"], r["week"]) for r in sw.collect())
    assert got == [(0, D("2024-01-01")), (0, D("2024-01-08"))]


def test_preopen_only_store_absent(spark):
    sw = lifecycle.store_weeks(_clean_view(spark, [(D("2024-01-01"), 1.0, 1)]))
    assert sw.count() == 0


def test_ttb_first_week_and_never(spark):
    fl = spark.createDataFrame(
        [(1, "N", D("2024-01-01"), w, 1.0, 1, m) for w, m in ((1, 0), (3, 1), (5, 1))]
        + [(2, "N", D("2024-01-01"), 0, 1.0, 1, 0)],
        "store_id long, region string, cohort_month date, weeks_since_open int, week_aov double, "
        "week_tx long, meets_benchmark int")
    ttb = {r["store_id"]: r["weeks_to_benchmark"] for r in lifecycle.time_to_benchmark(fl).collect()}
    assert ttb == {1: 3, 2: None}
    s = lifecycle.ttb_summary(lifecycle.time_to_benchmark(fl), "region").first()
    assert (s["stores_hit_bench"], s["stores_total"], s["avg_weeks_to_bench"], s["p50_weeks_to_bench"]) == \
        (1, 2, 3.0, 3.0)


# ---- F: league and risk ---------------------------------------------------------
def test_quartiles_and_deciles_of_four_stores(spark):
    z = spark.createDataFrame([(i, "N", float(100 - i), 1, 1.0, 0.0, 0.0, 0.0) for i in range(4)],
                              "store_id long, region string, revenue90 double, tx90 long, aov90 double, "
                              "z_rev double, z_tx double, z_aov double")
    got = sorted((r["q_rev_in_region"], r["d_rev_in_region"]) for r in risk.store_league(z).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4)]


def _score(spark, zr, zt, za, q=1):
    df = spark.createDataFrame([(1, "N", 1.0, 1, 1.0, zr, zt, za, q)],
                               "store_id long, region string, revenue90 double, tx90 long, aov90 double, "
                               "z_rev double, z_tx double, z_aov double, q_rev_in_region int")
    return risk.watchlist(risk.store_risk(df)).first()


@pytest.mark.parametrize("z,score", [(0.0, 50.0), (-3.0, 95.3), (-9.0, 95.3), (3.0, 4.7)])
def test_risk_score_range(spark, z, score):
    assert _score(spark, z, z, z)["risk_score"] == score


def test_risk_weights_and_watchlist_rules(spark):
    r = _score(spark, -2.0, -1.0, 0.0, 3)
    assert r["raw_risk"] == pytest.approx(1.3) and r["risk_score"] == 78.6 and r["is_watchlist"] == 0
    assert _score(spark, -2.0, -1.0, 0.0, 4)["is_watchlist"] == 1
    assert _score(spark, 0.5, -0.6, -0.6, 1)["is_watchlist"] == 1   # broad weakness (T16)
    assert _score(spark, 0.0, -0.5, -0.6, 1)["is_watchlist"] == 0   # strict <


def test_dispersion_null_when_p10_zero(spark):
    wl = spark.createDataFrame([(1, "N", 0.0, 50.0, 0), (2, "N", 0.0, 50.0, 0)],
                               "store_id long, region string, revenue90 double, risk_score double, "
                               "is_watchlist int")
    assert risk.region_risk_summary(wl).first()["dispersion_ratio"] is None


def test_watch_board_ignores_flag(spark):
    res = spark.createDataFrame([(i, "N", 1.0, 1, 1.0, 1, 0.0, 0.0, 0.0, 10.0 + i, 0) for i in range(12)],
                                "store_id long, region string, revenue90 double, tx90 long, aov90 double, "
                                "q_rev_in_region int, z_rev double, z_tx double, z_aov double, "
                                "risk_score double, is_watchlist int")
    rows = risk.region_watch_board(res).collect()
    assert len(rows) == 10 and rows[0]["rank"] in range(1, 11)
    assert {r["store_id"] for r in rows} == set(range(2, 12))


# ---- bundles --------------------------------------------------------------------
def test_json_lines_keep_null_fields_and_empty_sections(spark):
    empty = spark.createDataFrame([], "a long, b string")
    assert bundles.json_lines(empty, "x").count() == 0
    some = spark.createDataFrame([(1, None, 0.5), (0, "z", None)], "a long, b string, c double")
    got = {r["json"] for r in bundles.json_lines(some, "x").collect()}
    assert got == {'{"a":1,"b":null,"c":0.500000}', '{"a":0,"b":"z","c":null}'}


def test_percentile_of_mostly_null_values(spark):
    from shopgauge.operators.percentiles import group_percentiles
    rows = [(i, float(i) if i % 10 == 0 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, v double")
    none = spark.createDataFrame([(1, None), (2, None)], "k long, v double")
    assert [r["m"] for r in group_percentiles(df, [], "v", {"m": 0.5}).collect()] == [45.0]
    assert [r["m"] for r in group_percentiles(none, [], "v", {"m": 0.5}).collect()] == [None]


def test_means_are_plain_averages(spark):
    from shopgauge.functions.measures import mean
    df = spark.createDataFrame([(1 / 3,), (2 / 3,), (None,)], "x double")
    assert df.agg(mean("x").alias("m")).first()["m"] == 0.5
    big = spark.createDataFrame([(2e10,), (4e10,)], "x double")
    assert big.agg(mean("x").alias("m")).first()["m"] == 3e10


# ---- opt-in fixes of the reference traps ------------------------------------------
def test_prefer_core_keeps_the_good_row(spark):
    d = D("2024-01-01")
    f = flagged(spark, [(1, d, 100, 0), (1, d, 50, 2)])
    p = Params(prefer_core=True)
    r = cleaning.sales_dedup(cleaning.sales_cleaned(f, cleaning.rev_thresholds(f, p), p), p).collect()
    assert len(r) == 1 and r[0]["keep_core"] == 1 and r[0]["transactions"] == 2  # T5 fixed


def test_thresholds_on_core_only(spark):
    d = D("2024-01-01")
    rows = [(1, d, 10, 1), (1, d, 20, 1), (1, d, 30, 1), (1, d, 1000, 0)]
    f = flagged(spark, rows)
    ref = cleaning.rev_thresholds(f).first()
    fix = cleaning.rev_thresholds(f, Params(thresholds_on_core_only=True)).first()
    assert fix["p99_rev"] == pytest.approx(29.8) and ref["p99_rev"] > 29.8  # T3


def test_whole_weeks_groups_across_monday(spark):
    cv = _clean_view(spark, [(D("2024-01-07"), 1.0, 1), (D("2024-01-08"), 2.0, 1)])
    sw = lifecycle.store_weeks(cv, Params(whole_weeks=True)).collect()
    assert len(sw) == 1 and sw[0]["week_revenue"] == 3.0 and sw[0]["week"] == D("2024-01-01")  # T11


def test_weekly_benchmark_scales_tx_median(spark):
    weeks = spark.createDataFrame([(1, "N", D("2024-01-01"), 0, 10.0, 10)],
                                  "store_id long, region string, cohort_month date, weeks_since_open int, "
                                  "week_aov double, week_tx long")
    med = spark.createDataFrame([(5.0, 91.0)], "median_aov90_store double, median_tx90_store double")
    assert lifecycle.ttb_flagged(weeks, med).first()["meets_benchmark"] == 0
    assert lifecycle.ttb_flagged(weeks, med, Params(weekly_benchmark=True)).first()["meets_benchmark"] == 1


def test_risk_weights_are_parameters(spark):
    df = spark.createDataFrame([(1, "N", 1.0, 1, 1.0, -1.0, 0.0, 0.0, 1)],
                               "store_id long, region string, revenue90 double, tx90 long, aov90 double, "
                               "z_rev double, z_tx double, z_aov double, q_rev_in_region int")
    r = risk.store_risk(df, Params(weights=(1.0, 0.0, 0.0))).first()
    assert r["raw_risk"] == pytest.approx(1.0) and r["risk_score"] == 73.1


def test_raw_revenue_kept_for_anomaly_view(spark):
    from shopgauge.plans.stages import RetailModel
    d = D("2024-01-01")
    rows = [(1, d, 10, 1), (1, d, 20, 1), (1, d, 30, 1), (1, D("2024-01-02"), -5, 3)]
    m = RetailModel(regions(spark), stores(spark), sales(spark, rows),
                    Params(as_of=D("2024-01-31"), keep_raw_revenue=True))
    an = m.anomalies.collect()
    assert len(an) == 1 and an[0]["revenue_raw"] == -5.0 and an[0]["flag_rev_nonpos_txpos"] == 1
    assert "revenue_raw" in m.enriched_view.columns


def test_check_unique_counts_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (3,), (3,), (3,)], "k long")
    got = {r["issue"]: r["cnt"] for r in checks.check_unique(df, ["k"]).collect()}
    assert got == {"DUPLICATE_KEY": 2, "NULL_KEY": 2}
