"""Partial refresh of the written table, deleting what was written, SQL functions, stored sketches."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shopgauge.config import Params
from shopgauge.operators import risk, sketches
from shopgauge.plans import catalog
from shopgauge.plans.registry import QUERIES, register_functions
from shopgauge.plans.stages import RetailModel, by_month, with_month
from shopgauge.sources import schemas

START = date(2024, 1, 1)


def tables(spark, n=1500, seed=1):
    rnd = random.Random(seed)
    regions = spark.createDataFrame([("N", 100, None), ("S", 0, None)], schemas.REGIONS)
    stores = spark.createDataFrame([(i, "c", "NS"[i % 2], START - timedelta(days=10 * i)) for i in range(20)], schemas.STORES)
    rows = [(rnd.randrange(22), None if rnd.random() < 0.02 else START + timedelta(days=rnd.randrange(120)),
             __import__("decimal").Decimal(rnd.randrange(-500, 90000)) / 100, rnd.choice([-1, 0, 1, 5, 9, None])) for _ in range(n)]
    return regions, stores, spark.createDataFrame(rows, schemas.SALES)


def files(m):
    """{month folder: files} of the written table."""
    out = {}
    for f in m._enriched.inputFiles():
        folder, name = f.rsplit("/", 2)[1:]
        out.setdefault(folder, set()).add(name)
    return out


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_refresh_equals_a_rebuild_and_replaces_touched_months_only(spark):
    regions, stores, sales = tables(spark)
    params = Params(as_of=date(2024, 4, 29))
    _, _, more = tables(spark, 60, 2)
    new = more.where((F.col("date") >= date(2024, 2, 5)) & (F.col("date") <= date(2024, 2, 25)))
    assert new.count() > 5
    m = RetailModel(regions, stores, sales, params)
    m.materialize()
    before = files(m)
    m.refresh(new)
    after = files(m)
    assert {k for k in after if after[k] != before.get(k)} == {"sale_month=2024-02-01"}
    full = RetailModel(regions, stores, sales.unionByName(new), params)
    assert rows_of(m.enriched_view) == rows_of(full.enriched_view)
    # undated sales and a day without any sale before
    last = more.where(F.col("date").isNull()).union(spark.createDataFrame([(3, date(2024, 9, 1), None, 2)], schemas.SALES))
    m.refresh(last)
    full = RetailModel(regions, stores, sales.unionByName(new).unionByName(last), params)
    assert rows_of(m.enriched_view) == rows_of(full.enriched_view)
    assert files(m)["sale_month=2024-02-01"] == after["sale_month=2024-02-01"]
    # nothing new, and sales of unknown stores, change nothing
    m.refresh(sales.limit(0))
    m.refresh(spark.createDataFrame([(999, date(2024, 1, 5), None, 2)], schemas.SALES))
    assert rows_of(m.enriched_view) == rows_of(full.enriched_view)
    assert QUERIES["exec_kpi"](m).first() == QUERIES["exec_kpi"](full).first()


def test_refresh_reads_the_whole_sales_once_and_layout_needs_no_sample(spark):
    regions, stores, sales = tables(spark)
    read = spark.sparkContext.accumulator(0)

    def seen(day):
        read.add(1)
        return day

    counted = sales.withColumn("date", F.udf(seen, "date").asNondeterministic()("date"))
    _, _, new = tables(spark, 60, 2)
    m = RetailModel(regions, stores, counted, Params(as_of=date(2024, 4, 29)))
    m.materialize()
    before = read.value
    m.refresh(new)
    assert read.value - before == 1500
    full = RetailModel(regions, stores, sales.unionByName(new), m.params)
    assert rows_of(m.enriched_view) == rows_of(full.enriched_view)
    # dealt by month from the sizes of the exchange; a range layout would run its input twice, to sample it
    plan = with_month(by_month(full.dedup))._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "rangepartitioning" not in plan
    # written a second time, the months stay in few files
    m.materialize()
    assert rows_of(m.enriched_view) == rows_of(full.enriched_view)


def test_refresh_needs_a_written_table(spark):
    regions, stores, sales = tables(spark, 10)
    with pytest.raises(ValueError):
        RetailModel(regions, stores, sales).refresh(sales)


def test_release_deletes_what_was_written(spark):
    m = RetailModel(*tables(spark, 200), Params(as_of=date(2024, 4, 29)))
    m.materialize()
    catalog.store_z.written(m)
    folders = {f.removeprefix("file://").split("/sales_enriched")[0] for f in m._enriched.inputFiles()}
    (base,) = folders
    mine = [d for d in os.listdir(base) if any(f"/{d}/" in f for t in m._written for f in t.inputFiles())]
    assert len(mine) >= 3
    others = set(os.listdir(base)) - set(mine)
    m.release()
    left = set(os.listdir(base))
    assert not left & set(mine) and others <= left
    assert QUERIES["exec_kpi"](m).count() == 1  # it can be used again


def test_sql_functions_take_any_date(spark):
    m = RetailModel(*tables(spark), Params(as_of=date(2024, 4, 29)))
    register_functions(m)
    for as_of in (date(2024, 4, 29), date(2024, 3, 2)):
        other = RetailModel(m.regions, m.stores, m.sales, Params(as_of=as_of))
        assert rows_of(spark.sql(f"SELECT * FROM sales_last90(DATE '{as_of}')")) == rows_of(other.last90)
        assert rows_of(spark.sql(f"SELECT * FROM sales_quarter(DATE '{as_of}')")) == rows_of(other.quarter)


def test_sketches_keep_their_rank_error(spark):
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else "b", START + timedelta(days=i % 40), rnd.choice([5.0, rnd.lognormvariate(3, 2), None])) for i in range(30_000)]
    flagged = spark.createDataFrame(rows, "region string, date date, revenue double")
    stored = sketches.day_sketches(flagged)
    assert stored.count() == 80
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.99}
    for keys, cols in ((["region"], ["region"]), (["region", "week"], ["region", F.weekofyear("date").alias("week")])):
        near = sketches.thresholds(stored, cols, probs)
        errors = sketches.rank_errors(flagged.withColumn("week", F.weekofyear("date")), near, keys, probs).collect()
        assert len(errors) == 3 * near.count()
        assert max(r.error for r in errors) <= sketches.RANK_ERROR


def test_boards_have_at_most_k_rows(spark):
    rows = [("r" if i else None, i, float(i % 7), i, 1.0, 50.0 + i % 3, 1, 0.1, None, 0.2) for i in range(40)]
    result = spark.createDataFrame(rows, "region string, store_id long, revenue90 double, tx90 long, aov90 double, risk_score double, "
                                         "q_rev_in_region int, z_rev double, z_tx double, z_aov double")
    got = {r.region: r for r in risk.region_boards(result, 3).collect()}
    assert got.keys() == {"r", None}
    assert got["r"].leaders.count('"store_id"') == 3 and got["r"].leaders.startswith('[{"rank":1,"store_id":6,"revenue90":6.000000')
    assert got[None].watchlist.count('"z_tx":null') == 1


def test_bucketed_table_needs_no_exchange_of_the_facts(spark):
    m = RetailModel(*tables(spark, 3000), Params(as_of=date(2024, 4, 29)))
    plain = RetailModel(m.regions, m.stores, m.sales, m.params)
    m.materialize_by_store(4)
    for name in ("store_weeks", "store_kpis", "rollup_by_store"):
        df = QUERIES[name](m)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, (name, plan)
        assert rows_of(df) == rows_of(QUERIES[name](plain))
    table = m._bucketed
    m.release()
    assert not spark.catalog.tableExists(table)
