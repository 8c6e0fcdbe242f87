"""CSV source (A1), stage writes (A2), BI export (G6) and the streaming flagger."""

import os
import tempfile
from datetime import date

from pyspark.sql import functions as F

from shopgauge.config import Params
from shopgauge.plans.stages import RetailModel
from shopgauge.sources import files, tpch_adapter
from shopgauge.streaming import flagging


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_model_end_to_end(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    r = _write(d, "regions.csv", "region,population,avg_income\nNorth,885903,945\nCoastal,1000,2000\n")
    s = _write(d, "stores.csv", "store_id,city,region,opening_date\n"
                                "1001,South Sophialand (Coastal),Coastal,2022-02-11\n"
                                "1002,Northtown (North),North,2023-05-01\n")
    sa = _write(d, "sales.csv", "store_id,date,revenue,transactions\n"
                                "1001,2024-03-01,100.50,10\n1001,2024-03-01,90.00,9\n"
                                "1002,not-a-date,50.00,5\n1002,2024-03-02,0,3\n9999,2024-03-02,5,1\n")
    m = RetailModel.from_csv(spark, r, s, sa, Params(as_of=date(2024, 3, 31)))
    assert m.sales.schema["revenue"].dataType.simpleString() == "decimal(18,2)"
    fl = {(x["store_id"], x["date"]): x for x in m.flagged.collect()}
    assert fl[(1002, None)]["flag_date_null"] == 1          # bad date -> NULL -> rule D
    assert (9999, date(2024, 3, 2)) not in fl               # unknown store dropped (T22)
    last = m.last90.collect()
    assert sorted((x["store_id"], x["transactions"]) for x in last) == [(1001, 10), (1002, 3)]


def test_unreadable_lines_are_kept_and_counted(spark):
    from shopgauge.operators import checks
    from shopgauge.sources import schemas
    d = tempfile.mkdtemp(dir="/tmp")
    lines = ["1,2024-03-01,1.50,2", "1,soon,2.00,3", "x,2024-03-02,1,1", "2,,5,1", "2,2024-03-04,1,many"]
    p = _write(d, "sales.csv", "\n".join(["store_id,date,revenue,transactions", *lines]) + "\n")
    loaded = files.read_csv(spark, p, schemas.SALES, keep_unreadable=True)
    flight = files.parse_csv(spark.createDataFrame([(x,) for x in lines], "value string"), schemas.SALES)
    for df in (loaded, flight):
        got = {r["store_id"]: r for r in checks.unreadable_rows(df, ["store_id"]).collect()}
        assert {k: (r["loaded_rows"], r["unreadable_rows"]) for k, r in got.items()} == {1: (2, 1), None: (1, 1), 2: (2, 1)}
        assert got[1]["transactions"] == 5 and got[1]["last_date"] == date(2024, 3, 1)
        assert {r[files.CORRUPT] for r in df.collect()} == {None, lines[1], lines[2], lines[4]}


def test_stage_write_and_export(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    df = spark.range(5).withColumn("m", F.lit("2024-01"))
    files.write_stage(df, f"{d}/stage", ["m"])
    files.write_stage(df, f"{d}/stage", ["m"])  # idempotent overwrite
    assert spark.read.parquet(f"{d}/stage").count() == 5
    out = files.export_views({"a": df, "b": df.limit(2)}, f"{d}/bi")
    assert [spark.read.parquet(p).count() for p in out] == [5, 2]


def test_streaming_flags_match_batch(spark):
    sf = "/root/testdata/sf0.001"
    regions, stores, sales = tpch_adapter.retail_tables(spark, sf)
    src = tempfile.mkdtemp(dir="/tmp")
    # the stream reads raw-schema files derived from the given tables, in two arrivals
    sales = sales.withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))
    sales.where("store_id % 2 = 0").write.mode("append").parquet(src)
    sales.where("store_id % 2 = 1").write.mode("append").parquet(src)
    # history is replayed out of date order, so the watermark must cover all of it
    stream = flagging.flag_stream(flagging.read_sales_stream(spark, src, max_files_per_trigger=4),
                                  stores, regions, watermark="36500 days")
    q = stream.writeStream.format("memory").queryName("flagged_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("flagged_stream")
    batch = RetailModel(regions, stores, sales).flagged
    exp_dated = batch.where("date IS NOT NULL").dropDuplicates(
        ["store_id", "date", "revenue", "transactions"]).count()
    assert got.where("date IS NOT NULL").count() == exp_dated
    assert got.where("date IS NULL").count() == batch.where("date IS NULL").count()
    assert got.where("keep_core = 0").count() > 0


def test_registered_views_are_queryable(spark):
    from shopgauge.plans import catalog
    m = RetailModel.from_testdata(spark, "/root/testdata/sf0.001")
    catalog.register_views(m)
    n = spark.sql("SELECT COUNT(*) AS n FROM v_sales_last90 WHERE keep_core = 1").first()["n"]
    assert n == m.last90.count()
    for v in ("v_stores", "v_regions", "v_sales_clean_alltime", "v_sales_anomalies",
              "v_store_weeks", "v_cohort_ramp", "v_regional_ramp", "v_time_to_benchmark"):
        assert spark.sql(f"SELECT COUNT(*) FROM {v}").first()[0] >= 0


def test_every_query_runs_on_empty_sales(spark):
    from shopgauge.plans import bundles, catalog  # noqa: F401
    from shopgauge.plans.registry import QUERIES
    d = tempfile.mkdtemp(dir="/tmp")
    r = _write(d, "regions.csv", "region,population,avg_income\nNorth,10,5\n")
    s = _write(d, "stores.csv", "store_id,city,region,opening_date\n1,a,North,2024-01-01\n")
    sa = _write(d, "sales.csv", "store_id,date,revenue,transactions\n")
    m = RetailModel.from_csv(spark, r, s, sa, Params(as_of=date(2024, 3, 31)))
    for name, fn in QUERIES.items():
        rows = fn(m).collect()
        assert isinstance(rows, list), name
    sections = {r["section"] for r in QUERIES["kpi_bundle"](m).collect()}
    assert sections == {"exec_kpi", "income_aov_regression"}  # tables of one row, whatever the input


def test_cli_writes_every_report_table(spark):
    from shopgauge import cli
    from shopgauge.plans.reports import REPORTS
    out = tempfile.mkdtemp(dir="/tmp")
    written = cli.main(["--testdata", "/root/testdata/sf0.001", "--out", out])
    assert len(written) == 44 and len(REPORTS) == 5  # 10 + 12 + 6 + 10 + 6 tables
    names = {p.split(out + "/", 1)[1] for p in written}
    assert {"kpi/kpi_bundle", "risk/store_league_risk", "lifecycle/ttb_region_summary",
            "regional/revenue_decomposition", "cleaning/sales_enriched"} <= names
    assert spark.read.parquet(f"{out}/kpi/kpi_bundle").select("section").distinct().count() == 11
    assert spark.read.parquet(f"{out}/risk/store_league_risk").count() == \
        spark.read.parquet(f"{out}/risk/region_risk_summary").agg({"stores": "sum"}).first()[0]


def test_tune_for_scale_sizes_partitions(spark):
    from shopgauge.session import tune_for_scale
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        s = tune_for_scale(spark, 100 * 2**40)          # 100 TB
        s = tune_for_scale(spark, 1 * 2**40)            # 1 TB
        assert int(s["spark.sql.shuffle.partitions"]) == 4097
        s = tune_for_scale(spark, 10 * 2**20)           # 10 MB: never fewer than the cores
        assert int(s["spark.sql.shuffle.partitions"]) == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
