"""Named queries: query name → function of a ``RetailModel``.

``queries()`` builds a fresh model over a TESTDATA folder for each call
and normalises the output types the same way the DuckDB oracle does
(integers → BIGINT, doubles/decimals rounded half up to 6 decimals), so results
compare value by value across engines.  Rounding goes over ten decimals: a
mean of few-decimal amounts often is an exact half, which the last bit of a
sum would else tip either way.  Values beyond the decimal type (from 1e28 on,
infinite, NaN) have no sixth decimal and stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks
from ..sources import files, schemas
from .stages import RetailModel

QUERIES: dict[str, Callable[[RetailModel], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[RetailModel], DataFrame]):
        QUERIES[name] = fn
        return fn
    return deco


def comparable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            x = c.cast("double")
            c = F.coalesce(F.round(x.try_cast("decimal(38,10)"), 6).cast("double"), x) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import bundles, catalog  # noqa: F401  (register the queries)

    def bind(fn):
        return lambda spark, sf_dir: comparable(fn(RetailModel.from_testdata(spark, sf_dir)))

    return {name: bind(fn) for name, fn in QUERIES.items()}


# ---- A: validation ------------------------------------------------------
register("check_unique_store")(lambda m: checks.check_unique(m.stores, ["store_id"]))
register("check_unique_region")(lambda m: checks.check_unique(m.regions, ["region"]))
register("check_missing_region")(lambda m: checks.check_missing_region(m.stores, m.regions))
register("check_duplicate_store_date")(lambda m: checks.check_duplicate_store_date(m.sales))
register("check_date_span")(lambda m: checks.check_date_span(m.sales))
register("orphan_sales")(lambda m: checks.orphan_sales(m.sales, m.stores))
# the same checks where they find something: store-days as key, regions of above-average income, stores of over a year
register("check_unique_store_day")(lambda m: checks.check_unique(m.sales, ["store_id", "date"]))
register("check_missing_region_income")(lambda m: checks.check_missing_region(m.stores, m.regions.join(
    F.broadcast(m.regions.agg(F.avg("avg_income").alias("mean_income"))), F.col("avg_income") >= F.col("mean_income"))))
register("orphan_sales_year")(lambda m: checks.orphan_sales(
    m.sales, m.stores.where(F.col("opening_date") <= F.date_sub(F.lit(m.params.as_of), 365))))


@register("load_sales_csv")
def load_sales_csv(m: RetailModel) -> DataFrame:
    """A1 on CSV lines of the sales table; a NULL date is written as a word, which does not parse."""
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in (
        F.col("store_id"), F.coalesce(F.col("date").cast("string"), F.lit("unknown")),
        F.col("revenue").cast(schemas.MONEY), F.col("transactions"))]
    lines = m.sales.select(F.concat_ws(",", *fields).alias("value"))
    return checks.unreadable_rows(files.parse_csv(lines, schemas.SALES), ["store_id"])

# ---- B: cleaning and views -----------------------------------------------
register("sales_flagged")(lambda m: m.flagged)
register("rev_thresholds")(lambda m: m.thresholds)
register("sales_cleaned")(lambda m: m.cleaned)
register("sales_dedup")(lambda m: m.dedup)
register("sales_enriched")(lambda m: m.enriched_view)


@register("sales_refreshed")
def sales_refreshed(m: RetailModel) -> DataFrame:
    """A2 in parts: a table built without a third of the last 60 days' and of the undated sales, which then arrive."""
    last = (F.col("date") >= F.date_sub(F.lit(m.params.as_of), 60)) | F.col("date").isNull()
    late = F.coalesce(last & (F.pmod(F.xxhash64("store_id", "date", "revenue"), F.lit(3)) == 0), F.lit(False))
    first = RetailModel(m.regions, m.stores, m.sales.where(~late), m.params, bounds=m.bounds)
    first.materialize()
    first.refresh(m.sales.where(late))
    return first.enriched_view


register("v_sales_last90")(lambda m: m.last90)
register("v_sales_clean_alltime")(lambda m: m.clean_alltime)
register("v_sales_anomalies")(lambda m: m.anomalies)
register("qa_excluded_share")(lambda m: checks.qa_excluded_share(m.enriched_view))


def register_functions(m: RetailModel) -> None:
    """B9 and C9 as SQL table functions with an as-of date, over the model's cleaned sales."""
    m.enriched_view.createOrReplaceTempView("sales_enriched")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.enriched_view.schema)
    starts = {"sales_last90": f"date_sub(as_of, {m.params.window_days})", "sales_quarter": "trunc(as_of, 'quarter')"}
    for name, start in starts.items():
        m.sales.sparkSession.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION {name}(as_of DATE) RETURNS TABLE({columns})
            RETURN SELECT * FROM sales_enriched WHERE date >= {start} AND keep_core = 1""")


@register("sql_last90")
def sql_last90(m: RetailModel) -> DataFrame:
    """B9 as of a date given in SQL."""
    register_functions(m)
    return m.sales.sparkSession.sql(f"SELECT * FROM sales_last90(DATE '{m.params.as_of}')")


@register("sql_quarter_kpis")
def sql_quarter_kpis(m: RetailModel) -> DataFrame:
    """C9 as of a date given in SQL."""
    register_functions(m)
    return m.sales.sparkSession.sql(f"""
        SELECT store_id, region, CAST(SUM(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS q_rev, SUM(transactions) AS q_tx,
               CASE WHEN SUM(transactions) > 0
                    THEN CAST(SUM(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) / SUM(transactions) END AS q_aov
        FROM sales_quarter(DATE '{m.params.as_of}') GROUP BY store_id, region""")


@register("sql_region_months")
def sql_region_months(m: RetailModel) -> DataFrame:
    """SQL over the registered views."""
    m.register()
    return m.sales.sparkSession.sql("""
        SELECT region, CAST(TRUNC(date, 'MM') AS DATE) AS month, r.population, COUNT(*) AS store_days,
               COUNT(DISTINCT store_id) AS stores, SUM(transactions) AS transactions
        FROM v_sales_clean_alltime JOIN v_regions r USING (region) GROUP BY ALL""")
