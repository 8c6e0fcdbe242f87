"""Retail tables derived from the TPC-H-like test tables.

The reference ships dimension CSVs but no sales facts, so regions,
stores and daily sales are derived from ``customer``, ``supplier``,
``nation``, ``region`` and ``lineitem``.  Every source row is kept: the
modulo rules below only inject anomalies (NULL dates, zero and negative
transactions, returns) deterministically; they never filter rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import balance
from .schemas import MONEY

# Fixed values of the adapter: stores open on 1998-05-08 plus
# (suppkey * 131) mod 1290 days; an order key divisible by 211 loses its
# date, by 97 gets zero transactions, else by 89 gets -1 transactions;
# a returned line ('R') of an order key divisible by 5 has negative
# revenue.  As-of date = last ship date.
OPENING_EPOCH = date(1998, 5, 8)
OPENING_STEP, OPENING_SPAN = 131, 1290
NULL_DATE_MOD, ZERO_TX_MOD, NEG_TX_MOD, RETURN_MOD = 211, 97, 89, 5
AS_OF = date(2001, 11, 4)


# The columns read, with the types the tables have (a stated schema needs no job to infer it).
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_nationkey int, c_acctbal double",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, "
                "l_returnflag string, l_shipdate timestamp_ntz",
}


def _read(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def dimension_bounds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables with at least as many rows as the derived dimensions: stores come from supplier rows, regions from region rows."""
    return {"stores": _read(spark, sf_dir, "supplier", ["s_suppkey"]), "regions": _read(spark, sf_dir, "region", ["r_regionkey"])}


def regions_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer", ["c_nationkey", "c_acctbal"])
    nation = _read(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = _read(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    # nation (25 rows) and region (5 rows) have a fixed size at every scale
    # factor, so broadcasting them is bounded by the table definition.
    geo = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return (customer.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("r_name").alias("region"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("population"),
                 F.floor(F.avg("c_acctbal")).cast(MONEY).alias("avg_income")))


def stores_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _read(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nation = _read(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = _read(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    days = ((F.col("s_suppkey") * OPENING_STEP) % OPENING_SPAN).cast("int")
    # supplier grows with the scale factor; the 25-row geography is the broadcast side
    return (supplier.join(F.broadcast(geo),
                          F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("s_suppkey").cast("bigint").alias("store_id"),
                    F.col("n_name").alias("city"),
                    F.col("r_name").alias("region"),
                    F.date_add(F.lit(OPENING_EPOCH), days).alias("opening_date")))


def sales_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = balance(_read(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_quantity",
                                                   "l_extendedprice", "l_discount", "l_returnflag",
                                                   "l_shipdate"]), "l_orderkey")
    ok = F.col("l_orderkey")
    # Exact money in integer cents: price (2 decimals) x (100 - discount
    # percent) is an exact count of 1/10000 units, rounded half away from
    # zero to cents -- the DECIMAL(18,2) value of price * (1 - discount) --
    # computed in 64-bit integers instead of wide decimals.  Revenue is
    # delivered as the DOUBLE of those cents (cleaning works in DOUBLE).
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    pct = F.floor(F.col("l_discount") * 100 + 0.5)
    units = cents * (F.lit(100) - pct)
    net_cents = F.when(units >= 0, F.floor((units + 50) / 100)).otherwise(-F.floor((50 - units) / 100))
    returned = (F.col("l_returnflag") == "R") & (ok % RETURN_MOD == 0)
    signed = F.when(returned, -net_cents).otherwise(net_cents)
    tx = (F.when(ok % ZERO_TX_MOD == 0, F.lit(0).cast("bigint"))
          .when(ok % NEG_TX_MOD == 0, F.lit(-1).cast("bigint"))
          .otherwise(F.col("l_quantity").cast("bigint")))
    return li.select(
        F.col("l_suppkey").cast("bigint").alias("store_id"),
        F.when(ok % NULL_DATE_MOD == 0, F.lit(None).cast("date"))
         .otherwise(F.col("l_shipdate").cast("date")).alias("date"),
        (signed / F.lit(100.0)).alias("revenue"),
        tx.alias("transactions"),
    )


def retail_tables(spark: SparkSession, sf_dir: str):
    """(regions, stores, sales) in the reference's raw schema."""
    return regions_from(spark, sf_dir), stores_from(spark, sf_dir), sales_from(spark, sf_dir)
