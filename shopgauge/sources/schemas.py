"""Typed schemas of the three raw tables and the staged tables."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

REGIONS = T.StructType([
    T.StructField("region", T.StringType(), False),
    T.StructField("population", T.LongType(), True),
    T.StructField("avg_income", MONEY, True),
])

STORES = T.StructType([
    T.StructField("store_id", T.LongType(), False),
    T.StructField("city", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("opening_date", T.DateType(), True),
])

SALES = T.StructType([
    T.StructField("store_id", T.LongType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("revenue", MONEY, True),
    T.StructField("transactions", T.LongType(), True),
])

RAW = {"regions": REGIONS, "stores": STORES, "sales": SALES}

FLAG_COLUMNS = ["flag_tx0_revpos", "flag_tx_negative", "flag_rev_nonpos_txpos", "flag_date_null"]

FLAGGED_COLUMNS = ["store_id", "date", "revenue", "transactions", "region", "opening_date",
                   "population", "avg_income", *FLAG_COLUMNS]

CLEANED_COLUMNS = ["store_id", "date", "region", "opening_date", "population", "avg_income",
                   "transactions", "revenue_capped", *FLAG_COLUMNS, "keep_core"]

ENRICHED_COLUMNS = ["store_id", "date", "region", "opening_date", "population", "avg_income",
                    "transactions", "revenue", "keep_core", *FLAG_COLUMNS, "aov",
                    "store_age_days", "store_age_bucket", "rev_per_capita"]
