"""Cleaning stages B1–B8: enrich, flag, winsorise, deduplicate, derive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AGE_BUCKET_ELSE, AGE_BUCKETS, Params
from ..functions.dates import days_between
from ..functions.measures import EXACT, flag, row_aov
from ..sources.schemas import CLEANED_COLUMNS, ENRICHED_COLUMNS, FLAG_COLUMNS
from .dedupe import keep_best
from .joins import attach, side
from .percentiles import group_percentiles


#: What a store's own row and its region's say.
STORE_FACTS = ["region", "opening_date", "population", "avg_income"]


def store_facts(stores: DataFrame, regions: DataFrame, params: Params = Params(), dim_rows: dict | None = None) -> DataFrame:
    """Stores of known regions with their region's facts; ``dim_rows`` has row bounds of the dimensions, where known."""
    rg = side(regions.select("region", "population", "avg_income"), params.broadcast_max_rows, (dim_rows or {}).get("regions"))
    return stores.select("store_id", "region", "opening_date").join(rg, "region").select("store_id", *STORE_FACTS)


def _with_facts(df: DataFrame, facts: DataFrame, params: Params, dim_rows: dict | None) -> DataFrame:
    return df.join(side(facts, params.broadcast_max_rows, (dim_rows or {}).get("stores")), "store_id")


def enrich(sales: DataFrame, stores: DataFrame, regions: DataFrame,
           params: Params = Params(), dim_rows: dict | None = None) -> DataFrame:
    """B1: sales × stores × regions, inner joins (unknown stores and regions drop out).

    ``dim_rows`` holds row bounds of the dimensions already proven by the caller.
    """
    return (_with_facts(sales, store_facts(stores, regions, params, dim_rows), params, dim_rows)
            .select("store_id", "date", F.col("revenue").cast("double").alias("revenue"),
                    "transactions", *STORE_FACTS))


def flag_anomalies(df: DataFrame) -> DataFrame:
    """B2: rules A (tx = 0, revenue > 0), B (tx < 0), C (tx > 0, revenue <= 0), D (no date)."""
    tx, rev = F.col("transactions"), F.col("revenue")
    return df.select(
        "*",
        flag((tx == 0) & (rev > 0)).alias("flag_tx0_revpos"),
        flag(tx < 0).alias("flag_tx_negative"),
        flag((tx > 0) & (rev <= 0)).alias("flag_rev_nonpos_txpos"),
        flag(F.col("date").isNull()).alias("flag_date_null"),
    )


def sales_flagged(sales: DataFrame, stores: DataFrame, regions: DataFrame,
                  params: Params = Params(), dim_rows: dict | None = None) -> DataFrame:
    """B1 + B2 (``stg.sales_flagged``)."""
    return flag_anomalies(enrich(sales, stores, regions, params, dim_rows))


def core_rule() -> F.Column:
    """keep_core = 0 for rules B, D and A; rule C rows stay in the core."""
    return (F.when(F.col("flag_tx_negative") == 1, 0)
            .when(F.col("flag_date_null") == 1, 0)
            .when(F.col("flag_tx0_revpos") == 1, 0)
            .otherwise(1))


def rev_thresholds(flagged: DataFrame, params: Params = Params()) -> DataFrame:
    """Exact interpolated p01 / p99 of revenue per (region, date), on all rows.

    With ``thresholds_on_core_only`` (T3 fix) only core rows feed them.
    """
    src = flagged
    if params.thresholds_on_core_only:
        src = flagged.where(core_rule() == 1)
    pct = group_percentiles(src, ["region", "date"], "revenue",
                            {"p01_rev": params.winsor_lo, "p99_rev": params.winsor_hi})
    return pct.select("region", "date", "p01_rev", "p99_rev")


def winsorize(rev: F.Column, lo: F.Column, hi: F.Column) -> F.Column:
    """Cap into [lo, hi] when a threshold exists; NULL revenue stays NULL."""
    return (F.when(lo.isNotNull() & (rev < lo), lo)
            .when(hi.isNotNull() & (rev > hi), hi)
            .otherwise(rev))


def sales_cleaned(flagged: DataFrame, thresholds: DataFrame, params: Params = Params(),
                  keep_raw: bool = False, threshold_rows: int | None = None) -> DataFrame:
    """B4 + B5 + B6 (``stg.sales_cleaned``).

    The thresholds table has one row per region-day; where ``threshold_rows``
    proves it small it is broadcast and the fact rows are not moved.  A
    NULL date never matches (SQL ``=``), so those rows stay uncapped.
    """
    j = attach(flagged, thresholds, ["region", "date"], "left", max_rows=params.broadcast_max_rows,
               known_rows=threshold_rows)
    capped = winsorize(F.col("revenue"), F.col("p01_rev"), F.col("p99_rev"))
    cols = [F.col(c) for c in CLEANED_COLUMNS if c not in ("revenue_capped", "keep_core")]
    raw = [F.col("revenue").alias("revenue_raw")] if keep_raw else []
    return j.select(*cols[:7], capped.alias("revenue_capped"), *cols[7:],
                    core_rule().alias("keep_core"), *raw)


#: The flags as bits of one number, in the order of FLAG_COLUMNS.
def _packed_flags() -> F.Column:
    bits = F.lit(0)
    for k, c in enumerate(FLAG_COLUMNS):
        bits = bits + F.col(c) * (1 << k)
    return bits.cast("int")


def sales_dedup(cleaned: DataFrame, params: Params = Params(), facts: DataFrame | None = None,
                dim_rows: dict | None = None) -> DataFrame:
    """One row per (store_id, date): highest revenue_capped, then transactions,
    both DESC NULLS FIRST as in PostgreSQL.  NULL dates of a store form one key.

    Remaining ties fall to keep_core (high first) and the flags (low
    first) so the survivor is deterministic.  ``prefer_core`` (T5 fix)
    ranks a core row above any anomaly of the same store-day.

    With ``facts`` (``store_facts``, one row per store) rows travel without
    what follows from their store, which is joined to the survivors.
    """
    kept = [c for c in cleaned.columns if c not in FLAG_COLUMNS and not (facts is not None and c in STORE_FACTS)]
    slim = cleaned.select(*kept, _packed_flags().alias("_flags"))
    order = [F.col("keep_core").desc()] if params.prefer_core else []
    order += [F.col("revenue_capped").desc_nulls_first(), F.col("transactions").desc_nulls_first(), F.col("keep_core").desc()]
    order += [F.col("_flags").bitwiseAND(F.lit(1 << k)).asc() for k in range(len(FLAG_COLUMNS))]
    best = keep_best(slim, ["store_id", "date"], order)
    for k, c in enumerate(FLAG_COLUMNS):
        best = best.withColumn(c, F.when(F.col("_flags").bitwiseAND(F.lit(1 << k)) > 0, 1).otherwise(0))
    if facts is not None:
        best = _with_facts(best, facts, params, dim_rows)
    return best.select(*cleaned.columns, "rn")


def age_bucket(days: F.Column) -> F.Column:
    expr = None
    for edge, label in AGE_BUCKETS:
        expr = F.when(days < edge, label) if expr is None else expr.when(days < edge, label)
    return expr.otherwise(AGE_BUCKET_ELSE)


def derive(dedup: DataFrame) -> DataFrame:
    """B8 (``stg.sales_enriched``): aov, store age (>= 0), age bucket, revenue per capita."""
    days = days_between("date", "opening_date")
    rev = F.col("revenue_capped")
    pop = F.col("population")
    return dedup.select(
        "store_id", "date", "region", "opening_date", "population", "avg_income",
        "transactions", rev.alias("revenue"), "keep_core", *FLAG_COLUMNS,
        row_aov(rev, "transactions").alias("aov"),
        F.greatest(days, F.lit(0)).alias("store_age_days"),
        age_bucket(days).alias("store_age_bucket"),
        F.when(pop > 0, rev / pop.cast("double")).alias("rev_per_capita"),
        *(["revenue_raw"] if "revenue_raw" in dedup.columns else []),
    ).select(*ENRICHED_COLUMNS, *(["revenue_raw"] if "revenue_raw" in dedup.columns else []))
