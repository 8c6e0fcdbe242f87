"""League, risk score and watchlist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.measures import mean, money_avg, safe_div
from ..functions.stats import clamp, z_score
from .joins import attach
from .percentiles import group_percentiles
from .ranking import add_ntiles, desc_first, top_k_per_group

TOTALS = ("revenue90", "tx90", "aov90")


def region_stats(totals: DataFrame) -> DataFrame:
    """region mean and population sd of the three store KPIs."""
    return totals.groupBy("region").agg(
        money_avg("revenue90").alias("avg_rev_reg"), F.stddev_pop("revenue90").alias("sd_rev_reg"),
        F.avg("tx90").alias("avg_tx_reg"), F.stddev_pop("tx90").alias("sd_tx_reg"),
        mean("aov90").alias("avg_aov_reg"), F.stddev_pop("aov90").alias("sd_aov_reg"))


def store_z(totals: DataFrame, stats: DataFrame, params: Params = Params(),
            region_rows: int | None = None) -> DataFrame:
    """F2: store z-scores against region peers; NULL when the sd is 0."""
    j = attach(totals, stats, ["region"], max_rows=params.broadcast_max_rows,
               known_rows=region_rows)
    return j.select("store_id", "region", *TOTALS,
                    z_score("revenue90", "avg_rev_reg", "sd_rev_reg").alias("z_rev"),
                    z_score("tx90", "avg_tx_reg", "sd_tx_reg").alias("z_tx"),
                    z_score("aov90", "avg_aov_reg", "sd_aov_reg").alias("z_aov"))


def store_league(z: DataFrame, params: Params = Params()) -> DataFrame:
    """quartiles and deciles within region (DESC, NULLs first; store_id breaks ties)."""
    rev, aov, tx = (desc_first(c, "store_id") for c in ("revenue90", "aov90", "tx90"))
    return add_ntiles(z, ["region"], {"q_rev_in_region": (4, rev), "d_rev_in_region": (10, rev),
                                      "q_aov_in_region": (4, aov), "q_tx_in_region": (4, tx)})


def store_risk(league: DataFrame, params: Params = Params()) -> DataFrame:
    """F4 + F5: clamp z (NULL → 0) to ±clamp, weighted raw risk, logistic score 0..100
    rounded to one decimal (4.7 … 95.3 with the default clamp)."""
    c = params.z_clamp
    w_rev, w_tx, w_aov = params.weights
    clamped = league.select(
        "*", *[clamp(F.coalesce(F.col(z), F.lit(0.0)), -c, c).alias(f"{z}_c")
               for z in ("z_rev", "z_tx", "z_aov")])
    raw = (F.lit(w_rev) * (-F.col("z_rev_c")) + F.lit(w_tx) * (-F.col("z_tx_c"))
           + F.lit(w_aov) * (-F.col("z_aov_c")))
    with_raw = clamped.withColumn("raw_risk", raw)
    score = F.round(F.lit(100.0) * (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("raw_risk")))), 1)
    return with_raw.withColumn("risk_score", score)


def watchlist(risk: DataFrame, params: Params = Params()) -> DataFrame:
    """(score >= cut AND bottom revenue quartile) OR (z_tx and z_aov both below the
    weak cut), on unclamped z with NULL → 0 and the rounded score (T16)."""
    weak = params.weak_z_cut
    rule = (((F.col("risk_score") >= params.risk_cut)
             & (F.col("q_rev_in_region") == params.risk_quartile))
            | ((F.coalesce(F.col("z_tx"), F.lit(0.0)) < weak)
               & (F.coalesce(F.col("z_aov"), F.lit(0.0)) < weak)))
    return risk.withColumn("is_watchlist", F.when(rule, 1).otherwise(0))


def region_risk_summary(wl: DataFrame, params: Params = Params()) -> DataFrame:
    """stores, mean score, watchlist count and share, revenue p10/p90 and their ratio."""
    j = group_percentiles(
        wl, ["region"], "revenue90", {"p10_rev": 0.1, "p90_rev": 0.9},
        extra_aggs=[F.count(F.lit(1)).alias("stores"),
                    money_avg("risk_score").alias("avg_risk_score"),
                    F.sum("is_watchlist").cast("bigint").alias("at_risk_cnt")])
    return j.select("region", "stores", "avg_risk_score", "at_risk_cnt",
                    (F.lit(100.0) * safe_div(F.col("at_risk_cnt"), F.col("stores"))).alias("at_risk_pct"),
                    "p10_rev", "p90_rev",
                    safe_div(F.col("p90_rev"), F.col("p10_rev")).alias("dispersion_ratio"))


STORE_RESULT = ["region", "store_id", "revenue90", "tx90", "aov90", "q_rev_in_region",
                "q_tx_in_region", "q_aov_in_region", "z_rev", "z_tx", "z_aov", "risk_score",
                "is_watchlist"]


def store_result(wl: DataFrame) -> DataFrame:
    """F8: the published per-store table (drops deciles, raw risk, clamped z)."""
    return wl.select(*STORE_RESULT)


LEADER_COLS = ["store_id", "revenue90", "tx90", "aov90", "risk_score"]
WATCH_COLS = LEADER_COLS + ["q_rev_in_region", "z_rev", "z_tx", "z_aov"]


def region_leaders(result: DataFrame, k: int = 10) -> DataFrame:
    """top k stores per region by revenue90 (DESC, NULLs first), numbered."""
    order = [F.col("revenue90").desc_nulls_first(), F.col("store_id")]
    return top_k_per_group(result, ["region"], order, k).select("region", "rank", *LEADER_COLS)


def _board_json(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(region, name): a region's ranked rows, at most the board's size, as one JSON array in order of rank."""
    fields = [F.round(F.col(c).cast("decimal(38,10)"), 6).cast("decimal(38,6)").alias(c) if t == "double" else F.col(c)
              for c, t in rows.dtypes if c in ("rank", *columns)]
    array = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("row"))))
    return rows.groupBy("region").agg(F.to_json(F.transform(array, lambda r: r["row"]), {"ignoreNullFields": "false"}).alias(name))


def region_boards(result: DataFrame, k: int = 10) -> DataFrame:
    """F9 and F10 nested in a row for each region, as in the reference's report.

    Boards are cut to k rows in each task and again in the window, so the
    arrays that are gathered have at most k rows.
    """
    leaders = _board_json(region_leaders(result, k), LEADER_COLS, "leaders")
    watch = _board_json(region_watch_board(result, k), WATCH_COLS, "watchlist")
    watch = watch.withColumnRenamed("region", "_region")
    return leaders.join(watch, F.col("region").eqNullSafe(F.col("_region"))).select("region", "leaders", "watchlist")


def region_watch_board(result: DataFrame, k: int = 10) -> DataFrame:
    """top k stores per region by risk_score; does not filter is_watchlist.
    Ties of the rounded score go to the lower revenue, then store_id."""
    order = [F.col("risk_score").desc_nulls_first(), F.col("revenue90").asc_nulls_last(),
             F.col("store_id")]
    return top_k_per_group(result, ["region"], order, k).select("region", "rank", *WATCH_COLS)
