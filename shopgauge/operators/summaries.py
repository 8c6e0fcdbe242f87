"""README deliverables with no SQL in the reference, as Spark summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.dates import days_between
from ..functions.measures import money_sum, ratio_of_sums, row_aov
from .percentiles import group_percentiles

DIST_PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def aov_counts(base: DataFrame) -> DataFrame:
    """G1: (region, aov, rows): the row-level AOVs and how often each occurs; what both summaries need of the facts."""
    return base.groupBy("region", row_aov().alias("aov")).agg(F.count(F.lit(1)).alias("rows"))


def aov_distribution(counts: DataFrame, params: Params = Params()) -> DataFrame:
    """G1: row-level AOV per region: n, mean, population sd and five exact percentiles, from ``aov_counts``."""
    n = F.sum(F.when(F.col("aov").isNotNull(), F.col("rows")).otherwise(0))
    total = F.sum(F.col("aov") * F.col("rows"))
    centre = counts.groupBy("region").agg(n.alias("n"), F.try_divide(total, n.cast("double")).alias("mean_aov"))
    centre = centre.select(F.col("region").alias("_region"), "n", "mean_aov")
    spread = (counts.join(centre, F.col("region").eqNullSafe(F.col("_region"))).groupBy("region", "n", "mean_aov")
              .agg(F.sum(F.col("rows") * (F.col("aov") - F.col("mean_aov")) ** 2).alias("_square"))
              .select(F.col("region").alias("_region"), "n", "mean_aov",
                      F.sqrt(F.try_divide(F.col("_square"), F.col("n").cast("double"))).alias("sd_aov")))
    points = group_percentiles(counts, ["region"], "aov", DIST_PROBS, weight="rows")
    return points.join(spread, F.col("region").eqNullSafe(F.col("_region"))).select("region", "n", "mean_aov", "sd_aov", *DIST_PROBS)


def aov_histogram(counts: DataFrame, params: Params = Params()) -> DataFrame:
    """G1: fixed-width AOV histogram per region over the network-wide AOV range, from ``aov_counts``.

    Bin b (1..bins) covers [lo + (b-1)w, lo + b*w); the maximum falls in
    the last bin.  The range is a one-row global aggregate.
    """
    bins = params.histogram_bins
    rows = counts.where(F.col("aov").isNotNull())
    rng = rows.agg(F.min("aov").alias("_lo"), F.max("aov").alias("_hi"))
    j = rows.crossJoin(F.broadcast(rng))
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((F.col("aov") - F.col("_lo")) / width * bins) + 1,
                                  F.lit(bins))).otherwise(F.lit(1)).cast("int")
    return (j.groupBy("region", b.alias("bin"), "_lo", "_hi").agg(F.sum("rows").alias("rows"))
            .select("region", "bin",
                    (F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / bins)
                    .alias("bin_lo"),
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins)
                    .alias("bin_hi"),
                    "rows"))


def income_aov_fit(iva: DataFrame, reg: DataFrame) -> DataFrame:
    """Scatter rows of C13 with the fitted line of C14 and the residual."""
    j = iva.crossJoin(F.broadcast(reg.select("slope", "intercept")))  # C14 is one row
    fitted = F.col("intercept") + F.col("slope") * F.col("avg_income")
    return j.select("region", "avg_income", "avg_aov", fitted.alias("fitted_aov"),
                    (F.col("avg_aov") - fitted).alias("residual"))


def below_peer_heatmap(z: DataFrame) -> DataFrame:
    """Per region, % of stores below the peer average per KPI (NULL z = not below)."""
    def pct(c):
        return F.avg(F.when(F.col(c) < 0, 100.0).otherwise(0.0))
    return z.groupBy("region").agg(F.count(F.lit(1)).alias("stores"),
                                   pct("z_rev").alias("pct_rev_below"),
                                   pct("z_tx").alias("pct_tx_below"),
                                   pct("z_aov").alias("pct_aov_below"))


def new_store_horizons(clean: DataFrame, params: Params = Params()) -> DataFrame:
    """Per store, cumulative revenue, transactions and aov over the first k days
    after opening (day 0 = opening day) for every horizon k.

    ``complete_dK`` is 1 when those k days lie inside the observed history
    (first sale date .. as-of), i.e. the store is comparable at that horizon.
    """
    days = days_between("date", "opening_date")
    # the facts are read once: sums and the first day by store, and then the first day of all
    aggs = []
    for k in params.horizons:
        inside = (days >= 0) & (days < k)
        rev = money_sum(F.when(inside, F.col("revenue")))
        tx = F.sum(F.when(inside, F.col("transactions")))
        aggs += [rev.alias(f"rev_d{k}"), tx.cast("bigint").alias(f"tx_d{k}"),
                 ratio_of_sums(rev, tx).alias(f"aov_d{k}")]
    return clean.groupBy("store_id", "region", "opening_date").agg(
        *aggs, F.min("date").alias("_first"), F.count_if(days >= 0).alias("_open_days"))


def with_complete(horizons: DataFrame, params: Params = Params()) -> DataFrame:
    """The stores with sales since opening, and whether each horizon lies in the observed history."""
    first = horizons.agg(F.min("_first").alias("_start"))  # one row
    j = horizons.where(F.col("_open_days") > 0).crossJoin(F.broadcast(first))
    out = []
    for k in params.horizons:
        complete = ((F.col("opening_date") >= F.col("_start"))
                    & (F.date_add(F.col("opening_date"), k - 1) <= F.lit(params.as_of)))
        out += [f"rev_d{k}", f"tx_d{k}", f"aov_d{k}", F.when(complete, 1).otherwise(0).alias(f"complete_d{k}")]
    return j.select("store_id", "region", "opening_date", *out)


def new_store_benchmarks(horizons: DataFrame, params: Params = Params()) -> DataFrame:
    """Network medians at each horizon over the stores observed for the whole horizon."""
    seen = [F.struct(F.lit(k).alias("horizon_days"), F.col(f"rev_d{k}").alias("rev"), F.col(f"tx_d{k}").cast("double").alias("tx"),
                     F.col(f"aov_d{k}").alias("aov"), (F.col(f"complete_d{k}") == 1).alias("complete")) for k in params.horizons]
    long = horizons.select(F.explode(F.array(*seen)).alias("h")).select("h.*").where("complete").drop("complete")
    return group_percentiles(
        long, ["horizon_days"], specs=[(c, {f"median_{c}": 0.5}) for c in ("rev", "tx", "aov")],
        extra_aggs=[F.count(F.lit(1)).alias("stores")]).select(
        "horizon_days", "stores", "median_rev", "median_tx", "median_aov")
