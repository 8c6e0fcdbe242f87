"""Approximate revenue thresholds from stored sketches (the opt-in form of B3).

A KLL sketch of each region-day's revenue is a few kilobytes and merges: the
thresholds of a week, a quarter or a region come from the stored day sketches
without reading the sales again.  The error is in rank: with k = 800 an
estimated quantile lies within about half a percent of the wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches, and the rank error they keep (normalised, at 99 % confidence).
K, RANK_ERROR = 800, 0.005


def day_sketches(flagged: DataFrame) -> DataFrame:
    """(region, date, rows, sketch): what is stored; rows without revenue are in no sketch."""
    return flagged.where(F.col("revenue").isNotNull()).groupBy("region", "date").agg(
        F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double(F.col("revenue").cast("double"), F.lit(K)).alias("sketch"))


def thresholds(sketches: DataFrame, keys: list[str | Column], probs: dict[str, float]) -> DataFrame:
    """Approximate quantiles by any grouping of the stored days (``region``, a week of ``date``, ...)."""
    merged = sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("_all"))
    return merged.select("*", *[F.kll_sketch_get_quantile_double("_all", F.lit(float(p))).alias(n) for n, p in probs.items()]).drop("_all")


def rank_errors(flagged: DataFrame, approximate: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """(keys, name, error): how far the rank of each approximate quantile is from the wanted one, as a share of the rows.

    A quantile stands for all ranks of its value, so the error is the distance
    to the nearest of them.
    """
    want = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p"), F.col(n).alias("q"))
                               for n, p in probs.items()])).alias("w")
    points = approximate.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "rows", want).select("*", "w.*").drop("w")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    values = flagged.where(F.col("revenue").isNotNull()).groupBy(*keys, "revenue").agg(F.count(F.lit(1)).alias("c"))
    seen = values.join(points, same).groupBy(*keys, "name", "p", "rows").agg(
        F.sum(F.when(F.col("revenue") < F.col("q"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("revenue") <= F.col("q"), F.col("c")).otherwise(0)).alias("upto"))
    target = F.col("p") * F.col("rows")
    off = F.greatest(F.col("below") - target, target - F.col("upto"), F.lit(0.0))
    return seen.select(*keys, "name", (off / F.col("rows")).alias("error"))
