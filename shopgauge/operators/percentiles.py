"""Exact PERCENTILE_CONT per group, in one plan that holds for groups of any size.

1. Values are counted by (group, bucket, value); equal values combine on the
   map side, so neither a hot group nor a hot value gathers.
2. Counts by (group, bucket) are far fewer (see ``buckets``).  A window over
   them tells in which bucket each wanted order statistic lies, and how many
   values of the group lie before that bucket.
3. The value counts of just those buckets are numbered in a window by
   (group, bucket), a thousandth of a doubling of the value, and the order
   statistics are read off.

Nothing is decided by a size and no job runs while the plan is built.  The
exchange of the value counts serves both uses, so the detail is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import LAST, bucket


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys; ``b`` has them with a leading _r_."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"_r_{k}"])
    return cond


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in keys else F.col(f"`{c}`") for c in df.columns])


def group_percentiles(df: DataFrame, keys: list[str], value: str | Column | None = None,
                      probs: dict[str, float] | None = None, *,
                      specs: list[tuple[str | Column, dict[str, float]]] | None = None,
                      weight: str | None = None, extra_aggs: list[Column] = ()) -> DataFrame:
    """One row per group of ``df`` (groups whose values are all NULL included)
    with ``PERCENTILE_CONT(p) WITHIN GROUP (ORDER BY value)`` per ``name -> p``.

    ``specs`` lists several (value, probs) pairs; a row stands for ``weight``
    equal rows.  ``extra_aggs`` are further aggregates of the same grouping
    (counts, means); they read ``df`` once more, so it should be a small or a
    written table then.  Without keys the result is one row, also for an empty ``df``.
    """
    specs = list(specs or []) + ([(value, probs)] if value is not None else [])
    values = [F.col(v) if isinstance(v, str) else v for v, _ in specs]
    count = F.col(weight) if weight else F.lit(1)

    # a row for each value column: _s tells which; NULL values are in a last bucket that no rank reaches
    pairs = F.array(*[F.struct(F.lit(i).alias("_s"), v.cast("double").alias("_v")) for i, v in enumerate(values)])
    long = df.select(*keys, count.alias("_c"), F.explode(pairs).alias("_p")).select(*keys, "_c", "_p._s", "_p._v")
    counted = (long.withColumn("_b", F.coalesce(bucket(F.col("_v")), F.lit(LAST).cast("bigint")))
               .groupBy(*keys, "_s", "_b", "_v").agg(F.sum("_c").alias("_c")))

    # the wanted order statistics: positions floor and ceil of (n - 1) * p
    known = F.when(F.col("_b") < LAST, F.col("_in")).otherwise(0)
    per_bucket = counted.groupBy(*keys, "_s", "_b").agg(F.sum("_c").alias("_in"))
    group = Window.partitionBy(*keys, "_s")
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    per_bucket = per_bucket.select("*", (F.sum("_in").over(upto) - F.col("_in")).alias("_before"), F.sum(known).over(group).alias("_n"))
    spots = F.when(F.lit(False), F.array().cast("array<struct<name:string,up:boolean,at:bigint>>"))
    for i, (_, pr) in enumerate(specs):
        place = {n: (F.col("_n") - 1).cast("double") * F.lit(float(p)) for n, p in pr.items()}
        wanted = [F.struct(F.lit(n).alias("name"), F.lit(up).alias("up"), f(x).cast("bigint").alias("at"))
                  for n, x in place.items() for up, f in ((False, F.floor), (True, F.ceil))]
        spots = spots.when(F.col("_s") == i, F.array(*wanted))
    here = F.filter(spots, lambda t: (F.col("_b") < LAST) & (t["at"] >= F.col("_before")) & (t["at"] < F.col("_before") + F.col("_in")))
    targets = (per_bucket.withColumn("_t", here).where((F.size("_t") > 0) | (F.col("_n") == 0))
               .select(*keys, "_s", "_b", "_before", "_n", "_t"))

    on = [*keys, "_s", "_b"]
    t = _renamed(targets, on)
    found = counted.join(t, _same(counted, t, on)).drop(*[f"_r_{k}" for k in on])
    upto = Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.filter("_t", lambda t: (t["at"] >= F.col("_upto") - F.col("_c")) & (t["at"] < F.col("_upto")))
    found = (found.withColumn("_upto", F.col("_before") + F.sum("_c").over(upto))
             .withColumn("_w", inside).where((F.size("_w") > 0) | (F.col("_n") == 0))
             .select(*keys, "_n", "_v", F.explode_outer("_w").alias("_w")))
    out = []
    for _, pr in specs:
        for n, p in pr.items():
            low, high = (F.max(F.when((F.col("_w.name") == n) & (F.col("_w.up") == up), F.col("_v"))) for up in (False, True))
            at = (F.max(F.when(F.col("_w.name") == n, F.col("_n"))) - 1).cast("double") * F.lit(float(p))
            lo, hi = F.floor(at), F.ceil(at)
            out.append(F.when(lo == hi, low).otherwise((hi - at) * low + (at - lo) * high).alias(n))
    found = found.groupBy(*keys).agg(*out)
    if not extra_aggs:
        return found
    more = df.groupBy(*keys).agg(*extra_aggs)
    if not keys:
        return more.join(F.broadcast(found), how="left")  # one row
    f = _renamed(found, keys)
    return more.join(f, _same(more, f, keys)).drop(*[f"_r_{k}" for k in keys])
