"""Monotone buckets of a number: what splits a hot group by value.

A bucket is a step of the value's logarithm (about 0.07 % wide), mirrored for
negative values, so equal values share a bucket and a larger value never has a
smaller bucket.  There are at most some two million buckets, in practice a few
thousand; counts by (group, bucket) combine on the map side and are small
however many rows a group has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 1024
#: Buckets of NULL values that sort after, or before, all others.
LAST, FIRST = 1 << 30, -(1 << 30)


def bucket(value: Column) -> Column:
    """The bucket of a double (NULL for NULL; NaN sorts last, as in Spark)."""
    x = value.cast("double")
    step = F.floor(F.log2(F.lit(1.0) + F.abs(x)) * STEPS)
    top = F.lit(LAST - 1).cast("bigint")
    return F.when(F.isnan(x), top).when(F.abs(x) == float("inf"), F.when(x > 0, top - 1).otherwise(1 - top)).when(
        x >= 0, step).otherwise(-step - 1)
