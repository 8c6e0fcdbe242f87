"""Positions of rows within groups, without a task that holds a whole group.

Rows are dealt by range of (group, order), so a hot group lies in many tasks.
Each task numbers what it has; a table of (task, group) segments, far smaller
than the rows, tells how many rows of a group lie in earlier tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_reload


def in_order(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """rows dealt and sorted by ``keys`` (nulls first), rows of equal keys spread by where they were read."""
    by = [c.asc_nulls_first() for c in keys] + [F.col("_tie").asc()]
    return (rows.withColumn("_tie", F.monotonically_increasing_id())
            .repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie"))


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, segments), both written.

    rows has _task and _at beside its own columns; segments has for each
    (_task, group) the rows there (_rows), those in earlier tasks (_before),
    all of the group (_size), the first _at and what to add to _at for the
    position in the group (_shift).  The group must not be null; equal rows
    get different positions.
    """
    kept = in_order(rows, [F.col(group), *order]).select(
        *rows.columns, F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at"))
    kept = write_and_reload(kept, name)
    found = kept.groupBy("_task", group).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    tasks = Window.partitionBy(group)  # at most a row for each task
    earlier = tasks.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("*", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                         F.sum("_rows").over(tasks).alias("_size"))
    return kept, write_and_reload(found.withColumn("_shift", F.col("_before") - F.col("_first")), f"{name}-segments")


def group_numbers(segments: DataFrame, group: str) -> DataFrame:
    """(group, _number): groups in their order, from 0."""
    heads = segments.where("_before = 0")
    per_task = heads.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    per_task = per_task.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_groups"))
    within = Window.partitionBy("_task").orderBy("_first")
    return heads.join(per_task, "_task").select(
        group, (F.col("_groups") + F.row_number().over(within) - 1).alias("_number"))
