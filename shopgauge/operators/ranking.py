"""Row numbers, NTILE and top-k within groups, safe for hot groups.

A window ``partitionBy(keys)`` puts a whole group on one task.  Here a group
is cut into cells of equal (bucket of the ordering value, block of the
tie-breaker): rows are numbered within their cell, and counts by (group, cell),
which combine on the map side, tell how many rows lie in earlier cells.  NTILE
is then arithmetic on the row number and the group size (remainder rows go to
the first tiles, as in PostgreSQL and Spark).  No job runs while the plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import FIRST, LAST, bucket

#: Rows of one value in one cell at most, where the tie-breaker is a dense number.
TIES = 1 << 20


@dataclass(frozen=True)
class Order:
    """Order by a numeric column, then by a unique tie-breaker ascending."""

    value: str
    tie: str
    descending: bool = False
    nulls_first: bool = False

    def columns(self) -> list[Column]:
        c = F.col(self.value)
        if self.descending:
            c = c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        else:
            c = c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return [c, F.col(self.tie)]

    def cell(self) -> Column:
        b = bucket(F.col(self.value))
        return F.coalesce(-b if self.descending else b, F.lit(FIRST if self.nulls_first else LAST).cast("bigint"))


def desc_first(value: str, tie: str) -> Order:
    """``value DESC`` with NULLs first, as PostgreSQL sorts."""
    return Order(value, tie, descending=True, nulls_first=True)


def asc_last(value: str, tie: str) -> Order:
    """``value ASC`` with NULLs last, as PostgreSQL sorts."""
    return Order(value, tie)


def ntile_from_rank(rn: Column, size: Column, n: int) -> Column:
    """NTILE(n) of the row with 1-based number ``rn`` in a group of ``size`` rows."""
    q = F.floor(size / n)
    r = size - q * n
    big = r * (q + 1)
    first = F.floor((rn - 1) / (q + 1)) + 1
    rest = r + F.floor((rn - 1 - big) / q) + 1
    return F.when(rn <= big, first).otherwise(rest).cast("int")


def _block(df: DataFrame, tie: str) -> Column:
    whole = dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint")
    return F.expr(f"`{tie}` div {TIES}") if whole else F.lit(0).cast("bigint")


def add_row_number(df: DataFrame, keys: list[str], order: Order, name: str, size_name: str = "_size",
                   counted: DataFrame | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)`` as BIGINT, and the group's rows.

    The input is read for the counts too (from ``counted``, which has the same
    rows, if given), so it should be a small or a written table.
    """
    cell = ["_cell", "_block"]

    def with_cells(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_cell", order.cell()).withColumn("_block", _block(rows, order.tie))
    counts = with_cells(df if counted is None else counted).groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_in"))
    df = with_cells(df)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy(*cell).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(*[F.col(k).alias(f"_r_{k}") for k in [*keys, *cell]],
                           (F.sum("_in").over(upto) - F.col("_in")).alias("_before"), F.sum("_in").over(group).alias(size_name))
    same = F.lit(True)
    for k in [*keys, *cell]:
        same = same & df[k].eqNullSafe(counts[f"_r_{k}"])
    within = Window.partitionBy(*keys, *cell).orderBy(*order.columns())
    return (df.join(counts, same).withColumn(name, F.col("_before") + F.row_number().over(within))
            .drop("_before", *cell, *[f"_r_{k}" for k in [*keys, *cell]]))


def add_ntiles(df: DataFrame, keys: list[str], tiles: dict[str, tuple[int, Order]]) -> DataFrame:
    """Add ``NTILE(n) OVER (PARTITION BY keys ORDER BY order)`` for each ``name -> (n, order)``.

    Tiles of one order share its row numbers.
    """
    out = df
    for order in dict.fromkeys(o for _, o in tiles.values()):
        out = add_row_number(out, keys, order, "_rn", counted=df)
        for name, (n, o) in tiles.items():
            if o == order:
                out = out.withColumn(name, ntile_from_rank(F.col("_rn"), F.col("_size"), n))
        out = out.drop("_rn", "_size")
    return out.select(*df.columns, *tiles)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    rank_name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group by ``order``, numbered 1..k.

    Planned as a WindowGroupLimit: each task keeps only its local top k
    per group before the shuffle, so a hot group sends at most k rows per
    task across the network.
    """
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank_name, rn).where(F.col(rank_name) <= k)
