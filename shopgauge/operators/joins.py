"""Join helpers with a checked broadcast side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> int:
    """Rows of ``df``, counted as they pass: one number from each task, no exchange of its own."""
    seen = Observation()
    df.select(F.lit(1).alias("one")).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


def side(df: DataFrame, max_rows: int, known_rows: int | None) -> DataFrame:
    """Broadcast hint only behind a known row bound; else Spark chooses by the sizes that it sees.

    Without a hint Spark broadcasts what its own size threshold allows and
    shuffles the rest, with AQE's skew-join handling for hot keys.
    """
    return F.broadcast(df) if known_rows is not None and known_rows <= max_rows else df


def attach(detail: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
           null_safe: bool = False, max_rows: int = 2_000_000,
           known_rows: int | None = None) -> DataFrame:
    """Join a per-group table onto detail rows.

    ``null_safe`` matches NULL keys to each other (group keys such as a NULL
    date form a group of their own); the plain form follows SQL ``=``.
    ``known_rows`` is a bound on the rows of ``small`` already proven by the
    caller: up to ``max_rows`` it is broadcast, so the detail is not shuffled.
    """
    small = side(small, max_rows, known_rows)
    if not null_safe:
        return detail.join(small, on=on, how=how)
    renamed = small.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in on else F.col(f"`{c}`")
                             for c in small.columns])
    cond: Column = F.lit(True)
    for k in on:
        cond = cond & detail[k].eqNullSafe(renamed[f"_r_{k}"])
    out = detail.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in on])
