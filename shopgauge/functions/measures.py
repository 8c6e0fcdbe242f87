"""Aggregate measures shared by every KPI table.

Money is summed as an exact decimal, as the reference does with its
``::NUMERIC`` casts: capped revenue has at most four decimals, so a
DECIMAL(.., 4) sum is exact and every engine returns the same double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# DECIMAL(18,4) values keep Spark's compact 64-bit decimal arithmetic; the
# SUM buffer (DECIMAL(28,4)) widens on its own for totals beyond 2^63.
EXACT = "decimal(18,4)"
#: Totals of such columns, which may pass 18 digits.
EXACT_TOTAL = "decimal(28,4)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c) -> Column:
    """SUM of a money column, exact, returned as DOUBLE (NULL on no rows)."""
    return F.sum(col_(c).cast(EXACT)).cast("double")


def money_avg(c) -> Column:
    """AVG of a money column, totals included, from an exact sum (NULL when no non-NULL value)."""
    x = col_(c)
    return F.try_divide(F.sum(x.cast(EXACT_TOTAL)).cast("double"), F.count(x).cast("double"))


def mean(c) -> Column:
    """AVG of a non-money double (a ratio such as AOV)."""
    return F.avg(col_(c).cast("double"))


def count_sum(c) -> Column:
    """SUM of an integral column as BIGINT."""
    return F.sum(col_(c)).cast("bigint")


def ratio_of_sums(num: Column, den: Column) -> Column:
    """``CASE WHEN den > 0 THEN num / den END`` over already-aggregated columns."""
    return F.when(den > 0, num / den.cast("double"))


def aov_of_sums(revenue="revenue", transactions="transactions") -> Column:
    """The aov* of the reference: SUM(revenue) / SUM(tx), NULL when SUM(tx) <= 0."""
    return ratio_of_sums(money_sum(revenue), F.sum(col_(transactions)))


def kpi_aggs(revenue="revenue", transactions="transactions",
             names=("revenue", "transactions", "aov")) -> list[Column]:
    """The (revenue, transactions, aov*) triple every KPI table computes."""
    r, t, a = names
    return [money_sum(revenue).alias(r), count_sum(transactions).alias(t),
            aov_of_sums(revenue, transactions).alias(a)]


def safe_div(num: Column, den: Column) -> Column:
    """``num / NULLIF(den, 0)`` without the ANSI divide-by-zero error."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def row_aov(revenue="revenue", transactions="transactions") -> Column:
    """Row-level AOV: revenue / tx when tx > 0."""
    return F.when(col_(transactions) > 0, col_(revenue) / col_(transactions).cast("double"))


def flag(cond: Column) -> Column:
    """0/1 integer flag; a NULL condition gives 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
