"""Statistical aggregate expressions with the reference's NULL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .measures import col_


def safe_corr(y, x) -> Column:
    """Pearson correlation, NULL (not an error) for a constant column or < 2 pairs.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode on a constant column,
    so the coefficient is rebuilt from the regression sums.
    """
    sxy = F.regr_sxy(col_(y), col_(x))
    sxx = F.regr_sxx(col_(y), col_(x))
    syy = F.regr_syy(col_(y), col_(x))
    return F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))


def safe_slope(y, x) -> Column:
    """REGR_SLOPE(y, x); NULL when x is constant."""
    return F.when(F.regr_sxx(col_(y), col_(x)) > 0, F.regr_slope(col_(y), col_(x)))


def safe_intercept(y, x) -> Column:
    """REGR_INTERCEPT(y, x); NULL when x is constant."""
    return F.when(F.regr_sxx(col_(y), col_(x)) > 0, F.regr_intercept(col_(y), col_(x)))


def z_score(x, mean, sd) -> Column:
    """(x - mean) / sd, NULL when sd is 0 or NULL."""
    return F.when(col_(sd) > 0, (col_(x) - col_(mean)) / col_(sd))


def clamp(c, lo: float, hi: float) -> Column:
    return F.greatest(F.least(col_(c), F.lit(hi)), F.lit(lo))
