"""Keep the best row per key without gathering the copies of a key.

``ROW_NUMBER() = 1`` is planned as a WindowGroupLimit: each task keeps its own
best row of a key before the shuffle, so a key with millions of copies leaves
a task as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k_per_group


def keep_best(df: DataFrame, keys: list[str], order: list[Column], rn_name: str = "rn") -> DataFrame:
    """One row per ``keys`` (NULL keys are equal): the first by ``order``, numbered 1 in ``rn_name``.

    Remaining columns act as a final deterministic tie-break, so the survivor
    never depends on task order.
    """
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in df.columns if c not in keys]
    return top_k_per_group(df, keys, [*order, *rest], 1, rn_name)
