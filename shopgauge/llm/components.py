"""Connected components of a link table, by alternating star contraction.

Each round points every node's larger neighbours at its smallest neighbour
(large star), then every node's smaller neighbours at the smallest of them
(small star).  Both are a minimum per node joined back to the links, so no
neighbour list is ever gathered and a node with very many links is spread by
the join's skew handling.  Rounds grow with the logarithm of the longest
chain.  Each round's links are written to the shared folder, so a lost
executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_reload


def _star(both: DataFrame) -> DataFrame:
    """``both``: (u, v) rows; joins the least of u and its v to each row as m."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node named in links (a, b): the least node reachable.

    Self-links are allowed; rows with a null end are ignored; an empty table
    has no components.
    """
    a, b = F.col("a"), F.col("b")
    edges = (links.where(a.isNotNull() & b.isNotNull())
             .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    edges = write_and_reload(edges, "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    edges = edges.where("a < b")
    last = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = _star(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = (_star(down).select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
                 .where("a < b").distinct())
        edges = write_and_reload(small, "links")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    label = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
