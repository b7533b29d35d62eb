"""Connected components of a link table, by alternating star contractions.

Every round is two aggregations and joins over the links, which only shrink; no node's links ever meet in one task, since
each of them takes no more than the smallest neighbour. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.shared import stored


def components(links: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) of all nodes that have a link.

    Links of a node to itself and links with a null end are left out, repeated links count once; no links, no rows.
    ``most``: how many links there are at most, if that is known.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stored(e.distinct(), "links", rows=most)
    n, unsettled = _state(e)
    while unsettled:
        e = stored(_small_star(_large_star(e)), "links", rows=n)  # a round never adds links
        n, unsettled = _state(e)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stored(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components", rows=2 * n)


def _state(e: DataFrame) -> tuple[int, int]:
    """How many links there are, and how many nodes keep them from being stars: linked to several smaller ones, or to a smaller and a larger one."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return tuple(nodes.agg(F.coalesce(F.sum("below"), F.lit(0)), F.count_if((F.col("below") > 1) | (F.col("below") + F.col("above") > 1))).first())


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = e.join(least, F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
