"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.storage import materialize, remove


def _large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's least neighbour or itself."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the least of them.  All links have u > v here."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (u, v): component is the least node reachable.

    Links may repeat, point either way or to themselves; nodes without other
    nodes are not returned.  Nothing is collected: each round writes its links
    to the shared folder, and the rounds end when they no longer change.  A
    node with very many links is the same as any other but in joins, where its
    rows can be split, and in sums, which are partly done before the shuffle.
    """
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = materialize(links.where("u <> v").select(u.alias("u"), v.alias("v")).distinct(), "links")
    before = state(now)
    while before[0]:
        large = _large_star(now).where("u <> v").distinct()
        step = materialize(_small_star(large).distinct(), "links")
        after = state(step)
        remove(now)
        now = step
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
