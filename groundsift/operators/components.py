"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join; lineage is cut through the shared
checkpoint folder, so a lost executor replays one step only.  A hub of many
edges is met by a grouped minimum, which combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsift.session import cut, unsent


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node)`` and ``edges(a, b)`` to ``(node, component)``; component is the least node name."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut(e)
    last = None
    while True:
        # large star: every larger neighbour of a node points to the least of its neighbourhood
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = both.join(unsent(least), "n").where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node, points to the least smaller neighbour
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(unsent(low), "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        e = cut(small)
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return (nodes.select("node").distinct().join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))
