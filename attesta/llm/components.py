"""Connected components by alternating large and small stars.

Both steps are plain joins and grouped minima, so no task holds a whole component; the edge list
is written to the shared folder after every round and rounds stop when it no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import discard, stash


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``, root being the least node reachable.

    Self-loops, repeated and null edges are ignored; no edges give no rows. Nodes without an edge
    are not listed (their root is themselves).
    """
    e = stash(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
        new = stash(_small_star(_large_star(e).distinct()).distinct(), "edges")
        discard(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
