"""Connected components of a link table, by alternating large and small stars.

Every round is a pair of aggregations over the links alone; only counts reach
the driver, and each round's table is written so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(links: DataFrame, ws: Workspace, name: str = "links") -> DataFrame:
    """``links(a, b)`` -> ``(node, component)`` for linked nodes; the component is its smallest node.

    Self-links, repeated links and either order of a and b are fine; an empty
    table gives an empty result.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, k, last = ws.save(now, f"{name}0"), 0, None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == last:
            break
        last, k = state, k + 1
        # large star: every larger neighbour of a node links to the least of its neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("s"), "m").select(F.col("s.x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = ws.save(small, f"{name}{k}")
        ws.drop(f"{name}{k - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
