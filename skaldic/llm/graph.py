"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long): component is the smallest node reachable.

    Each round links nodes to the smallest neighbour; the rounds, about the logarithm of the longest path,
    are written to the shared folder, so that no lineage builds up. Loops, repeated edges, edges with a null
    and empty tables are fine. Nothing but two sums per round reaches the driver.
    """
    u, v = F.col("u"), F.col("v")
    now = materialize(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = materialize(both.groupBy(u.alias("c")).agg(F.least(F.min("v"), F.min("u")).alias("m")), "least")  # stored: the join below can then split a very common node
        large = both.join(least, both.u == least.c).where(v > u).select(v.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        down = materialize(large.groupBy(u.alias("c")).agg(F.min("v").alias("m")), "down")
        joined = large.join(down, large.u == down.c)
        small = joined.select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialize(small, "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
