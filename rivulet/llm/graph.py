"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.runtime import checkpointed


def components(edges: DataFrame, first: str = "a", second: str = "b", small: bool = False) -> DataFrame:
    """(id, component): the smallest id that each id of an edge can reach.

    Alternates large-star and small-star steps until every edge leads from a node to the least of
    its component.  Edges are kept from the larger to the smaller id.  Each step is a grouped
    minimum with map-side combination and a join on the node; a node with very many edges is split
    by the adaptive skew join.  Nodes without edges don't appear.  Callers that have counted few
    nodes say so with small; tables with a row for each node are then broadcast.
    """
    side = F.broadcast if small else (lambda df: df)
    links = edges.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).filter("u > v").distinct()
    links = checkpointed(links)
    while True:
        # settled: no node has two edges, and none is both a source and a target
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("s"), F.lit(0).alias("t")), F.struct(F.col("v").alias("x"), F.lit(0).alias("s"), F.lit(1).alias("t")))).alias("e")).select("e.*")
        open_ = ends.groupBy("x").agg(F.sum("s").alias("s"), F.max("t").alias("t")).filter("s > 1 or (s > 0 and t > 0)")
        if open_.isEmpty():
            found = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return found.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour points to the least of the neighbours and the node
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(side(low), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: smaller neighbours and the node itself point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        links = checkpointed(small.select("e.u", F.col("e.m").alias("v")).filter("u > v").distinct())
