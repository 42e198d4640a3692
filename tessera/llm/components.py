"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Every step is an aggregation and a join over the edges. Each node ends with one edge to the least
node of its component. Tables are written after each step, so lineage stays short and a lost
executor costs one step; only two numbers of a step (rows and a checksum) come to the driver.

Defined results: edges with a null end, loops and repeated edges add nothing; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import discard, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the smaller ones and itself) to the least of its neighbourhood."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = around.join(low, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    linked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node u that isn't the least of its component, and that least node v. edges: columns x, y."""
    old: list[str] = []
    now = written(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), old)
    before = None
    while True:
        new: list[str] = []
        now = written(star(star(now, large=True), large=False), new)
        discard(edges.sparkSession, old)
        old = new
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now
        before = state
