"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them: the greater neighbours (large) or the smaller ones."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = near.join(least, "a")
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b) that isn't its component's least node.

    Each round is written to the shared folder, so the plan stays short and a lost executor costs one round; the round
    before it is removed."""
    spark = edges.sparkSession
    state, edges = None, saved(edges.filter("a <> b").distinct(), "edges")
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = mark
        old = edges.inputFiles()[0].rpartition("/")[0]
        edges = saved(_star(_star(edges, True), False), "edges")
        remove(spark, old)
