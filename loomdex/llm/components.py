"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of the nodes of edges (a, b) of longs; nodes without edges are not listed.

    Each step moves edges only, by aggregates that combine on the map side and plain equi-joins, so a node of very many
    edges is split by the planner. Steps end when the edges no longer change, after O(log n) of them.
    """
    now = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        now = store(_small_star(_large_star(now)).where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
