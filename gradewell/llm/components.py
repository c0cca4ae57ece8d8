"""Connected components of an edge table by alternating large and small stars.

Each half round is one aggregate (the smallest neighbour of every vertex) and one join; a hub with
very many neighbours is aggregated before the shuffle and split by skew handling in the join. Rounds
are written as tables in the shared folder, and end when the edges no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """(vertex, root) for every vertex of the edges (a, b); the root is the component's smallest vertex."""
    edges = written(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(edges)
    while state[0]:
        # large star: every larger neighbour of a vertex joins the smallest one around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
        larger = edges.select(F.col("a").alias("v"), F.col("b").alias("a"))
        large = larger.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        edges = written(spark, large.unionByName(own).where("a != b").distinct(), name)
        # small star: the smaller neighbours of a vertex join the smallest of them
        least = written(spark, edges.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        edges = written(spark, small.unionByName(own).where("a != b").distinct(), name)
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)
