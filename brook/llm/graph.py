"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of the edges (a, b), the smallest node reachable from it.

    Alternates large-star and small-star steps, which take a number of rounds logarithmic in the
    size of the graph; each round is two shuffles of the edges and never gathers a component."""
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges)
    before = _state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m")
        small = large.join(low, F.col("b") == F.col("k")).select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        small = materialize(small.select("e.a", "e.b").where("a <> b").distinct())
        after = _state(small)
        drop_table(edges)
        edges = small
        if after == before:
            break
        before = after
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
