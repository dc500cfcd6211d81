"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id reachable.

    A large-star step links every larger neighbour of an id to its least neighbour, a small-star step every smaller
    one; the table shrinks to stars around least ids in a number of rounds that grows with the logarithm of the
    number of ids. Least neighbours are minima, pre-aggregated, so an id with very many edges is no task of its own.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").union(low.select("k", "m"))
        new = materialize(small.distinct(), "small")
        discard(large)
        stay = new.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(new, ["u", "v"], "left_anti").isEmpty()
        discard(now)
        now = new
        if stay:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
