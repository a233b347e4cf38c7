"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def _least(edges: DataFrame, rows: DataFrame, value: Column, name: str, files: int | None) -> DataFrame:
    """rows with m, the value of their node a among edges."""
    least = shared.materialise(edges.groupBy("a").agg(value.alias("m"), F.count("*").alias("n")), name, files)
    return shared.join_spread(rows, least.drop("n"), ["a"], shared.hot_keys(least, ["a"]), "inner")


def components(edges: DataFrame, name: str = "components", files: int | None = None) -> DataFrame:
    """(node, root): the least node reachable, for each node of edges (a, b), both bigint.

    Each round links the neighbours of a node to the least of them (first the larger ones, then the smaller ones), which
    takes a number of rounds that grows as the logarithm of the nodes. Only rows of edges move; each round's edges are
    written to the shared folder, so lost executors cost one round at most. Nodes with very many neighbours, such as the
    centre of a large component, are dealt over several tasks.
    """
    now = shared.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, files)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both, both.where("b > a"), F.least(F.min("b"), F.first("a")), name, files).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = shared.materialise(large.distinct(), name, files)
        small = _least(large, large, F.min("b"), name, files).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = shared.materialise(small, name, files)
        # a set of edges that a round leaves as it is, is a star for each component
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).head()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
