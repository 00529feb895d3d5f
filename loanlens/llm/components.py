"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import materialized


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one. ``edges``: (a, b) with b < a."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.where("b > a").join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("b < a"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = (edges.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
             .select(F.col("b").alias("a"), F.col("m").alias("b")).where("b < a"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    ``edges``: two columns of ids, in any order, loops and repeats allowed.
    Every round shuffles edges only; a hub is one pre-aggregated row per task
    and a join side that Spark can split.
    """
    x, y = edges.columns
    edges = materialized(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("b < a").distinct(), narrow=True)
    before = _state(edges)
    while before[0]:
        edges = materialized(_small_star(_large_star(edges)), narrow=True)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
