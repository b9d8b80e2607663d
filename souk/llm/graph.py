"""Connected components of a link table, as joins and grouped minima in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the smallest node that
    can be reached.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller
    ones, are hung under its least neighbour, until every link goes straight to a root. The
    number of rounds grows with the logarithm of the longest path. Minima are combined
    before the shuffle and no neighbour list is ever gathered, so a node with many links is
    only many rows, which the join can split; each round is a written table."""
    edges = save(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                 .distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = save(_small(_large(edges)), "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(edges.select("u", "v"))
    least = both.groupBy("x").agg(F.min("y").alias("least"))
    return (both.filter("y > x").join(least, "x")
            .select(F.col("y").alias("v"), F.least("x", "least").alias("u")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("u").alias("least"))
    return (edges.join(least, "v").select(F.when(F.col("u") == F.col("least"), F.col("v")).otherwise(F.col("u")).alias("v"),
                                          F.col("least").alias("u")).distinct())
