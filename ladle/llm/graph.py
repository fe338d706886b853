"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.storage import discard, join_hot, materialize

#: A graph with fewer edges (16 bytes each) is joined without looking for hubs: a task may have all edges of one.
SPLIT_FROM = 4_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a long, b long): the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each one aggregate and one
    join, written out after each pair of steps. The number of rounds grows with the logarithm of the
    graph. A hub's least neighbour is found by partial aggregates and, from SPLIT_FROM edges on, broadcast to where its edges lie. Edges with a null end and
    loops are passed over; an empty table gives an empty result.
    """
    now = materialize(_oriented(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    before = _digest(now)
    while before[0]:
        last, now = now, materialize(_small_star(_large_star(now, before[0]), before[0]), "edges")
        after = _digest(now)
        discard(last)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    # every larger neighbour of a node points to the least of its neighbourhood
    return _oriented(join_hot(both.where("b > a"), least, ["a"], "n", 2 * n, split_from=SPLIT_FROM).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    linked = join_hot(edges, least, ["a"], "n", n, split_from=SPLIT_FROM).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(linked.union(least.select("a", F.col("m").alias("b"))))
