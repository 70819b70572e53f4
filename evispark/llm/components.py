"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import discarded, join_on_key, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    moved = join_on_key(both.filter("b > a"), least, "a", 2 * total)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_on_key(down, least, "a", total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of its component, for each node that has an edge.

    ``edges`` has columns a and b of one orderable type; loops and repeats are ignored.
    Every round is written to the shared folder, so lineage stays short and a lost
    executor costs one round at most. A round is two aggregations with partial sums and
    two equi-joins whose one side has a row a node; the edges of a node that holds a large
    part of them all stay where they are (``join_on_key``). Ends when a round leaves all edges as they were.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        large = stored(_large_star(now, before[0]), "components")
        last, now = now, stored(_small_star(large, before[0]), "components")
        discarded(last)
        discarded(large)
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
