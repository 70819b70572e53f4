"""Pairs within groups and counts of pairs, against brute force."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from evispark.operators import concepts, hierarchy
from evispark.operators.pairs import pairs_within


def test_a_large_group_is_dealt_into_many_tasks(spark):
    rows = spark.createDataFrame([(i, "one" if i < 40 else f"g{i % 3}" if i < 50 else None) for i in range(55)], "item int, k string")
    pairs = pairs_within(rows, ["k"], "item").select("a.k", F.col("a.item").alias("x"), F.col("b.item").alias("y"), F.spark_partition_id().alias("task")).collect()
    of = {i: "one" if i < 40 else f"g{i % 3}" for i in range(50)}
    assert sorted((r.x, r.y) for r in pairs) == [(x, y) for x, y in combinations(range(50), 2) if of[x] == of[y]]
    shares = Counter(r.task for r in pairs if r.k == "one")
    assert max(shares.values()) < 780 / 3  # one group was one task's


def test_kin_with_several_common_ancestors_are_one_pair(spark):
    edges = [("a", "p"), ("a", "q"), ("b", "p"), ("b", "q"), ("c", "q"), ("p", "r"), ("q", "r")]
    up = hierarchy.closure(spark.createDataFrame(edges, "child string, parent string"))
    got = sorted(tuple(r) for r in hierarchy.similar_entities(up, most=4).collect())
    rows = [(r.node, r.ancestor, r.distance) for r in up.collect() if r.distance <= 3]
    want = {}
    for n, x, i in rows:
        for m, y, j in rows:
            if x == y and n != m and i + j <= 4:
                want[n, m] = min(want.get((n, m), 9), i + j)
    assert got == sorted((n, m, k) for (n, m), k in want.items())


def test_counts_by_first_source_equal_those_of_pairs(spark):
    rows = [(i, i % 4 if i % 5 else None, i % 3, i % 2 if i % 7 else None) for i in range(40)]
    got = {r.k: (r.n_0, r.n_1, r.n_2) for r in concepts.first_source_counts(spark.createDataFrame(rows, "k int, a int, b int, c int"), "k", ["a", "b", "c"]).collect()}
    for k, *own in rows:
        want = Counter(next((i for i in range(3) if own[i] is not None and own[i] == o[i]), None) for j, *o in rows if j != k)
        assert got[k] == (want[0], want[1], want[2])


def test_a_small_table_is_dealt_too(spark):
    """Spark sent one side whole to the other's parts, so that a small table's pairs, of which there are many, were made by few tasks."""
    plan = pairs_within(spark.range(50).withColumn("k", F.lit(1)), ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
