"""Joins with hot keys, stored tables, and components of hubs."""

import os

from pyspark.sql import functions as F

from evispark.llm import common, components


def test_join_on_key_joins_every_row_once(spark):
    rows = spark.createDataFrame([(0, i) for i in range(500)] + [(k, k) for k in range(1, 60)], "k long, v long").repartition(5)
    one = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    want = sorted(map(tuple, rows.join(one.drop("n"), "k").collect()))
    for share in (1, 2, 10, 4096):  # no key is hot, one is, all are
        found = common.join_on_key(rows, one, "k", rows.count(), share)
        assert found.columns == ["k", "v", "most"] and sorted(map(tuple, found.collect())) == want
    missing = common.join_on_key(rows, one.filter("k < 3"), "k", rows.count(), 10)
    assert sorted({r.k for r in missing.collect()}) == [0, 1, 2] and missing.count() == 502
    assert common.join_on_key(rows.limit(0), one, "k", 0).count() == 0


def test_hot_rows_are_not_shuffled(spark):
    """The hot side's plan has a broadcast and no exchange of its rows by key."""
    rows = spark.createDataFrame([(0, i) for i in range(100)], "k long, v long")
    one = spark.createDataFrame([(0, 100, 1)], "k long, n long, c long")
    plan = common.join_on_key(rows, one, "k", 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_stored_and_discarded(spark, tmp_path):
    table = common.stored(spark.range(10), "numbers")
    files = [f.removeprefix("file://") for f in table.inputFiles()]
    assert table.count() == 10 and all(map(os.path.exists, files))
    common.discarded(table)
    assert not any(map(os.path.exists, files))


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000, 1001), (399, 2000), (5, 5), (7, 0)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(400)}, 2000: 0, 1000: 1000, 1001: 1000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
