"""Merges with counters: equal to a recount, and nothing changes when a write fails."""

import random

import pytest
from pyspark.sql import functions as F

from evispark.sources.writes import Counters, merge_write

SCHEMA = "label string, name string, code string, degree int"


def apply(table, changes):
    """The definition, row by row."""
    last = {}
    for label, name, *properties in changes:
        order = tuple((x is not None, x) for x in properties)
        if (label, name) not in last or order > last[label, name][0]:
            last[label, name] = (order, properties)
    created = updated = values = 0
    for k, (_, properties) in last.items():
        old = table.get(k, [None, None])
        n = sum(new is not None and new != was for new, was in zip(properties, old))
        created, updated, values = created + (k not in table), updated + (k in table and n > 0), values + n
        table[k] = [was if new is None else new for new, was in zip(properties, old)]
    return Counters(created, updated, values)


def test_counters_equal_a_recount(spark, tmp_path):
    draw, table, path = random.Random(6), {}, f"file://{tmp_path}/nodes"
    for _ in range(4):
        changes = [(draw.choice("ab"), f"n{draw.randrange(12)}", draw.choice([None, "x", "y"]), draw.choice([None, 1, 2])) for _ in range(15)]
        found = merge_write(spark, path, spark.createDataFrame(changes, SCHEMA).repartition(3), ["label", "name"], "label")
        assert found == apply(table, changes)
        stored = {(r.label, r["name"]): [r.code, r.degree] for r in spark.read.schema(SCHEMA).parquet(path).collect()}
        assert stored == table and spark.read.parquet(path).count() == len(table)


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/nodes"
    merge_write(spark, path, spark.createDataFrame([("a", "n", "1", 1), ("b", "n", "1", 1)], SCHEMA), ["label", "name"], "label")
    before = sorted(f for f in spark.read.parquet(path).inputFiles() if "label=b" in f)
    assert merge_write(spark, path, spark.createDataFrame([("a", "n", "2", None)], SCHEMA), ["label", "name"], "label") == Counters(0, 1, 1)
    assert sorted(f for f in spark.read.parquet(path).inputFiles() if "label=b" in f) == before
    assert merge_write(spark, path, spark.createDataFrame([], SCHEMA), ["label", "name"], "label") == Counters(0, 0, 0)


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/nodes"
    merge_write(spark, path, spark.createDataFrame([("a", "n", "1", 1)], SCHEMA), ["label", "name"], "label")
    before = (sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).collect())), spark.read.parquet(path).inputFiles())
    broken = spark.createDataFrame([("a", "n", "9", 1), ("a", "m", "9", 1)], SCHEMA).withColumn("degree", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        merge_write(spark, path, broken, ["label", "name"], "label")
    assert (sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).collect())), spark.read.parquet(path).inputFiles()) == before
    with pytest.raises(ValueError):
        merge_write(spark, path, broken, ["name"], "label")
