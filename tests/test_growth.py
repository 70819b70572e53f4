"""What a task holds and what goes through the driver must not grow with the tables."""

import re

import pytest

import __spark_entry__ as entry_module
from evispark.operators import fixpoint
from evispark.sources import tables as t

SF_DIR = "/root/testdata/sf0.001"
#: The table in proportion to which a query's rows are dealt into parts, and the keys by which they are.
DEALT = {
    "network_research_chain": ("orders", {"via", "root", "paper, root"}),
    "join_claim_stances": ("lineitem", {"claim_id, source_paper_id"}),
    "conflict_report": ("lineitem", {"intervention, outcome"}),
    "join_head_to_head": ("lineitem", {"source_paper_id", "first, second"}),
}


def test_study_types_use_all_cores_and_compute_a_score_once(spark):
    df = entry_module.queries()["text_study_types"](spark, SF_DIR)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    patterns = df._jdf.queryExecution().optimizedPlan().toString().count("case series")
    assert 0 < patterns < 10


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt_into_parts_that_grow_with_the_table(spark, name):
    table, keys = DEALT[name]
    few = t.parts(spark, SF_DIR, table)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        many = t.parts(spark, SF_DIR, table)
        plan = entry_module.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = re.findall(r"hashpartitioning\(([^()]*), (\d+)\), REPARTITION_BY_NUM", plan)
    assert many > few and {int(n) for _, n in found} == {many}
    assert {re.sub(r"#\d+L?", "", by) for by, _ in found} == keys


def test_names_settle_without_tables_sent_by_way_of_the_driver(spark, monkeypatch):
    plans = []

    def staged(df, name, write=fixpoint.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(fixpoint, "staged", staged)
    steps = spark.createDataFrame([(f"v{i}", f"v{i + 1}") for i in range(9)], "old string, canonical string")
    facts = steps.select("old").withColumnRenamed("old", "name")
    found = fixpoint.settled_names(steps, (), facts)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 9
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_cycles_are_found_without_tables_sent_by_way_of_the_driver(spark, monkeypatch):
    plans = []

    def staged(df, name, write=fixpoint.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(fixpoint, "staged", staged)
    ring = [(f"r{i:02}", f"r{(i + 1) % 24:02}") for i in range(24)]
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("c40", "r00")]
    is_a = spark.createDataFrame([(c, p, None) for c, p in ring + chain], "child string, parent string, level int")
    found = fixpoint.problems(is_a, is_a.select("child").withColumnRenamed("child", "node"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.filter("kind = 'cycle'").count() == 24
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert len(plans) < 40  # a step each for 41 nodes to drop and 24 to go round would take more
