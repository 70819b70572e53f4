"""The stored text index against the search without one."""

import random

import pyarrow as pa
import pytest

from evispark.operators import text_index
from evispark.operators.search import bm25
from evispark.operators.text_index import TextIndex, slice_scores
from evispark.plans.indexes import QUERIES


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(draw.choices(words[: draw.choice([5, 60, 300])], k=draw.randrange(0, 80)))) for i in range(600)]
    rows += [(601, None), (602, ""), (603, "..."), (604, "W1 w1. É é"), (5, "w1 again"), (-7, rows[3][1]), (-8, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w1 w2 w200"), (2, "W299, w298; w1"), (3, "é"), (4, "nowhere"), (5, ""), (6, None), (7, "w0 w1 w2 w3 w4 w0")], "query_id long, text string")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return TextIndex.build(corpus, f"file://{tmp_path_factory.mktemp('index')}", buckets=7, slice_docs=20)


def ranked(df, k):
    by = {}
    for r in df.collect():
        by.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    return {q: [(d, -s) for s, d in sorted(hits)[:k]] for q, hits in by.items()}


def test_scores_are_those_without_an_index(corpus, queries, index):
    want = {(r.query_id, r.doc_id): r.score for r in bm25(corpus, queries).collect()}
    got = {(r.query_id, r.doc_id): r.score for r in index.scores(queries).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) <= 2e-6 for x in want)


def test_scores_of_many_queries_are_made_in_groups(monkeypatch, queries, index):
    want = sorted(tuple(r) for r in index.scores(queries).collect())
    monkeypatch.setattr(text_index, "ASKED", 2)
    assert sorted(tuple(r) for r in index.scores(queries).collect()) == want


def test_every_item_is_asked_for(spark):
    """Items were asked for only where their number is divisible by 100, which is one of 40 here."""
    asked = {r.query_id for r in QUERIES["text_index_scores"](spark, "/root/testdata/sf0.001").select("query_id").distinct().collect()}
    assert asked == {r.query_id for r in QUERIES["text_index_top"](spark, "/root/testdata/sf0.001").select("query_id").distinct().collect()}
    assert len(asked) == 40


@pytest.mark.parametrize("k, probed", [(3, 1), (10, 4), (1000, 2)])
def test_top_is_exact(queries, index, k, probed):
    want = ranked(index.scores(queries), k)
    found = index.top(queries, k, probed).collect()
    assert {q: [(r.doc_id, r.score) for r in sorted(found, key=lambda r: r.place) if r.query_id == q] for q in want} == want


def test_bounds_hold_and_slices_are_skipped(spark, queries, index):
    bound = {(r.query_id, r.slice): r.bound for r in index.bounds(queries).collect()}
    slices = {r.doc_id: r.slice for r in spark.read.parquet(f"{index.path}/postings").selectExpr("slice", "explode(postings.doc_id) AS doc_id").distinct().collect()}
    best = ranked(index.scores(queries), 3)
    assert all(s <= bound[q, slices[d]] + 1e-6 for q, hits in best.items() for d, s in hits)
    rare = [b for (q, _), b in bound.items() if q == 2]
    assert sum(b < best[2][-1][1] for b in rare) > len(rare) / 2  # most slices can't reach the third best


def test_only_the_terms_buckets_are_read(spark, index):
    one = spark.createDataFrame([(1, "w7")], "query_id long, text string")
    read = index._pruned("postings", index._wanted(one))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w7)]" in plan.replace("In(term, [w7])", "EqualTo(term,w7)")
    assert len(read.select("bucket").distinct().collect()) == 1 and read.rdd.getNumPartitions() == 1


def test_texts_and_postings_are_shuffled_once(spark, corpus, queries, index):
    """Blocks don't multiply by queries: what meets in a slice is a row a term, and no pair of query and document is shuffled."""
    plan = index.scores(queries)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(postings" not in plan
    table = pa.table({"slice": [0, 0], "postings": [[{"doc_id": 7, "weight": 1.0}, {"doc_id": 3, "weight": 1.0}], [{"doc_id": 3, "weight": 0.5}]], "asked": [[{"query_id": 1, "idf": 2.0}, {"query_id": 2, "idf": 2.0}], [{"query_id": 2, "idf": 4.0}]]})
    assert [tuple(r.values()) for r in slice_scores(table, None, None).to_pylist()] == [(1, 7, 2.0), (1, 3, 2.0), (2, 7, 2.0), (2, 3, 4.0)]
    assert [tuple(r.values()) for r in slice_scores(table, pa.table({"query_id": [1]}), 1).to_pylist()] == [(1, 3, 2.0)]


def test_empty_table(spark, queries, tmp_path):
    empty = TextIndex.build(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}")
    assert empty.top(queries, 5).count() == 0 and empty.scores(queries).count() == 0


def test_an_index_is_built_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = TextIndex.of(docs)
    stamp = spark.read.parquet(f"{first.path}/stats").inputFiles()
    assert TextIndex.of(docs).path == first.path and spark.read.parquet(f"{first.path}/stats").inputFiles() == stamp
