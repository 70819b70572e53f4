"""The inverted-file index against brute force: recall, filters before ranking, and whole results where all is looked at."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.operators.vector_index import Codes, VectorIndex

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors():
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return VectorIndex.build(spark.read.parquet(f"{SF}/embeddings.parquet"), f"file://{tmp_path_factory.mktemp('vectors')}")


def brute(ids, x, q, k, keep=None):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(unit @ (q / np.linalg.norm(q)), 6)
    order = [int(ids[i]) for i in np.lexsort((ids, -sim)) if keep is None or ids[i] in keep]
    return order[:k]


def queries(spark, every=25):
    return spark.read.parquet(f"{SF}/embeddings.parquet").filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.place):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_at_ten(spark, index, vectors):
    ids, x = vectors
    got = found(index.search(queries(spark), 10))
    assert len(got) == (ids % 25 == 0).sum()
    hits = [len(set(got[q]) & set(brute(ids, x, x[ids == q][0], 10))) / 10 for q in got]
    assert np.mean(hits) >= 0.9
    assert index.probes < len(index.codes.centre)


def test_all_lists_give_the_exact_result(spark, index, vectors):
    ids, x = vectors
    got = found(index.search(queries(spark, 100), 10, probes=1000, looked=10_000))
    assert got == {q: brute(ids, x, x[ids == q][0], 10) for q in got} and len(got) == (ids % 100 == 0).sum()


def test_filters_come_before_the_ranking(spark, index, vectors):
    """Few vectors are allowed, none of them among the nearest of all, and yet k are found."""
    ids, x = vectors
    allowed = [int(i) for i in ids if i % 17 == 3]
    frame = spark.createDataFrame([(i,) for i in allowed] * 2, "vec_id long")
    got = found(index.search(queries(spark, 100), 10, probes=1000, looked=10_000, allowed=frame))
    assert got == {q: brute(ids, x, x[ids == q][0], 10, set(allowed)) for q in got} and all(len(v) == 10 for v in got.values())


def test_few_and_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = VectorIndex.build(frame, f"file://{tmp_path}")
    asked = spark.createDataFrame([(5, [3.0, 3.0]), (9, [0.0, 0.0]), (8, None), (None, [1.0, 0.0])], "query_id long, query array<float>")
    got = {}
    for r in index.search(asked, 9, probes=9, others=True).collect():
        got.setdefault(r.query_id, []).append((r.place, r.vec_id, r.similarity))
    assert sorted(got[5]) == [(1, 6, 1.0), (2, 1, 0.707107), (3, 2, 0.707107), (4, 3, 0.0)]
    assert [s for _, _, s in got[9]] == [0.0] * 5 and set(got) == {5, 9}
    with pytest.raises(ValueError):
        VectorIndex.build(frame.limit(0), f"file://{tmp_path}/none")


def test_estimates_are_near_the_cosine(vectors):
    _, x = vectors
    codes = Codes.fit(x, 8)
    own, code = codes.encode(x)
    again = Codes.from_bytes(codes.to_bytes())
    for of in range(2):
        members = x[own == of]
        true = (x[:5] / np.linalg.norm(x[:5], axis=1, keepdims=True)) @ (members / np.linalg.norm(members, axis=1, keepdims=True)).T
        assert np.abs(again.estimates(x[:5], of, code[own == of]) - true).mean() < 0.1
