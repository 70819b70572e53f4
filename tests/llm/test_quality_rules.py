"""The estimate of rules' accuracies, and verdicts that differ from requiring every rule to pass."""

import random

import duckdb
import numpy as np
import pytest

from evispark.llm import quality_rules
from evispark.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def simulated(n=20000, seed=0):
    """Votes of seven rules: on a bad document half of the rules see the defect, good ones are blamed at a rate of its own by each rule."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.85
    blame, see = np.array([0.15, 0.1, 0.02, 0.01, 0.005, 0.01, 0.02]), np.array([0.5, 0.6, 0.7, 0.6, 0.5, 0.8, 0.6])
    bad_vote = np.where(good[:, None], rng.random((n, 7)) < blame, rng.random((n, 7)) < see)
    return good, np.where(rng.random((n, 7)) < 0.2, 2, np.where(bad_vote, 0, 1)), blame, see


def test_estimate_recovers_accuracies():
    good, votes, blame, see = simulated()
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, right, _ = quality_rules.estimate(patterns, counts.astype(float))
    assert abs(share - good.mean()) < 0.02
    np.testing.assert_allclose(right[:, 1], 1 - blame, atol=0.02)
    np.testing.assert_allclose(right[:, 0], see, atol=0.05)


def test_posterior_equals_direct_bayes():
    _, votes, _, _ = simulated(500)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, right, posterior = quality_rules.estimate(patterns, counts.astype(float), rounds=2000, tol=1e-12)
    for row, p in zip(patterns, posterior):
        like = [1 - share, share]
        for rule, vote in enumerate(row):
            if vote != quality_rules.ABSTAIN:
                like = [like[k] * (right[rule, k] if vote == k else 1 - right[rule, k]) for k in (0, 1)]
        assert abs(like[1] / sum(like) - p) < 1e-6


def test_posterior_beats_all_must_pass_when_rules_are_noisy():
    good, votes, _, _ = simulated(seed=1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    kept = quality_rules.estimate(patterns, counts.astype(float))[2][back] >= 0.5
    all_pass = ~(votes == 0).any(axis=1)
    assert (kept == good).mean() > 0.97 and (kept == good).mean() > (all_pass == good).mean() + 0.1
    majority = (votes == 1).sum(axis=1) >= (votes == 0).sum(axis=1)
    assert (kept == good).mean() > (majority == good).mean()


def test_verdicts_on_documents(spark):
    """Against labels that the rules never see: fewer clean documents fall than when all rules must pass, and junk is found beyond the base rule."""
    con = duckdb.connect()
    label = dict(con.execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    rows = QUERIES["op7_quality_rules"](spark, SF).collect()
    found = quality_rules.apply_quality_rules(spark.read.parquet(f"{SF}/documents.parquet"))
    blamed = {r.doc_id for r in found.collect() if "0" in r.votes or r.base_failed}
    assert len(rows) == con.execute(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchone()[0]
    assert not any(r.kept and r.base_failed for r in rows)
    known = [r for r in rows if r.doc_id in label]
    bad = [r for r in known if label[r.doc_id] == 0]
    fine = [r for r in known if label[r.doc_id] == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) > 0.95 * len(bad) > 1.2 * sum(r.base_failed for r in bad)
    assert all(r.kept for r in fine)
    assert any(r.kept and r.doc_id in blamed for r in rows)


def test_counts_of_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(1)
    text = " ".join(rng.choices("the of and plain words in this text here".split(), k=70))
    df = spark.createDataFrame([(1, text, 5, "x"), (1, text, 6, "y"), (2, None, 7, None), (3, "", 8, "z"), (None, "### " * 50, 9, "w")], "doc_id long, text string, n_words int, votes string")
    found = quality_rules.apply_quality_rules(df, ["doc_id", "n_words", "votes"]).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in found) == [(-1, 50), (1, 70), (1, 70), (2, 0), (3, 0)]
    assert all(r.base_failed and not r.kept for r in found if r.doc_id in (2, 3))


@pytest.mark.parametrize("text, plain, stop", [("the Cat, sat! on... x1 é", 4, 1), ("", 0, 0), ("a|b c", 1, 0)])
def test_plain_and_function_words(text, plain, stop):
    counts = dict(zip(quality_rules.COUNTS, quality_rules.text_counts(text)))
    assert (counts["n_plain"], counts["n_stop"]) == (plain, stop)
