"""Inference rules on a small graph with a diamond, by hand."""

from evispark.operators import hierarchy
from evispark.operators.inference import run_rule

#: d is below b and c, both below a; a is below top. e has no hierarchy.
IS_A = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", "top"), ("d", "b")]
FACTS = [
    ("d", "pain", 1, "improved", 0.01, True), ("d", "pain", 1, "worsened", 0.02, True), ("d", "pain", 2, "unchanged", 0.03, True), ("d", "pain", 3, "worsened", 0.2, False),
    ("b", "pain", 4, "worsened", 0.04, True), ("a", "pain", 5, "improved", 0.01, True), ("a", "fusion", 5, "improved", 0.5, False), ("a", "fusion", 6, "improved", 0.03, True),
    ("top", "pain", 7, "improved", 0.001, True), ("e", "pain", 8, None, 0.01, True),
]


def tables(spark):
    facts = spark.createDataFrame([(e, e, o, p, d, v, s, 1.0) for e, o, p, d, v, s in FACTS], "entity string, intervention string, outcome string, source_paper_id long, direction string, p_value double, is_significant boolean, effect double")
    return {
        "is_a": spark.createDataFrame(IS_A, "child string, parent string"),
        "facts": facts,
        "treats": spark.createDataFrame([("a", "stenosis"), ("d", "fracture"), ("top", "stenosis")], "entity string, pathology string"),
        "investigates": spark.createDataFrame([(1, "d"), (1, "b"), (1, "b"), (1, "a"), (2, "d"), (5, "a"), (6, "b")], "paper_id long, intervention string"),
        "papers": spark.createDataFrame([(i, 2000 + i, "1b") for i in range(1, 9)], "paper_id long, year int, evidence_level string"),
    }


def ran(spark, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in run_rule(name, **tables(spark)).collect()), key=str)


def test_reach_takes_a_diamond_once(spark):
    found = {(r.node, r.ancestor): r.distance for r in hierarchy.reach(tables(spark)["is_a"], 2).collect()}
    assert found[("d", "a")] == 2 and found[("d", "d")] == 0 and ("d", "top") not in found and found[("b", "top")] == 2
    assert hierarchy.reach(tables(spark)["is_a"], 2).count() == len(found) == 5 + 5 + 3


def test_evidence_comes_from_above(spark):
    """A node has its own and its ancestors' findings, not its descendants'."""
    found = ran(spark, "aggregate_evidence", "node", "entity", "outcome", "direction", "hierarchy_distance", "n_findings", "n_significant", "least_p")
    assert ("d", "a", "pain", "improved", 2, 1, 1, 0.01) in found and ("d", "a", "fusion", "improved", 2, 2, 1, 0.03) in found
    assert ("d", "d", "pain", "worsened", 0, 2, 1, 0.02) in found
    assert {e for n, e, *_ in found if n == "a"} == {"a", "top"} and {e for n, e, *_ in found if n == "d"} == {"d", "b", "a"}


def test_the_same_ancestor_treats_and_has_the_findings(spark):
    found = ran(spark, "aggregate_evidence_by_pathology", "node", "pathology", "entity", "outcome", "direction", "hierarchy_distance", "n_findings")
    assert [x for x in found if x[0] == "d"] == [
        ("d", "fracture", "d", "pain", "improved", 0, 1), ("d", "fracture", "d", "pain", "unchanged", 0, 1), ("d", "fracture", "d", "pain", "worsened", 0, 1),
        ("d", "stenosis", "a", "fusion", "improved", 2, 1), ("d", "stenosis", "a", "pain", "improved", 2, 1),
    ]
    assert not any(x[2] == "b" for x in found)  # b has findings but treats nothing


def test_conflicts_are_of_different_papers_and_any_two_directions(spark):
    # d: paper 1 improved and worsened (not against each other), paper 2 unchanged: 2 pairs, both ways
    assert ran(spark, "conflict_detection", "entity", "outcome", "n_pairs") == [("d", "pain", 4)]


def test_conflicts_across_interventions_pair_findings(spark):
    pain = [(e, d) for e, o, _, d, _, s in FACTS if o == "pain" and s and d]
    pairs = sum(a[0] < b[0] and a[1] != b[1] for a in pain for b in pain)
    assert ran(spark, "cross_intervention_conflicts", "outcome", "n_entities", "n_conflicts") == [("pain", 4, pairs)]


def test_comparison_papers(spark):
    found = ran(spark, "comparison_papers", "paper_id", "intervention", "compared_with", "num_comparisons", "year")
    assert found == [(1, "a", "b,d", 2, 2001), (1, "b", "a,d", 2, 2001), (1, "d", "a,b", 2, 2001)]


def test_combined_outcomes_keep_every_finding(spark):
    found = ran(spark, "combined_outcomes", "entity", "outcome", "source_paper_id", "evidence_level")
    assert len(found) == len(FACTS) and ("d", "pain", 1, "1b") in found and ("d", "pain", 3, None) in found and ("b", "pain", 4, None) in found


def test_treatment_at_the_least_distance(spark):
    assert ran(spark, "transitive_treatment", "node", "pathology", "hierarchy_distance") == [
        ("a", "stenosis", 0), ("b", "stenosis", 1), ("c", "stenosis", 1), ("d", "fracture", 0), ("d", "stenosis", 2), ("top", "stenosis", 0)
    ]
