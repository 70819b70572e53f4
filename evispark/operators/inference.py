"""Inference rules as a registry of DataFrame builders over the graph's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.operators.conflict import opposed_counts
from evispark.operators.hierarchy import reach
from evispark.operators.pairs import pairs_within


@dataclass(frozen=True)
class Rule:
    name: str
    weight: float
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]


RULES: dict[str, Rule] = {}


def rule(name: str, weight: float, *needs: str):
    def add(build):
        RULES[name] = Rule(name, weight, needs, build)
        return build

    return add


def run_rule(name: str, **tables: DataFrame) -> DataFrame:
    """The rule's rows with its weight. Unknown rules and missing tables are errors."""
    if name not in RULES:
        raise KeyError(f"no rule {name}; there are {', '.join(sorted(RULES))}")
    found = RULES[name]
    missing = [n for n in found.needs if n not in tables]
    if missing:
        raise ValueError(f"rule {name} needs {', '.join(missing)}")
    return found.build(*(tables[n] for n in found.needs)).withColumn("rule_weight", F.lit(found.weight))


@rule("transitive_hierarchy", 1.0, "up")
def transitive_hierarchy(up):
    return up.select("node", "ancestor", "distance")


@rule("transitive_descendants", 1.0, "up")
def transitive_descendants(up):
    return up.select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "distance")


@rule("transitive_treatment", 0.8, "is_a", "treats")
def transitive_treatment(is_a, treats):
    """What a node treats through itself or an ancestor up to three steps away, at the least distance."""
    near = reach(is_a, 3)
    return near.join(treats, near.ancestor == treats.entity).groupBy("node", "pathology").agg(F.min("distance").alias("hierarchy_distance"))


@rule("indirect_treatment", 0.7, "is_a", "treats")
def indirect_treatment(is_a, treats):
    """As above, but only where the node has no treatment link of its own."""
    found = transitive_treatment(is_a, treats)
    direct = treats.select(F.col("entity").alias("node"), "pathology")
    return found.join(direct, ["node", "pathology"], "left_anti")


@rule("comparable_siblings", 0.9, "is_a")
def comparable_siblings(is_a):
    same = pairs_within(is_a, ["parent"], "child")
    return same.select(F.col("a.child").alias("first"), F.col("b.child").alias("second"), F.col("a.parent").alias("parent"))


@rule("comparable_by_category", 0.7, "intervention")
def comparable_by_category(intervention):
    same = pairs_within(intervention.select("intervention", "category"), ["category"], "intervention")
    return same.select(F.col("a.intervention").alias("first"), F.col("b.intervention").alias("second"), F.col("a.category").alias("category"))


@rule("comparison_papers", 1.0, "investigates", "papers")
def comparison_papers(investigates, papers):
    """(paper_id, intervention, compared_with, num_comparisons, year, evidence_level): what else a paper investigates.

    A row for each intervention of a paper that has another one; a paper's interventions
    are gathered once.
    """
    both = investigates.select("paper_id", "intervention").distinct()
    every = both.groupBy("paper_id").agg(F.array_sort(F.collect_list("intervention")).alias("every")).filter("size(every) > 1")
    rows = every.select("paper_id", "every", F.explode("every").alias("intervention"))
    others = F.array_join(F.transform(F.array_remove("every", F.col("intervention")), lambda x: x.cast("string")), ",")
    rows = rows.select("paper_id", "intervention", others.alias("compared_with"), (F.size("every") - 1).cast("long").alias("num_comparisons"))
    return rows.join(papers.select("paper_id", "year", "evidence_level"), "paper_id")


@rule("aggregate_evidence", 0.9, "is_a", "facts")
def aggregate_evidence(is_a, facts):
    """Findings of a node and of its ancestors up to two steps above, counted by the entity that has them, outcome and direction.

    Facts are counted by entity before they meet the hierarchy, so the join carries counts.
    """
    counts = facts.groupBy("entity", "outcome", "direction").agg(
        F.count("*").alias("n_findings"), F.count_if("is_significant").alias("n_significant"), F.min("p_value").alias("least_p")
    )
    near = reach(is_a, 2).withColumnRenamed("distance", "hierarchy_distance")
    met = near.join(counts, near.ancestor == counts.entity)
    return met.select("node", "entity", "outcome", "direction", "hierarchy_distance", "n_findings", "n_significant", "least_p")


@rule("aggregate_evidence_by_pathology", 0.85, "is_a", "treats", "facts")
def aggregate_evidence_by_pathology(is_a, treats, facts):
    """Significant findings of a node, or of an ancestor up to two steps above, that itself treats the pathology."""
    counts = facts.filter("is_significant").groupBy("entity", "outcome", "direction").agg(F.count("*").alias("n_findings"), F.min("p_value").alias("least_p"))
    near = reach(is_a, 2).select("node", F.col("ancestor").alias("entity"), F.col("distance").alias("hierarchy_distance"))
    met = near.join(counts, "entity").join(treats.select("entity", "pathology").distinct(), "entity")
    return met.select("node", "pathology", "entity", "outcome", "direction", "hierarchy_distance", "n_findings", "least_p")


@rule("combined_outcomes", 1.0, "facts", "investigates", "papers")
def combined_outcomes(facts, investigates, papers):
    """Each outcome's evidence on an entity, a row a finding, with the level of its paper where the paper investigates the entity.

    Rows, as a list of all the evidence on an outcome has no bound.
    """
    level = investigates.join(papers.select("paper_id", "evidence_level"), "paper_id").select(F.col("paper_id").alias("source_paper_id"), "intervention", "evidence_level").distinct()
    rows = facts.join(level, ["source_paper_id", "intervention"], "left")
    return rows.select("entity", "outcome", "source_paper_id", "direction", "p_value", "is_significant", "effect", "evidence_level")


@rule("conflict_detection", 1.0, "facts")
def conflict_detection(facts):
    """Ordered pairs of significant findings of different papers and directions on one entity and outcome, counted without being built."""
    told = facts.filter("is_significant AND direction IS NOT NULL")
    return opposed_counts(told, ("entity", "outcome")).select("entity", "outcome", "n_pairs")


@rule("cross_intervention_conflicts", 1.0, "facts")
def cross_intervention_conflicts(facts):
    """For each outcome the pairs of significant findings of different entities that differ in direction.

    All pairs that differ less those within an entity, each from squares of totals.
    """
    own = facts.filter("is_significant AND direction IS NOT NULL").groupBy("outcome", "entity", "direction").agg(F.count("*").cast("decimal(19,0)").alias("n"))
    square = lambda c: (F.col(c) * F.col(c)).cast("decimal(38,0)")
    total = lambda c: F.sum(c).cast("decimal(19,0)")
    entities = own.groupBy("outcome", "entity").agg(total("n").alias("n"), F.sum(square("n")).alias("same"))
    entities = entities.groupBy("outcome").agg(total("n").alias("n"), F.sum(square("n") - F.col("same")).alias("within"), F.count("*").alias("n_entities"))
    directions = own.groupBy("outcome", "direction").agg(total("n").alias("d")).groupBy("outcome").agg(F.sum(square("d")).alias("alike"))
    pairs = F.expr("(n * n - alike - within) DIV 2").cast("long")
    return entities.join(directions, "outcome").select("outcome", "n_entities", pairs.alias("n_conflicts")).filter("n_conflicts > 0")
