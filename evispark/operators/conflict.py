"""Conflicting findings: papers that report opposite directions for one intervention and outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.levels import CONFLICT, weight
from evispark.functions.numeric import rounded

PAIR = ("intervention", "outcome")
DIRECTIONS = ("improved", "worsened", "unchanged")


def severity(top: Column) -> Column:
    return F.when(top >= 9, "critical").when(top >= 7, "high").when(top >= 5, "medium").otherwise("low")


def conflict_report(evidence: DataFrame, least_papers: int = 2) -> DataFrame:
    """One row for each pair with both improved and worsened findings: counts, severity and confidence.

    A single aggregation over the facts. The paper count is distinct, so Spark adds up by pair
    and paper first, which are nearly as many as the facts: where they are large, deal them
    by pair into enough parts beforehand, then they are shuffled once and each task holds few.
    """
    score = weight("evidence_level", CONFLICT, 1.0)
    opposed = F.col("direction").isin("improved", "worsened")
    g = evidence.groupBy(*PAIR).agg(
        F.countDistinct("source_paper_id").alias("n_papers"),
        F.count("*").alias("n_findings"),
        F.count_if(F.col("direction") == "improved").alias("n_improved"),
        F.count_if(F.col("direction") == "worsened").alias("n_worsened"),
        F.count_if(F.col("direction") == "unchanged").alias("n_unchanged"),
        F.max(F.when(opposed, score)).alias("top_score"),
        F.avg(F.when(opposed, score)).alias("mean_score"),
        F.count_if(opposed & F.col("is_significant")).alias("n_significant"),
    )
    g = g.filter((F.col("n_papers") >= least_papers) & (F.col("n_improved") > 0) & (F.col("n_worsened") > 0))
    both = (F.col("n_improved") + F.col("n_worsened")).cast("double")
    balance = 1 - 2 * F.abs(0.5 - F.least("n_improved", "n_worsened") / both)
    confidence = (
        F.lit(0.2) * F.least(F.lit(1.0), F.col("n_findings") / 10)
        + F.lit(0.4) * F.col("mean_score") / 10
        + F.lit(0.3) * F.col("n_significant") / both
        + F.lit(0.1) * balance
    )
    ratio = F.least("n_improved", "n_worsened") / F.col("n_findings")
    return g.select(
        *PAIR, "n_papers", "n_improved", "n_worsened", "n_unchanged", "n_significant",
        severity(F.col("top_score")).alias("severity"), rounded(confidence, 4).alias("confidence"), F.round(ratio, 4).alias("conflict_ratio"),
    )


def opposed_pairs(affects: DataFrame, keys: tuple[str, ...] = PAIR, mirrored: bool = True) -> DataFrame:
    """Pairs of significant facts that share ``keys``, come from different papers and point in different directions.

    An equi-join on the keys; for a report over all pairs use ``conflict_report``, which
    doesn't build them. Mirrored: both orders of a pair.
    """
    a, b = affects.alias("a"), affects.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    other = F.col("a.source_paper_id") != F.col("b.source_paper_id") if mirrored else F.col("a.source_paper_id") < F.col("b.source_paper_id")
    differ = F.col("a.direction") != F.col("b.direction")
    return a.join(b, [*on, other, differ])


def opposed_counts(affects: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """For each key the number of ordered pairs of facts of different papers and directions, and the closest two such papers.

    No pair is built: pairs are counted from totals by direction and by paper, and the
    closest paper of another direction is the last one before in a window ordered by paper.
    """
    own = affects.groupBy(*keys, "source_paper_id", "direction").agg(F.count("*").alias("n"))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    by_paper = own.groupBy(*keys, "source_paper_id").agg((F.pow(F.sum("n"), 2) - square("n")).alias("same_paper"), F.sum("n").alias("n"))
    by_paper = by_paper.groupBy(*keys).agg(F.sum("same_paper").alias("same_paper"), F.sum("n").alias("total"))
    by_direction = own.groupBy(*keys, "direction").agg(F.sum("n").alias("n")).groupBy(*keys).agg(square("n").alias("same_direction"))
    before = Window.partitionBy(*keys).orderBy("source_paper_id").rangeBetween(Window.unboundedPreceding, -1)
    # the last paper before may have the same direction only, so the last of each direction is looked at
    seen = F.array(*(F.when(F.col("direction") != d, F.max(F.when(F.col("direction") == d, F.col("source_paper_id"))).over(before)) for d in DIRECTIONS))
    closest = own.withColumn("gap", F.col("source_paper_id") - F.array_max(seen)).groupBy(*keys).agg(F.min("gap").alias("closest"))
    n_pairs = (F.col("total") * F.col("total") - F.col("same_direction") - F.col("same_paper")).cast("long")
    return by_paper.join(by_direction, [*keys]).withColumn("n_pairs", n_pairs).filter("n_pairs > 0").join(closest, [*keys]).select(*keys, "n_pairs", "closest")


def gap_conflicts(studies: DataFrame, keys: tuple[str, ...] = PAIR, least_gap: float = 5.0) -> DataFrame:
    """Unordered pairs of studies whose evidence scores lie ``least_gap`` apart, counted for each key.

    Only counts by score are joined (seven scores at most a key), never the studies.
    """
    scored = studies.withColumn("score", weight("evidence_level", CONFLICT, 1.0)).groupBy(*keys, "score").agg(F.count("*").alias("n"))
    a, b = scored.alias("a"), scored.alias("b")
    pairs = a.join(b, [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys), F.col("a.score") - F.col("b.score") >= least_gap])
    top = F.col("a.score")
    kind = F.when(top >= 9, "high").when(top >= 7, "medium").otherwise("low")
    return pairs.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), kind.alias("severity")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("n_pairs"))
