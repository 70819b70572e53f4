"""Citation networks, evidence for claims, and scores that follow the hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.operators.filters import best_per_group

# What a step in the hierarchy costs, and how far a synthesis' strength moves a chain's confidence.
BOOST_BY_DISTANCE = (1.0, 0.85, 0.7)
BOOST_ELSEWHERE = 0.5
BOOST_BY_STRENGTH = {"strong": 1.2, "moderate": 1.0, "weak": 0.8, "insufficient": 0.5}


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` into so many parts; without a number as Spark decides."""
    return df.repartition(parts, *keys) if parts else df


def followers(cites: DataFrame, depth: int = 3, parts: int | None = None) -> DataFrame:
    """(paper, root, depth): papers that build on a root over one to ``depth`` citations, at their least depth.

    Breadth first: each step starts from the distinct pairs of the step before, so a dense
    network costs its pairs, not its trails. Pairs found at several depths are told apart
    once, at the end. ``parts``: in how many the pairs are dealt.
    """
    steps = dealt(cites.select(F.col("source").alias("via"), F.col("target").alias("next")), parts, "via").distinct()
    level = cites.select(F.col("source").alias("paper"), F.col("target").alias("root"))
    out = level.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        level = dealt(level, parts, "paper", "root").distinct() if d > 2 else level
        level = dealt(level, parts, "root").join(steps, F.col("root") == F.col("via")).select("paper", F.col("next").alias("root"))
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return dealt(out.filter("paper <> root"), parts, "paper", "root").groupBy("paper", "root").agg(F.min("depth").alias("depth"))


def ego(cites: DataFrame, depth: int = 2, centres: DataFrame | None = None) -> DataFrame:
    """(node, neighbour, distance): what lies within ``depth`` steps of a node either way, at the least distance.

    ``centres`` (node) limits the nodes whose surroundings are wanted, before any step is taken.
    """
    steps = cites.select(F.col("source").alias("node"), F.col("target").alias("neighbour"))
    steps = steps.unionByName(cites.select(F.col("target").alias("node"), F.col("source").alias("neighbour"))).filter("node <> neighbour").distinct()
    level = steps if centres is None else steps.join(centres.select("node").distinct(), "node", "left_semi")
    out = level.withColumn("distance", F.lit(1))
    for d in range(2, depth + 1):
        ahead = steps.select(F.col("node").alias("via"), F.col("neighbour").alias("next"))
        level = level.join(ahead, F.col("neighbour") == F.col("via")).select("node", F.col("next").alias("neighbour")).filter("node <> neighbour").distinct()
        out = out.unionByName(level.withColumn("distance", F.lit(d)))
    return out.groupBy("node", "neighbour").agg(F.min("distance").alias("distance"))


def citing(cites: DataFrame, papers: DataFrame, supporting: Sequence[str] = ("supports",), contradicting: Sequence[str] = ("contradicts",)) -> DataFrame:
    """For each cited paper: who cites it, for and against, the best confidence and the newest citing year."""
    by = cites.join(papers.select(F.col("paper_id").alias("source"), "year"), "source")
    return by.groupBy(F.col("target").alias("paper_id")).agg(
        F.count("*").alias("n_citing"),
        F.count_if(F.col("context").isin(*supporting)).alias("n_supporting"),
        F.count_if(F.col("context").isin(*contradicting)).alias("n_contradicting"),
        F.max("confidence").alias("best_confidence"),
        F.max("year").alias("newest_year"),
    )


def citation_confidence(cited_year: Column, year: Column, cited_authors: Column, authors: Column) -> Column:
    """How well a citation fits a paper: the year counts 0.4 (half of it a year off), the share of authors found 0.6.

    What the citation doesn't say is left out of the balance; one half if it says nothing.
    """
    names = F.size(F.coalesce(cited_authors, F.array().cast("array<string>")))
    some, gap = names > 0, F.abs(F.coalesce(year, F.lit(-9999)) - cited_year)
    from_year = F.when(cited_year.isNull(), 0.0).when(gap == 0, 0.4).when(gap == 1, 0.2).otherwise(0.0)
    found = F.coalesce(F.size(F.array_intersect(cited_authors, authors)), F.lit(0))
    from_names = F.when(some, 0.6 * F.greatest(found, F.lit(0)) / names.cast("double")).otherwise(0.0)
    most = F.when(cited_year.isNull(), 0.0).otherwise(0.4) + F.when(some, 0.6).otherwise(0.0)
    return F.when(most == 0, 0.5).otherwise(F.try_divide(from_year + from_names, most))


def stances(claims: DataFrame, facts: DataFrame, parts: int | None = None) -> DataFrame:
    """(claim_id, paper, stance) of every paper with facts on a claim's outcome.

    ``claims``: (claim_id, outcome, claimed, opposite). A paper whose facts point only the
    claimed way supports, one whose facts point only the opposite way refutes, all others
    are neutral. A paper has few facts on an outcome, so counting them before the join would
    only hold and shuffle nearly all rows once more. ``parts``: in how many the papers are dealt.
    """
    met = facts.join(claims, "outcome").select("claim_id", "source_paper_id", (F.col("direction") == F.col("claimed")).alias("yes"), (F.col("direction") == F.col("opposite")).alias("no"))
    met = dealt(met, parts, "claim_id", "source_paper_id").groupBy("claim_id", "source_paper_id").agg(F.max("yes").alias("yes"), F.max("no").alias("no"))
    stance = F.when(F.col("yes") & ~F.col("no"), "supporting").when(F.col("no") & ~F.col("yes"), "refuting").otherwise("neutral")
    return met.select("claim_id", F.col("source_paper_id").alias("paper_id"), stance.alias("stance"))


def chain_confidence(scored: DataFrame, keys: Sequence[str], score: str, order: Sequence[Column], strength: str | None = None, most: int = 5) -> DataFrame:
    """Mean of each group's first ``most`` scores, moved by the strength of its synthesis, one at most."""
    boost = F.lit(1.0)
    if strength is not None:
        for name, factor in BOOST_BY_STRENGTH.items():
            boost = F.when(F.col(strength) == name, factor).otherwise(boost)
    first = best_per_group(scored.withColumn("__boost", boost), keys, order, most)
    value = F.avg(score) * F.max("__boost")
    return first.groupBy(*keys).agg(F.round(F.least(F.lit(1.0), value), 6).alias("confidence"))


def reviews(*memberships: tuple[DataFrame, str], least: int = 4, key: str = "paper_id") -> DataFrame:
    """Papers that have ``least`` or more members in every one of the given tables."""
    out = None
    for df, column in memberships:
        part = df.groupBy(key).agg(F.count_distinct(column).alias(f"n_{column}")).filter(F.col(f"n_{column}") >= least)
        out = part if out is None else out.join(part, key)
    return out


def supplement(local: DataFrame, extra: DataFrame, keys: DataFrame, key: str, least: int) -> DataFrame:
    """Local rows, and the extra rows of those keys that have fewer than ``least`` local ones; ``origin`` tells them apart."""
    n = local.groupBy(key).agg(F.count("*").alias("__n"))
    short = keys.select(key).distinct().join(n, key, "left").filter(F.coalesce("__n", F.lit(0)) < least).select(key)
    added = extra.join(short, key, "left_semi").withColumn("origin", F.lit("extra"))
    return local.withColumn("origin", F.lit("local")).unionByName(added.select(*local.columns, "origin"))


def first_per_document(hits: DataFrame, document: str, order: Sequence[Column], most: int) -> DataFrame:
    """The feature itself: the best hit of each document, of these the first ``most``."""
    return best_per_group(hits, [document], order, 1).drop("rank").orderBy(*order).limit(most)


def distance_boost(up: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, distance, boost): how near a node lies to the nearest target, up or down the hierarchy within two steps."""
    near = up.filter(F.col("distance") < len(BOOST_BY_DISTANCE)).select("node", "ancestor", "distance")
    wanted = targets.select(F.col("node").alias("target")).distinct()
    higher = near.join(wanted, F.col("ancestor") == F.col("target")).select("node", "distance")
    lower = near.join(wanted, F.col("node") == F.col("target")).select(F.col("ancestor").alias("node"), "distance")
    found = wanted.select(F.col("target").alias("node"), F.lit(0).alias("distance")).unionByName(higher).unionByName(lower)
    least = found.groupBy("node").agg(F.min("distance").alias("distance"))
    boost = F.lit(BOOST_ELSEWHERE)
    for d, factor in enumerate(BOOST_BY_DISTANCE):
        boost = F.when(F.col("distance") == d, factor).otherwise(boost)
    return nodes.select("node").distinct().join(least, "node", "left").withColumn("boost", boost)
