"""Ranking arithmetic and fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import levels as lv
from evispark.sources.tables import choose

#: Weights of the multi-factor ranker by preset: semantic, evidence, recency, tier, source. Fixed values.
PRESETS = {
    "balanced": (0.4, 0.25, 0.15, 0.1, 0.1),
    "recent_research": (0.3, 0.2, 0.35, 0.1, 0.05),
    "high_evidence": (0.25, 0.45, 0.1, 0.1, 0.1),
}
#: Vector and graph weights by kind of query. Graph first.
QUERY_WEIGHTS = {"factual": (0.7, 0.3), "comparative": (0.8, 0.2), "exploratory": (0.4, 0.6), "evidence": (0.75, 0.25), "procedural": (0.3, 0.7)}
RRF_K = 60


def recency(year: Column, current: int, half_life: float = 5.0) -> Column:
    """Halves every ``half_life`` years, 1 from the current year on, a tenth at least."""
    age = F.lit(current) - year
    return F.when(age <= 0, 1.0).otherwise(F.greatest(F.lit(0.1), F.pow(F.lit(0.5), age / half_life)))


def semantic(vector: Column, graph: Column) -> Column:
    mixed = F.when(graph.isNotNull(), 0.7 * vector + 0.3 * graph).otherwise(vector)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed))


def multi_factor(rows: DataFrame, current_year: int, preset: str = "balanced") -> DataFrame:
    """Adds ``final_score`` from semantic, level, year, tier and source; weights are normalised to one."""
    weights = PRESETS[preset]
    total = sum(weights)
    parts = (
        semantic(F.col("semantic_score"), F.col("graph_score")),
        lv.weight("evidence_level", lv.MULTI_FACTOR, 0.2),
        recency(F.col("year"), current_year),
        F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.6).otherwise(0.2),
        choose("source_type", {"original": 1.0, "background": 0.4}, 0.7),
    )
    score = sum((F.lit(w / total) * p for w, p in zip(weights, parts)), F.lit(0.0))
    return rows.withColumn("final_score", F.round(score, 6))


def design_boost(column: str) -> Column:
    return choose(column, {"meta-analysis": 1.5, "RCT": 1.3, "cohort": 1.1, "case-series": 0.8}, 1.0)


def sample_boost(n: Column) -> Column:
    return F.when(n >= 500, 1.2).when(n >= 100, 1.1).when(n >= 30, 1.0).otherwise(0.9)


def authority(rows: DataFrame, current_year: int) -> Column:
    """Evidence, design, sample and recency multiplied."""
    return lv.weight("evidence_level", lv.HYBRID, 0.1) * sample_boost(F.col("sample_size")) * F.when(F.lit(current_year) - F.col("year") <= 2, 1.1).when(F.lit(current_year) - F.col("year") <= 5, 1.0).otherwise(0.9)


def graph_score(direction: Column, level: str) -> Column:
    boost = F.when(direction == "improved", 1.2).when(direction == "worsened", 0.8).when(direction == "unchanged", 0.9).otherwise(1.0)
    return F.least(F.lit(1.0), lv.weight(level, lv.HYBRID, 0.1) * boost)


# What a concept's distance from the one asked for is worth, by steps.
DISTANCE_SCORES = {0: 1.0, 1: 0.7, 2: 0.4}


def graph_relevance(distance: Column, matches: Column, treats: Column, affects: Column, p_value: Column, effect: Column) -> Column:
    """Relevance of a hit in the graph, from 0 to 1.

    Distance counts 1, 0.7, 0.4 or 0.2; where it isn't known a match counts 1, none 0.3, and
    a query without entities (null) 0.5. Links, p-value and effect size add to it.
    """
    near = F.when(distance.isNull(), F.when(matches.isNull(), 0.5).when(matches, 1.0).otherwise(0.3))
    for steps, score in DISTANCE_SCORES.items():
        near = near.when(distance == steps, score)
    link = F.when(treats, 0.3).when(affects, 0.21).otherwise(0.0)
    strength = F.when(p_value.isNull(), 0.0).when(p_value < 0.01, 0.2).when(p_value < 0.05, 0.14).otherwise(0.06)
    size = F.when(effect >= 0.8, 0.1).when(effect >= 0.5, 0.07).otherwise(0.0)
    return F.least(F.lit(1.0), (near.otherwise(0.2) + link + strength + size) / 1.5)


def three_way(semantic_score: Column, authority_score: Column, relevance: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    """Weighted sum of semantic, authority and graph relevance scores, 1 at most."""
    a, b, c = weights
    return F.least(F.lit(1.0), F.lit(a) * semantic_score + F.lit(b) * authority_score + F.lit(c) * relevance)


def original_first(rows: DataFrame, groups: list[str], most: int) -> DataFrame:
    """Originals before all others, each by score; the ``most`` first of each group, with their place."""
    w = Window.partitionBy(*groups).orderBy(F.desc(F.col("source_type") == "original"), F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scaled to 0..1 over the whole table; all 1 where the range is next to nothing. The range is a one-row aggregate joined back."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    scaled = F.when(F.col("__hi") - F.col("__lo") < 1e-6, 1.0).otherwise((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, scaled).drop("__lo", "__hi")


def merge_adaptive(graph: DataFrame, vector: DataFrame, key: str, kind: str) -> DataFrame:
    """Full outer merge: a weighted sum where both sides have a score, the one score unweighted where one side has."""
    wg, wv = QUERY_WEIGHTS[kind]
    both = graph.join(vector, key, "full_outer")
    g, v = F.coalesce("graph_score", F.lit(0.0)), F.coalesce("vector_score", F.lit(0.0))
    score = F.when((g > 0) & (v > 0), wg * g + wv * v).when(g > 0, g).otherwise(v)
    return both.select(key, F.round(score, 6).alias("score"))


def reciprocal_rank_fusion(lists: dict[str, tuple[DataFrame, float]], key: str, order: list[Column], groups: tuple[str, ...] = (), depth: int = 200) -> DataFrame:
    """Weighted sums of 1 / (60 + rank) over ranked lists, by group.

    Each list is a search's result: the first ``depth`` rows of a group by the order.
    The limit reaches every partition before the shuffle, so a task ranks ``depth`` rows a
    partition at most, whatever the number of groups.
    """
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy(*order)
    out = None
    for df, weight in lists.values():
        part = df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= depth).select(*groups, key, (F.lit(weight) / (RRF_K + F.col("__rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*groups, key).agg(F.round(F.sum("part"), 12).alias("rrf"))


def keep_best(lists: list[DataFrame], key: str, score: str, rest: list[str]) -> DataFrame:
    """Union of lists with one row a key: that of the highest score."""
    out = None
    for df in lists:
        out = df.select(key, score, *rest) if out is None else out.unionByName(df.select(key, score, *rest))
    best = F.max(F.struct(score, *rest))
    return out.groupBy(key).agg(best.alias("x")).select(key, f"x.{score}", *(f"x.{c}" for c in rest))


def fill_tiers(df: DataFrame, groups: list[str], most: int) -> DataFrame:
    """Tier 1 first, then the rest, by score, ``most`` for each group."""
    w = Window.partitionBy(*groups).orderBy("tier", F.desc("score"), "id")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
