"""Evidence synthesis: weighted pooling, heterogeneity, direction, strength and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.levels import SYNTHESIS, weight

PAIR = ("intervention", "outcome")


def pooled(facts: DataFrame, value: str, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Weighted mean, weighted population variance, standard error and 95 % interval by key.

    Two passes: the mean first, then deviations from it, as the moment form cancels for
    large means. The means have a row a key and join back on the key. The mean's two sums
    are rounded to nine digits, beyond which they depend on the order of rows, so that a
    mean that lies on a rounding boundary comes out alike each time.
    """
    w = weight("evidence_level", SYNTHESIS, 0.1)
    x = facts.withColumn("w", w).withColumn("x", F.col(value).cast("double"))
    total = lambda c: F.round(F.sum(c), 9)
    means = x.groupBy(*keys).agg(total("w").alias("sw"), F.try_divide(total(F.col("w") * F.col("x")), total("w")).alias("mean"), F.count("*").alias("n"))
    spread = x.join(means, [*keys]).groupBy(*keys, "mean", "n", "sw").agg(F.sum(F.col("w") * F.pow(F.col("x") - F.col("mean"), 2)).alias("ss"))
    se = F.sqrt(F.col("ss") / F.col("sw")) / F.sqrt("n")
    return spread.select(
        *keys, "n", F.round("mean", 6).alias("pooled_mean"), F.round(se, 6).alias("std_error"),
        F.round(F.col("mean") - 1.96 * se, 6).alias("ci_low"), F.round(F.col("mean") + 1.96 * se, 6).alias("ci_high"),
    )


def heterogeneity(n: Column, mean: Column, sd: Column) -> Column:
    """low, moderate or high by the coefficient of variation in percent."""
    cv = F.when(mean == 0, 0.0).otherwise(F.try_divide(sd, F.abs(mean)) * 100)
    return F.when(n < 2, "low").when(cv < 10, "low").when(cv < 30, "moderate").otherwise("high")


def strength(n: Column, high_level: Column, significant: Column, mode_share: Column) -> Column:
    """strong, moderate, weak or insufficient; rules in order."""
    return (
        F.when(n < 2, "insufficient")
        .when((n >= 3) & (high_level >= 2) & (significant >= 0.7) & (mode_share >= 0.8), "strong")
        .when((n >= 2) & (significant >= 0.5) & (mode_share >= 0.6), "moderate")
        .otherwise("weak")
    )


def grade(first_level: Column, variation: Column, strong: Column) -> Column:
    """A to D: where the best level starts, lowered by heterogeneity and weakness."""
    start = F.when(first_level.isin("1a", "1b"), 0).when(first_level.isin("2a", "2b"), 1).when(first_level == "3", 2).otherwise(3)
    down = F.when(variation == "high", 2).when(variation == "moderate", 1).otherwise(0) + F.when(strong == "weak", 1).when(strong == "insufficient", 2).otherwise(0)
    return F.element_at(F.array(*map(F.lit, "ABCD")), F.least(F.lit(3), start + down) + 1)


def synthesize(facts: DataFrame, value: str, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """Direction, heterogeneity, strength and grade by key, from one aggregation."""
    kinds = ("improved", "worsened", "unchanged")
    x = F.col(value).cast("double")
    g = facts.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("m"),
        F.stddev_samp(x).alias("sd"),
        F.count_if(F.col("evidence_level").isin("1a", "1b")).alias("high_level"),
        F.avg(F.col("is_significant").cast("double")).alias("significant"),
        F.min("evidence_level").alias("first_level"),
        *(F.count_if(F.col("direction") == k).alias(k) for k in kinds),
    )
    share = lambda k: F.col(k) / F.col("n")
    direction = F.lit("mixed")
    for k in reversed(kinds):
        direction = F.when(share(k) >= 0.7, k).otherwise(direction)
    g = g.withColumn("direction", direction).withColumn("mode_share", F.greatest(*(share(k) for k in kinds)))
    g = g.withColumn("heterogeneity", heterogeneity(F.col("n"), F.col("m"), F.col("sd")))
    g = g.withColumn("strength", strength(F.col("n"), F.col("high_level"), F.col("significant"), F.col("mode_share")))
    return g.select(*keys, "n", "direction", "heterogeneity", "strength", grade(F.col("first_level"), F.col("heterogeneity"), F.col("strength")).alias("grade"))


def i_squared(effects: DataFrame, effect: str, variance: str, keys: tuple[str, ...]) -> DataFrame:
    """Inverse-variance I-squared (0 to 100) by key; a variance of zero or less has no weight; fewer than two studies give 0."""
    w = F.when(F.col(variance) > 0, 1 / F.col(variance)).otherwise(0.0)
    x = effects.select(*keys, F.col(effect).cast("double").alias("x"), w.alias("w"))
    means = x.groupBy(*keys).agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("m"), F.count("*").alias("n"))
    q = x.join(means, [*keys]).groupBy(*keys, "n").agg(F.sum(F.col("w") * F.pow(F.col("x") - F.col("m"), 2)).alias("q"))
    share = F.when((F.col("n") < 2) | F.col("q").isNull() | (F.col("q") <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("q") - (F.col("n") - 1)) / F.col("q") * 100))
    return q.select(*keys, "n", F.round(share, 4).alias("i_squared"))


def supporting_split(facts: DataFrame, keys: tuple[str, ...] = PAIR, most: int = 5) -> DataFrame:
    """For each key the numbers of papers for and against the majority direction, and the first ``most`` of each side, by number.

    Papers are ranked by side before they are gathered, so a list never holds more than ``most``.
    """
    votes = facts.filter(F.col("direction").isin("improved", "worsened"))
    g = votes.groupBy(*keys).agg(F.count_if(F.col("direction") == "improved").alias("up"), F.count_if(F.col("direction") == "worsened").alias("down"))
    side = votes.join(g.withColumn("main", F.when(F.col("up") >= F.col("down"), "improved").otherwise("worsened")), [*keys])
    papers = side.select(*keys, (F.col("direction") == F.col("main")).alias("supports"), "source_paper_id").distinct()
    counts = papers.groupBy(*keys).agg(F.count_if("supports").alias("n_supporting"), F.count_if(~F.col("supports")).alias("n_opposing"))
    w = Window.partitionBy(*keys, "supports").orderBy("source_paper_id")
    first = papers.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    listed = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(side, F.col("source_paper_id")))), ",")
    lists = first.groupBy(*keys).agg(listed(F.col("supports")).alias("supporting"), listed(~F.col("supports")).alias("opposing"))
    return counts.join(lists, [*keys])
