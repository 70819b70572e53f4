"""Filters, key look-ups and star reads over the graph's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from evispark.functions.levels import ORDER


def acceptable_levels(least: str) -> list[str]:
    """The levels at least as strong as ``least``; all where it isn't in the list."""
    return list(ORDER[: ORDER.index(least) + 1]) if least in ORDER else list(ORDER)


def optional(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All given conditions together; None stands for a filter that isn't set."""
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def newest(papers: DataFrame, most: int) -> DataFrame:
    """The feature itself: the newest ``most`` papers, ties by identifier."""
    return papers.orderBy(F.desc_nulls_first("year"), "paper_id").limit(most)


def level_filter(papers: DataFrame, levels: Sequence[str] | None = None, domains: Sequence[str] | None = None) -> DataFrame:
    """Papers of the given levels and sub-domains; None means no filter."""
    return optional(papers, F.col("evidence_level").isin(*levels) if levels else None, F.col("sub_domain").isin(*domains) if domains else None)


def visible(rows: DataFrame, user, owner: str = "owner", shared: Column | None = None) -> DataFrame:
    """What a user may see: own rows and shared ones; ``system`` sees all."""
    return rows if user == "system" else rows.filter((F.col(owner) == user) | (shared if shared is not None else F.lit(False)))


def exact_or_like(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose column equals the name; only if there is none, those that contain its first word or lie within it.

    One pass: a flag, and its maximum over all candidates from a one-row aggregate that
    is joined back, so no driver round trip decides.
    """
    first = name.split(" ")[0].lower()
    low = F.lower(column)
    like = rows.filter((F.col(column) == name) | low.contains(first) | F.lit(name.lower()).contains(low)).withColumn("exact", F.col(column) == name)
    any_exact = like.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("any_exact"))
    return like.crossJoin(F.broadcast(any_exact)).filter(F.col("exact") == F.col("any_exact")).drop("any_exact")


def without_partner(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key).distinct(), key, "left_anti")


def best_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark keeps a partial top-k map-side for row_number filters."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
