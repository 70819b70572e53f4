"""Entity normalisation: names to canonical names through an alias table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BROADCAST = 10_000  # aliases


def key(name: Column) -> Column:
    """Lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key(name), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over Python integers."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & where.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - bin(rows).count("1")


def ratio(a: str, b: str) -> float:
    """2 * LCS / (both lengths), from 0 to 1; 1 for two empty texts."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0


def indel_ratio(a: str, b: str) -> Column:
    """The ratio of two text columns, by an Arrow-batched function."""
    batch = F.pandas_udf(lambda x, y: pd.Series([ratio(p, q) for p, q in zip(x, y)], dtype=float), "double")
    return batch(a, b)


def letter_pairs(name: str) -> Column:
    """The distinct pairs of neighbouring letters of a text column."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(F.col(name), i, F.lit(2)))
    return F.array_distinct(F.when(F.length(name) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def normalize(names: DataFrame, aliases: DataFrame, least_overlap: float = 0.8, least_ratio: float = 0.85) -> DataFrame:
    """(name, canonical, confidence, method) for each distinct name.

    ``aliases`` has (alias, canonical, ord), ``ord`` deciding ties. Stages: exact, equal
    words (overlap of the larger word set), then fuzzy. Each stage is an equi-join: on the
    key, on a shared word, and, for fuzzy, on a shared pair of letters with lengths that
    allow the ratio: from a ratio of 0.75 on, names of two letters or more always share
    such a pair, as an edit breaks two pairs at most. A name is left to a later stage only
    if no earlier one has it.
    """
    n, a = split_names(names), split_aliases(aliases)
    exact = exact_stage(n, a)
    rest = n.join(exact.select("name"), "name", "left_anti")
    token = token_stage(rest, a, least_overlap)
    fuzzy = fuzzy_stage(rest.join(token.select("name"), "name", "left_anti"), a, least_ratio)
    found = None
    for method, df in (("exact", exact), ("token", token), ("fuzzy", fuzzy)):
        part = df.select("name", "x.canonical", "x.confidence", F.lit(method).alias("method"))
        found = part if found is None else found.unionByName(part)
    return n.select("name").distinct().join(found, "name", "left").withColumn("method", F.coalesce("method", F.lit("none")))


def split_names(names: DataFrame) -> DataFrame:
    """(name, k, w): distinct names with their key and words."""
    return names.select("name", key(F.col("name")).alias("k"), words(F.col("name")).alias("w")).distinct()


def split_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.select(key(F.col("alias")).alias("ak"), words(F.col("alias")).alias("aw"), "canonical", "ord")


def first_match(df: DataFrame, order: list) -> DataFrame:
    """(name, x): each name's canonical name and confidence that come first in the order."""
    return df.groupBy("name").agg(F.min_by(F.struct("canonical", "confidence"), F.struct(*order)).alias("x"))


def exact_stage(n: DataFrame, a: DataFrame) -> DataFrame:
    return first_match(n.join(a, n.k == a.ak).withColumn("confidence", F.lit(1.0)), ["ord"])


def token_stage(rest: DataFrame, a: DataFrame, least_overlap: float = 0.8) -> DataFrame:
    share = F.size(F.array_intersect("w", "aw")) / F.greatest(F.size("w"), F.size("aw"))
    shared = rest.withColumn("e", F.explode("w")).join(a.withColumn("e", F.explode("aw")), "e").withColumn("share", share)
    return first_match(shared.filter(F.col("share") >= least_overlap).withColumn("confidence", F.round(0.9 + 0.1 * F.col("share"), 6)), [-F.col("share"), F.col("ord")])


def fuzzy_stage(left: DataFrame, a: DataFrame, least_ratio: float = 0.85) -> DataFrame:
    fits = 2 * F.least(F.length("k"), F.length("ak")) >= least_ratio * (F.length("k") + F.length("ak"))
    close = left.withColumn("g", F.explode(letter_pairs("k"))).join(a.withColumn("g", F.explode(letter_pairs("ak"))), "g").filter(fits)
    close = close.select("name", "k", "ak", "canonical", "ord").distinct().withColumn("confidence", F.round(indel_ratio("k", "ak"), 6))
    return first_match(close.filter(F.col("confidence") >= least_ratio), [-F.col("confidence"), F.col("ord")])


def candidates(names: DataFrame, aliases: DataFrame, most: int = 5, least: float = 0.3) -> DataFrame:
    """(name, canonical, score, place): for each name the ``most`` canonical names with the closest aliases that share a pair of letters with it and score above ``least``."""
    n = names.select("name", key(F.col("name")).alias("k")).distinct().withColumn("g", F.explode(letter_pairs("k")))
    a = aliases.select(key(F.col("alias")).alias("ak"), "canonical").distinct().withColumn("g", F.explode(letter_pairs("ak")))
    close = n.join(a, "g").select("name", "k", "ak", "canonical").distinct().withColumn("score", F.round(indel_ratio("k", "ak"), 6))
    best = close.groupBy("name", "canonical").agg(F.max("score").alias("score")).filter(F.col("score") > least)
    w = Window.partitionBy("name").orderBy(F.desc("score"), "canonical")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def mentions(texts: DataFrame, aliases: DataFrame, text_col: str = "text", id_col: str = "doc_id", longest: int = 4) -> DataFrame:
    """(id, canonical, count) of aliases that occur in texts as whole words.

    Texts become runs of one to ``longest`` words that meet the aliases in an equi-join.
    Up to ``MOST_BROADCAST`` aliases are broadcast, whatever Spark knows of their size, and
    then no run that isn't an alias is shuffled.
    """
    split = F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    base = texts.select(id_col, split.alias("w"))
    place = F.sequence(F.lit(0), F.size("w") - 1)
    runs = lambda n: F.transform(place, lambda i: F.array_join(F.slice("w", i + 1, n), " "))
    grams = base.filter(F.size("w") > 0).select(id_col, F.explode(F.concat(*(F.slice(runs(n), F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(0))) for n in range(1, longest + 1)))).alias("gram"))
    names = aliases.select(F.array_join(F.filter(F.split(F.lower("alias"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ").alias("gram"), "canonical").distinct()
    few = names.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return grams.join(F.broadcast(names) if few else names, "gram").groupBy(id_col, "canonical").agg(F.count("*").alias("n_mentions"))


def unregistered(normalized: DataFrame) -> DataFrame:
    """Names that no stage knows, to be registered."""
    return normalized.filter("method = 'none'").select("name")


def register(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """The alias table with (alias, canonical) rows added behind the others; aliases that it has already stay as they are."""
    last = aliases.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last"))
    fresh = new.select(key(F.col("alias")).alias("alias"), "canonical").distinct().join(aliases.select(key(F.col("alias")).alias("alias")), "alias", "left_anti")
    numbered = fresh.crossJoin(F.broadcast(last)).select("alias", "canonical", (F.col("last") + 1).cast(aliases.schema["ord"].dataType).alias("ord"))
    return aliases.unionByName(numbered)
