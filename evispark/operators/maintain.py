"""Graph mutation as set operations: each returns the new table, which the caller writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes overlay base rows of the same key; null in a change leaves the old value. Keys in ``changes`` are unique."""
    keys = list(keys)
    new = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in changes.columns if c not in keys), F.lit(True).alias("__new"))
    both = base.join(new, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(f"__{c}", c).alias(c) if c in changes.columns else F.col(c) for c in base.columns if c not in keys))


def fill_missing(base: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fills columns that are null or empty from ``values``; what is there stays."""
    new = values.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = base.join(new, list(keys), "left")
    has = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    return joined.select(*(F.coalesce(has(c), f"__{c}").alias(c) if c in columns else F.col(c) for c in base.columns))


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; an aggregate, so a key with very many rows is reduced map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("x")).select(*keys, *(f"x.{c}" for c in rest))


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("x")).select(*keys, *(f"x.{c}" for c in rest))


def append_once(base: DataFrame, changes: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """Adds the changes' array members that the base row lacks; new keys are added."""
    new = changes.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(array)))).alias("__more"))
    joined = base.join(new, list(keys), "full_outer")
    empty = F.array().cast(base.schema[array].dataType)
    both = F.array_sort(F.array_union(F.coalesce(array, empty), F.coalesce("__more", empty)))
    return joined.select(*keys, both.alias(array), *(c for c in base.columns if c not in keys and c != array))


def delete(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows whose key column names a deleted one."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    return {name: df.join(ids, F.col(column) == F.col("__gone"), "left_anti") for name, (df, column) in tables.items()}


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The new rows in place of all rows of the same parents."""
    return delete(children, new, [parent]).unionByName(new)


def case_duplicates(nodes: DataFrame, name: str, prefer: Sequence[Column]) -> DataFrame:
    """(old, canonical) for names that differ in case only; the first by ``prefer``, then by name, is kept."""
    ranked = nodes.withColumn("__low", F.lower(name))
    best = F.min_by(F.col(name), F.struct(*prefer, F.col(name)))
    kept = ranked.groupBy("__low").agg(best.alias("canonical"), F.count_distinct(name).alias("__n")).filter("__n > 1")
    return ranked.join(kept, "__low").filter(F.col(name) != F.col("canonical")).select(F.col(name).alias("old"), "canonical").distinct()


def redirect(edges: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Edges with old end points renamed, without loops that arise and without repeats."""
    out = edges
    for c in columns:
        m = mapping.select(F.col("old").alias("__old"), F.col("canonical").alias("__canonical"))
        out = out.join(m, out[c] == F.col("__old"), "left").withColumn(c, F.coalesce("__canonical", c)).drop("__old", "__canonical")
    if len(columns) == 2:
        out = out.filter(F.col(columns[0]) != F.col(columns[1]))
    return out.distinct()


def garbage(nodes: DataFrame, degree: DataFrame, name: str, pattern: str, most: int = 10) -> DataFrame:
    """Nodes whose name fits a pattern and that have few edges; degrees are counted before the join."""
    return nodes.filter(F.col(name).rlike(pattern)).select(name).join(degree.select(name, "degree"), name, "left").filter(F.coalesce("degree", F.lit(0)) <= most).select(name)


def infer_parents(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """(child, parent) edges from concepts' parent codes, without self links."""
    c, p = concepts.alias("c"), concepts.alias("p")
    named = c.join(p, F.col("c.parent_code") == F.col("p.code")).select(F.col("c.name").alias("child"), F.col("p.name").alias("parent"))
    return named.filter("child <> parent").join(nodes.select(F.col("name").alias("child")), "child", "left_semi").distinct()


def backfill_treats(investigates: DataFrame, studies: DataFrame, review_size: int = 4) -> DataFrame:
    """(intervention, pathology, paper_count, first_paper) by co-occurrence in papers that aren't reviews.

    A review names ``review_size`` interventions and pathologies or more; such papers are
    found by two aggregates and kept out by an anti-join.
    """
    many = lambda df: df.groupBy("paper_id").agg(F.count("*").alias("n")).filter(F.col("n") >= review_size).select("paper_id")
    reviews = many(investigates).join(many(studies), "paper_id", "left_semi")
    both = investigates.join(studies, "paper_id").join(reviews, "paper_id", "left_anti")
    return both.groupBy("intervention", "pathology").agg(F.count("*").alias("paper_count"), F.min("paper_id").alias("first_paper"))


def coverage(nodes: dict[str, DataFrame], code: str) -> DataFrame:
    """By label: rows, rows with a code, percent."""
    out = None
    for label, df in nodes.items():
        part = df.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col(code).cast("string"), F.lit("")) != "").alias("mapped")).select(F.lit(label).alias("label"), "total", "mapped")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("percent", F.round(F.col("mapped") * 100.0 / F.greatest("total", F.lit(1)), 4))


def assign_by_rules(nodes: DataFrame, name: str, rules: Sequence[tuple[str, str]], column: str) -> DataFrame:
    """Sets a column, where it is missing, by the first pattern that the name fits."""
    value = F.lit(None).cast("string")
    for pattern, result in reversed(list(rules)):
        value = F.when(F.lower(name).rlike(pattern), result).otherwise(value)
    present = F.when(F.col(column) != "", F.col(column)) if column in nodes.columns else F.lit(None).cast("string")
    return nodes.withColumn(column, F.coalesce(present, value))


def valid_relations(edges: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Edges of known kinds with a confidence from 0 to 1 between two different ends, and the others."""
    ok = F.coalesce(F.col("kind").isin(*kinds) & F.col("confidence").between(0, 1) & (F.col("source") != F.col("target")), F.lit(False))
    return edges.filter(ok), edges.filter(~ok)


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or occur more than once: what a uniqueness constraint would refuse."""
    counts = df.groupBy(*keys).count()
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return counts.filter((F.col("count") > 1) | null)


def explode_items(papers: DataFrame, array: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Secondary entities from a paper's array of structs with a name: node table (first wins) and edge table."""
    items = papers.select(key, F.posexplode(array).alias("__i", "__x")).select(key, "__i", "__x.*")
    rest = [c for c in items.columns if c not in (key, "__i", "name")]
    nodes = items.groupBy("name").agg(F.min(F.struct(key, "__i", *rest)).alias("x")).select("name", *(f"x.{c}" for c in rest))
    return nodes, items.select(key, "name").distinct()
