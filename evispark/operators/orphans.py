"""Repair of hierarchies: nodes and IS_A edges added by rule tables, tops put under a root, categories by parts of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.operators import fixpoint
from evispark.sources.staging import staged

EDGE = ["child", "parent"]


def applicable(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules that apply when all are run once in the order of ``ord``.

    A rule without a parent always applies and makes its child. Another applies where its
    parent is a node, or the child of a rule that applies before it. Rounds follow chains of
    rules, so there are as many as the longest chain is long, whatever the number of rules.
    """
    rules = staged(rules.filter("child IS NOT NULL"), "rules")
    first = rules.filter("parent IS NULL").unionByName(rules.join(nodes.select(F.col("name").alias("parent")).distinct(), "parent", "left_semi").select(rules.columns))
    found = new = staged(first, "applied")
    rest = rules.join(found.select("ord"), "ord", "left_anti")
    while new.count():
        made = new.groupBy("child").agg(F.min("ord").alias("since"))
        fits = (F.col("parent") == F.col("made.child")) & (F.col("since") < F.col("rest.ord"))
        new = staged(rest.alias("rest").join(made.alias("made"), fits, "left_semi").select(rules.columns), "applied")
        found = found.unionByName(new)
        rest = staged(rest.join(new.select("ord"), "ord", "left_anti"), "rules")
    return found


def apply_rules(nodes: DataFrame, is_a: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, is_a) with what the rules add.

    ``nodes`` has unique name, category, full_name and may have more; ``is_a`` child, parent,
    level; ``rules`` ord (unique), child, parent (null: none), level, category, full_name and
    fill. A child that isn't a node becomes one, with the category and full name of its first
    rule that applies. A missing category is taken from the first rule with ``fill`` that has
    one; nothing that is there changes. An edge is added once, with its first rule's level,
    and left out if it would lie on a cycle. Rules without a child are skipped.
    """
    applied = staged(applicable(nodes, rules), "applied")
    return ruled_nodes(nodes, applied), ruled_edges(is_a, applied)


def ruled_nodes(nodes: DataFrame, applied: DataFrame) -> DataFrame:
    """The nodes of ``apply_rules``, of rules that all apply."""
    told = applied.groupBy(F.col("child").alias("name")).agg(
        F.min_by("category", "ord").alias("__category"),
        F.min_by("full_name", "ord").alias("__full_name"),
        F.min_by("category", F.when(F.col("fill") & F.col("category").isNotNull(), F.col("ord"))).alias("__filled"),
    )
    marked = nodes.withColumn("__there", F.lit(True))
    both = marked.join(told, "name", "full_outer")
    there = F.col("__there").isNotNull()
    value = {
        "category": F.when(there, F.coalesce("category", "__filled")).otherwise(F.coalesce("__category", "__filled")),
        "full_name": F.when(there, F.col("full_name")).otherwise(F.col("__full_name")),
    }
    return both.select(*(value.get(c, F.col(c)).alias(c) for c in nodes.columns))


def ruled_edges(is_a: DataFrame, applied: DataFrame) -> DataFrame:
    """The hierarchy of ``apply_rules``, of rules that all apply."""
    wanted = applied.filter("parent IS NOT NULL").groupBy(*EDGE).agg(F.min_by("level", "ord").alias("level"))
    return with_edges(is_a, wanted)


def with_edges(is_a: DataFrame, wanted: DataFrame) -> DataFrame:
    """The hierarchy with those of the wanted (child, parent, level) that it lacks and that lie on no cycle of any length."""
    new = staged(wanted.join(is_a.select(*EDGE).distinct(), EDGE, "left_anti").select(*EDGE, "level"), "edges")
    cycles = fixpoint.cycles(is_a.select(*EDGE).unionByName(new.select(*EDGE)))
    of = lambda end: cycles.select(F.col("node").alias(end), F.col("cycle").alias(f"__{end}"))
    placed = new.join(of("child"), "child", "left").join(of("parent"), "parent", "left")
    kept = placed.filter(~F.coalesce(F.col("__child") == F.col("__parent"), F.lit(False)))
    return is_a.unionByName(kept.select(*EDGE, "level"), allowMissingColumns=True)


def under_root(nodes: DataFrame, is_a: DataFrame, root: str, level: int = 0) -> DataFrame:
    """The hierarchy with every top, a node with children and no parent, put under the root; unchanged if the root isn't a node."""
    tops = is_a.select(F.col("parent").alias("child")).distinct().join(is_a.select("child").distinct(), "child", "left_anti").filter(F.col("child") != root)
    known = tops.join(nodes.select(F.col("name").alias("child")), "child", "left_semi")
    at = nodes.filter(F.col("name") == root).select(F.col("name").alias("parent")).limit(1)  # one row
    return with_edges(is_a, known.crossJoin(F.broadcast(at)).withColumn("level", F.lit(level)))


def categorise(nodes: DataFrame, rules: Sequence[tuple[Sequence[str], str, bool]], name: str = "name", column: str = "category") -> DataFrame:
    """Categories by parts of names, as if the rules were run one after the other.

    A rule (parts, value, only_missing) fits a name that contains one of the parts, in the
    case given. It sets its value; with ``only_missing`` only where there is none so far. So
    the last fitting rule that may overwrite decides, else what was there, else the first
    fitting one. A null name fits nothing; an empty category counts as missing.
    """
    fits = []
    for parts, value, only_missing in rules:
        fit = F.lit(False)
        for part in parts:
            fit = fit | F.contains(F.col(name), F.lit(part))
        fits.append((F.coalesce(fit, F.lit(False)), value, only_missing))
    last = [F.when(fit, value) for fit, value, only_missing in reversed(fits) if not only_missing]
    first = [F.when(fit, value) for fit, value, only_missing in fits if only_missing]
    there = F.when(F.col(column) != "", F.col(column)) if column in nodes.columns else F.lit(None).cast("string")
    return nodes.withColumn(column, F.coalesce(*last, there, *first))
