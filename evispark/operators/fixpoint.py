"""Iterations to a fix-point over edge tables: cycles and levels of a hierarchy of any depth, components, chains of renames.

Every round is a few equi-joins and aggregations and is staged in the shared folder; the
driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.sources.staging import staged, unstaged

STEPS = 4  # levels between two stagings


def _sorted(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are sorted, none is sent to all executors by way of the driver."""
    return df.hint("merge")


def _edges(is_a: DataFrame) -> DataFrame:
    return is_a.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct()


def core(is_a: DataFrame) -> DataFrame:
    """The edges left when nodes without a child and nodes without a parent are dropped until nothing changes.

    A hierarchy without cycles leaves none. What stays are the cycles and the ways between them.
    """
    now = staged(_edges(is_a), "core")
    before = now.count()
    while before:
        for low, high in (("child", "parent"), ("parent", "child")):
            last, now = now, _without_ends(now, low, high)
            unstaged(last)
        after = now.count()
        if after == before:
            break
        before = after
    return now


def _without_ends(edges: DataFrame, low: str, high: str) -> DataFrame:
    """The edges without nodes that have none on the ``low`` side, and without the chains that such a node ends.

    A node with one neighbour on that side goes if the neighbour does. It points there, and
    pointers are followed by doubling, so a chain goes in as many rounds as its length has
    digits in base two. Where none is added in a round, no later one would add any.
    """
    one = F.min(low) == F.max(low)
    ahead = edges.groupBy(F.col(high).alias("node")).agg(F.when(one, F.min(low)).otherwise(F.first(high)).alias("next"))
    inner = edges.select(F.col(high).alias("next")).distinct().withColumn("inner", F.lit(True))
    now = staged(ahead.join(_sorted(inner), "next", "left").select("node", "next", F.isnull("inner").alias("ends")), "ends")
    before, ended = 0, now.filter("ends").count()
    while ended > before:
        met = now.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("ends").alias("too"))
        moved = now.join(_sorted(met), "next", "left").select("node", F.coalesce("then", "next").alias("next"), (F.col("ends") | F.coalesce("too", F.lit(False))).alias("ends"))
        last, now = now, staged(moved, "ends")
        unstaged(last)
        before, ended = ended, now.filter("ends").count()
    kept = staged(edges.join(_sorted(now.filter("NOT ends").select(F.col("node").alias(low))), low, "left_semi").select("child", "parent"), "core")
    unstaged(now)
    return kept


def cycles(is_a: DataFrame) -> DataFrame:
    """(node, cycle): each node that is its own ancestor over any number of edges, with the greatest node of its strongly connected component.

    Peeling leaves the core. There each node takes the greatest node that reaches it, by
    propagation; the nodes of one such colour that reach the colour's own node back are its
    component. They are taken out, and the rest is peeled and coloured again, so a round
    ends at least one component of every colour.
    """
    left, found = core(is_a), None
    while left.count():
        colour = _greatest_above(left)
        below, over = colour.toDF("child", "c1"), colour.toDF("parent", "c2")
        inside = left.join(_sorted(below), "child").join(_sorted(over), "parent")
        inside = staged(inside.filter("c1 = c2").select("child", "parent", F.col("c1").alias("colour")), "colours")
        back = _greatest_above(inside.select(F.col("parent").alias("child"), F.col("child").alias("parent")))  # a colour is its greatest node
        own = back.withColumnRenamed("colour", "cycle").join(_sorted(inside.select(F.col("colour").alias("cycle")).distinct()), "cycle", "left_semi")
        part = staged(own.select("node", "cycle"), "cycles")
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        rest = left.join(_sorted(gone.toDF("child")), "child", "left_anti").join(_sorted(gone.toDF("parent")), "parent", "left_anti")
        left = core(rest)
    if found is None:
        return left.select(F.col("child").alias("node"), F.col("parent").alias("cycle"))
    loops = _edges(is_a).filter("child = parent").select(F.col("child").alias("node"))
    sizes = found.groupBy("cycle").count()
    joined = found.join(_sorted(sizes), "cycle").join(_sorted(loops.withColumn("loop", F.lit(True))), "node", "left")
    return joined.filter("count > 1 OR loop").select("node", "cycle")


def _greatest_above(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest of the node and all nodes below it, as every child hands its colour on to its parents.

    Only colours that have changed are handed on. A node also takes the colour of one node
    further below, to which it points, and then that one's pointer, so that a colour goes
    along a chain or round a cycle in as many rounds as its length has digits in base two.
    """
    nodes = edges.select(F.col("child").alias("node"), F.lit(None).alias("far")).union(edges.select("parent", "child"))
    now = staged(nodes.groupBy("node").agg(F.coalesce(F.max("far"), F.col("node")).alias("far")).select("node", "far", F.col("node").alias("colour"), F.lit(True).alias("changed")), "colour")
    while True:
        handed = edges.join(_sorted(now.filter("changed").select(F.col("node").alias("child"), "colour")), "child")
        further = now.select(F.col("node").alias("far"), F.col("far").alias("next"), F.col("colour").alias("met"))
        own = now.join(_sorted(further), "far").select("node", F.greatest("colour", "met").alias("new"), F.col("colour").alias("old"), F.col("next").alias("far"))
        rows = own.unionByName(handed.select(F.col("parent").alias("node"), F.col("colour").alias("new")), allowMissingColumns=True)
        found = rows.groupBy("node").agg(F.max("far").alias("far"), F.max("new").alias("colour"), F.max("old").alias("old"))
        last, now = now, staged(found.select("node", "far", "colour", (F.col("colour") != F.col("old")).alias("changed")), "colour")
        unstaged(last)
        if now.filter("changed").isEmpty():
            return now.select("node", "colour")


def levels(is_a: DataFrame) -> DataFrame:
    """(node, level): the least number of edges to a root, a node without a parent, at any depth; nodes that no root is above have none."""
    edges = staged(_edges(is_a), "edges")
    below = edges.select("child").distinct()
    roots = edges.select("parent").distinct().join(below, F.col("parent") == F.col("child"), "left_anti")
    found = staged(roots.select(F.col("parent").alias("node"), F.lit(0).alias("level")), "levels")
    fresh, depth = found, 0
    while not fresh.isEmpty():
        seen, parts = found, []
        for _ in range(STEPS):
            depth += 1
            fresh = edges.join(fresh.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
            fresh = fresh.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(depth))
            seen = seen.unionByName(fresh)
            parts.append(fresh)
        new = parts[0]
        for part in parts[1:]:
            new = new.unionByName(part)
        new = staged(new, "levels")
        found, fresh = found.unionByName(new), new.filter(F.col("level") == depth)
    return found


def components(pairs: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component): the least node of each node's component, over pairs taken both ways.

    A node takes the least label among its neighbours', hands it to its label's own node,
    and then takes its label's label, so a chain's labels halve their way each round.
    """
    ends = pairs.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = staged(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    now = staged(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = both.join(_sorted(now.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = now.join(_sorted(near), "node").select("node", "label", F.least("label", "near").alias("least"))
        hooks = met.select("node", "least").unionByName(met.select(F.col("label").alias("node"), "least"))
        hooked = staged(hooks.groupBy("node").agg(F.min("least").alias("label")), "labels")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = staged(hooked.join(_sorted(jump), "label").select("node", F.least("label", "next").alias("label")), "labels")
        unstaged(hooked)
        same = after.join(_sorted(now), ["node", "label"], "left_anti").isEmpty()
        unstaged(now)
        now = after
        if same:
            return now.withColumnRenamed("label", "component")


def settled_names(mapping: DataFrame, prefer: Sequence[Column] = (), facts: DataFrame | None = None) -> DataFrame:
    """(old, canonical) with every rename followed to its end.

    Names that renames link, whatever the chain, the fork or the cycle, become one: the one
    that is never renamed; among several, or where all are, the first by ``prefer``
    (columns of ``facts``, which has a row a name in column ``name``) and then by name.
    """
    steps = staged(mapping.filter("old IS NOT NULL AND canonical IS NOT NULL AND old <> canonical").select("old", "canonical").distinct(), "renames")
    member = components(steps, "old", "canonical").withColumnRenamed("node", "name")
    renamed = steps.select(F.col("old").alias("name")).distinct().withColumn("renamed", F.lit(1))
    known = member.join(_sorted(renamed), "name", "left").fillna({"renamed": 0})
    known = known if facts is None else known.join(_sorted(facts), "name", "left")
    best = known.groupBy("component").agg(F.min_by("name", F.struct("renamed", *(p.alias(f"p{i}") for i, p in enumerate(prefer)), "name")).alias("canonical"))
    return member.join(_sorted(best), "component").filter("name <> canonical").select(F.col("name").alias("old"), "canonical")


def problems(is_a: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, node): orphans without an edge either way, nodes on a cycle of any length, and children of an edge without a level.

    Missing levels are looked for where ``is_a`` has a column ``level``.
    """
    linked = is_a.select(F.col("child").alias("node")).union(is_a.select("parent")).distinct()
    kind = lambda name, df: df.select(F.lit(name).alias("kind"), "node").distinct()
    out = kind("orphan", nodes.select("node").filter("node IS NOT NULL").join(_sorted(linked), "node", "left_anti")).unionByName(kind("cycle", cycles(is_a)))
    if "level" in is_a.columns:
        out = out.unionByName(kind("no_level", is_a.filter("level IS NULL AND parent IS NOT NULL").select(F.col("child").alias("node"))))
    return out
