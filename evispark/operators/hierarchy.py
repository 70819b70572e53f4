"""Hierarchy operators over one materialised closure of IS_A."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.operators.pairs import pairs_within


def closure(is_a: DataFrame, depth: int = 5, with_self: bool = False) -> DataFrame:
    """(node, ancestor, distance, path) for every upward trail of up to ``depth`` edges.

    Unrolled joins, one a level: each is an equi-join of the level's frontier with the
    edges, and Spark broadcasts the edges where they are small. A trail never takes an
    edge twice, so cycles end. One row a trail: a diamond gives its ancestor twice.
    """
    edges = is_a.select("child", "parent")
    edge = lambda child, parent: F.concat_ws(">", child, parent)
    level = edges.select(
        F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"),
        F.array("child", "parent").alias("path"), F.array(edge("child", "parent")).alias("taken"),
    )
    out = level
    for d in range(2, depth + 1):
        step = level.join(edges, level.ancestor == edges.child).filter(~F.array_contains("taken", edge("child", "parent")))
        level = step.select(
            "node", F.col("parent").alias("ancestor"), F.lit(d).alias("distance"),
            F.concat("path", F.array("parent")).alias("path"), F.concat("taken", F.array(edge("child", "parent"))).alias("taken"),
        )
        out = out.unionByName(level)
    out = out.drop("taken")
    if with_self:
        nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
        out = out.unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"), F.array("node").alias("path")))
    return out


def reach(is_a: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, distance): every node with itself and its ancestors within ``depth`` steps, each once, at the least distance.

    Each level is the distinct pairs one step above the level before: no paths are kept,
    so a diamond costs one row.
    """
    edges = is_a.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct()
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    out = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    level = out.select("node", "ancestor")
    for d in range(1, depth + 1):
        level = level.join(edges, level.ancestor == edges.child).select("node", F.col("parent").alias("ancestor")).distinct()
        out = out.unionByName(level.withColumn("distance", F.lit(d)))
    return out.groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))


def ancestors(up: DataFrame, name: str, depth: int = 5) -> DataFrame:
    return up.filter((F.col("node") == name) & (F.col("distance") <= depth)).select("ancestor", "distance").distinct()


def descendants(up: DataFrame, name: str, depth: int = 3) -> DataFrame:
    return up.filter((F.col("ancestor") == name) & (F.col("distance") <= depth)).select("node", "distance").distinct()


def common_ancestors(up: DataFrame, pairs: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """For each pair the common ancestor at the least total distance; ties go to the least name."""
    a = up.select(F.col("node").alias(first), "ancestor", F.col("distance").alias("da"))
    b = up.select(F.col("node").alias(second), "ancestor", F.col("distance").alias("db"))
    both = pairs.join(a, first).join(b, [second, "ancestor"])
    best = F.min(F.struct((F.col("da") + F.col("db")).alias("total"), F.col("ancestor")))
    return both.groupBy(first, second).agg(best.alias("x")).select(first, second, F.col("x.ancestor").alias("ancestor"), F.col("x.total").alias("total_distance"))


def levels(up: DataFrame) -> DataFrame:
    """Each node's least distance to a root, a node without a parent."""
    nodes = up.select("node").distinct()
    roots = up.select(F.col("ancestor").alias("root")).distinct().join(nodes, F.col("root") == F.col("node"), "left_anti")
    return up.join(roots, up.ancestor == roots.root, "left_semi").groupBy("node").agg(F.min("distance").alias("level"))


def similar_entities(up: DataFrame, most: int = 2, reach: int = 3) -> DataFrame:
    """Pairs of nodes with a common ancestor within ``reach`` steps each and ``most`` together, and the least such distance.

    Pairs meet on the ancestor; ``most`` bounds them to families. A pair with several common
    ancestors is kept at the nearest, the least by name, as each side carries its list of the
    few ancestors within ``reach``: no pair is shuffled.
    """
    near = up.filter(F.col("distance") <= min(reach, most - 1)).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
    lists = near.groupBy("node").agg(F.collect_list(F.struct("ancestor", "distance")).alias("all"))
    rows = near.join(lists, "node").select("node", "ancestor", "distance", "all")
    pairs = pairs_within(rows, ["ancestor"], "node", (F.col("a.node") != F.col("b.node")) & (F.col("a.distance") + F.col("b.distance") <= most))
    shared = F.flatten(F.transform("a.all", lambda x: F.transform(F.filter("b.all", lambda y: y.ancestor == x.ancestor), lambda y: F.struct((x.distance + y.distance).alias("distance"), x.ancestor.alias("ancestor")))))
    single = (F.size("a.all") == 1) | (F.size("b.all") == 1)
    kept = pairs.filter(F.when(single, F.lit(True)).otherwise(F.array_min(shared).ancestor == F.col("a.ancestor")))
    return kept.select(F.col("a.node").alias("node"), F.col("b.node").alias("relative"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))


def kin_totals(up: DataFrame, most: int = 4, reach: int = 3, values: DataFrame | None = None) -> DataFrame:
    """(node, distance, n_relatives, total): relatives in other branches of a common ancestor, by the distance over it, with the sum of their values.

    Members are summed by ancestor and depth, and once more by the branch below the
    ancestor; a node's relatives over an ancestor are the members less those of its own
    branch. No pair of nodes is built. ``values`` has (node, value). In a hierarchy where
    a node has several parents, relatives count once for each way to them.
    """
    near = up.filter(F.col("distance") <= F.lit(min(reach, most - 1))).withColumn("branch", F.element_at("path", -2))
    valued = near.join(values, "node", "left") if values is not None else near.withColumn("value", F.lit(0))
    sums = [F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("v")]
    branches = valued.groupBy("ancestor", "branch", "distance").agg(*sums)
    members = branches.groupBy("ancestor", F.col("distance").alias("depth")).agg(F.sum("n").alias("all_n"), F.sum("v").alias("all_v"))
    own = branches.withColumnsRenamed({"distance": "depth", "n": "own_n", "v": "own_v"})
    # one row for each branch of an ancestor and depth: what lies outside the branch
    outside = branches.select("ancestor", "branch").distinct().join(members, "ancestor").join(own, ["ancestor", "branch", "depth"], "left")
    outside = outside.select("ancestor", "branch", "depth", (F.col("all_n") - F.coalesce("own_n", F.lit(0))).alias("n"), (F.col("all_v") - F.coalesce("own_v", F.lit(0))).alias("v"))
    met = near.select("node", "ancestor", "branch", "distance").join(outside, ["ancestor", "branch"]).filter((F.col("distance") + F.col("depth") <= most) & (F.col("n") > 0))
    return met.groupBy("node", (F.col("distance") + F.col("depth")).alias("distance")).agg(F.sum("n").alias("n_relatives"), F.sum("v").alias("total"))


def tree(up: DataFrame, depth: int = 3) -> DataFrame:
    """Roots with the number of descendants at each level down to ``depth``."""
    nodes = up.select(F.col("node").alias("n")).distinct()
    below = up.filter(F.col("distance") <= depth).join(nodes, F.col("ancestor") == F.col("n"), "left_anti")
    return below.groupBy(F.col("ancestor").alias("root"), "distance").agg(F.count_distinct("node").alias("n_descendants"))


def problems(is_a: DataFrame, nodes: DataFrame, up: DataFrame) -> DataFrame:
    """(kind, node): orphans without an edge either way, and nodes on a cycle."""
    linked = is_a.select(F.col("child").alias("node")).union(is_a.select("parent"))
    orphan = nodes.select("node").distinct().join(linked.distinct(), "node", "left_anti").select(F.lit("orphan").alias("kind"), "node")
    cycle = up.filter(F.col("node") == F.col("ancestor")).select(F.lit("cycle").alias("kind"), "node").distinct()
    return orphan.unionByName(cycle)


def expand(up: DataFrame, names: DataFrame, depth: Column | int = 1) -> DataFrame:
    """Each name with itself, its ancestors and its descendants within ``depth`` (1 to 5)."""
    depth = F.least(F.greatest(F.lit(depth), F.lit(1)), F.lit(5))
    near = up.filter(F.col("distance") <= depth)
    higher = names.join(near, names.name == near.node).select("name", F.col("ancestor").alias("expanded"))
    lower = names.join(near, names.name == near.ancestor).select("name", F.col("node").alias("expanded"))
    return names.select("name", F.col("name").alias("expanded")).union(higher).union(lower).distinct()
