"""Cycles, levels, components and chains of renames against brute force."""

import random

import pytest

from evispark.operators import fixpoint
from pyspark.sql import functions as F


def closure(edges):
    above = {}
    for c, p in edges:
        above.setdefault(c, set()).add(p)
    reach = {}
    for start in above:
        seen, due = set(), [start]
        while due:
            for p in above.get(due.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    due.append(p)
        reach[start] = seen
    return reach


def brute_levels(edges):
    children, down = {c for c, _ in edges}, {}
    for c, p in edges:
        down.setdefault(p, set()).add(c)
    level = {p: 0 for _, p in edges if p not in children}
    due = list(level)
    for node in due:
        for c in sorted(down.get(node, ())):
            if c not in level:
                level[c] = level[node] + 1
                due.append(c)
    return level


CHAIN = [(f"c{i}", f"c{i + 1}") for i in range(40)]
RING = [(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)]
SHAPES = {
    "chain": CHAIN,
    "ring": RING,
    "ring with tails and a way to another ring": RING + [("tail", "r3"), ("r5", "way"), ("way", "s0"), ("s0", "s1"), ("s1", "s0"), ("s1", "top"), (None, "x"), ("y", None)],
    "loop and diamond": [("a", "a"), ("b", "a"), ("d", "b"), ("d", "c"), ("c", "e"), ("b", "e")],
    "empty": [],
    **{f"random {seed}": [(f"n{random.Random(seed * 1000 + i).randrange(14)}", f"n{random.Random(seed * 2000 + i).randrange(14)}") for i in range(16)] for seed in (1, 2)},
}


@pytest.mark.parametrize("shape", SHAPES)
def test_cycles_and_levels(spark, shape):
    edges = SHAPES[shape]
    whole = [(c, p) for c, p in edges if c is not None and p is not None]
    frame = spark.createDataFrame(edges, "child string, parent string")
    reach = closure(whole)
    found = fixpoint.cycles(frame).collect()
    assert sorted(r.node for r in found) == sorted(x for x, above in reach.items() if x in above)
    for r in found:  # a cycle is named by the greatest of its strongly connected nodes
        assert r.cycle == max([x for x in reach[r.node] if r.node in reach.get(x, ())] + [r.node])
    assert {r.node: r.level for r in fixpoint.levels(frame).collect()} == brute_levels(whole)


def test_problems(spark):
    is_a = spark.createDataFrame([("a", "b", 1), ("b", "a", None), ("c", "a", None), ("d", None, None)], "child string, parent string, level int")
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "c", "z", None, "z")], "node string")
    assert sorted(map(tuple, fixpoint.problems(is_a, nodes).collect())) == [("cycle", "a"), ("cycle", "b"), ("no_level", "b"), ("no_level", "c"), ("orphan", "z")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 170)] + [(500, i) for i in range(501, 560)] + [(900, 900)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = fixpoint.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == label and len(found) == len(label)


def test_names_settle_at_the_end_of_their_chain(spark):
    steps = [(f"v{i}", f"v{i + 1}") for i in range(9)]  # a chain: all become v9
    steps += [("f", "left"), ("f", "right"), ("g", "right")]  # a fork: the one with more edges
    steps += [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")]  # a cycle: the one with a code
    steps += [("same", "same"), (None, "q"), ("q", None)]
    facts = spark.createDataFrame([("left", 0, 9), ("right", 0, 5), ("y", 1, 0), ("x", 0, 50)], "name string, coded int, degree int")
    prefer = [-F.coalesce("coded", F.lit(0)), -F.coalesce("degree", F.lit(0))]
    found = fixpoint.settled_names(spark.createDataFrame(steps, "old string, canonical string"), prefer, facts)
    want = {**{f"v{i}": "v9" for i in range(9)}, "f": "left", "g": "left", "right": "left", "x": "y", "z": "y", "w": "y"}
    assert {r.old: r.canonical for r in found.collect()} == want
    assert fixpoint.settled_names(spark.createDataFrame([], "old string, canonical string")).count() == 0
