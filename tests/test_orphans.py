"""Repair of hierarchies by rules, against rules run one by one."""

import random

import pytest

from evispark.operators import orphans

NODES, EDGES = "name string, category string, full_name string", "child string, parent string, level int"
RULES = "ord int, child string, parent string, level int, category string, full_name string, fill boolean"


def reaches(edges, start, goal):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for c, p in edges:
            if c == x and p not in seen:
                seen.add(p)
                todo.append(p)
    return goal in seen


def brute(nodes, edges, rules):
    """Rules in order; then new edges on a cycle of the whole are taken out."""
    have, levels, new = {n: [c, f] for n, c, f in nodes}, {(c, p): x for c, p, x in edges}, {}
    for _, child, parent, level, category, full, fill in sorted(rules):
        if child is None or parent is not None and parent not in have:
            continue
        if child not in have:
            have[child] = [category, full]
        elif fill and have[child][0] is None:
            have[child][0] = category
        if parent is not None and (child, parent) not in levels:
            new.setdefault((child, parent), level)
    whole = list(levels) + list(new)
    kept = {e: x for e, x in new.items() if not reaches(whole, e[1], e[0]) and e[0] != e[1]}
    return sorted((n, *v) for n, v in have.items()), sorted((*e, x) for e, x in (levels | kept).items())


def run(spark, nodes, edges, rules):
    n, e = orphans.apply_rules(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(rules, RULES))
    key = lambda r: tuple(map(str, r))
    return sorted(map(tuple, n.collect()), key=key), sorted(map(tuple, e.collect()), key=key)


def same(got, want):
    assert [list(map(str, x)) for x in got[0]] == sorted(list(map(str, x)) for x in want[0])
    assert [list(map(str, x)) for x in got[1]] == sorted(list(map(str, x)) for x in want[1])


NODE_ROWS = [("Fusion", "surgery", None), ("Screw", None, "A screw"), ("Lone", None, None)]
RULE_ROWS = [
    (1, "Late", "Later", 1, "x", None, True),  # its parent comes only with the next rule
    (2, "Later", None, 1, "y", "Later thing", False),
    (3, "Cage", "Fusion", 2, "surgery", "Cage fusion", False),
    (4, "Mini cage", "Cage", 3, None, "Mini", False),
    (5, "Mini cage", "Cage", 9, "small", "Not this", True),
    (6, "Screw", "Fusion", 1, "fixation", "Not this", True),
    (7, "Screw", "Fusion", 1, "other", None, True),
    (8, "Lone", "Nowhere", 1, "z", None, True),
    (9, "Fusion", "Mini cage", 1, "loop", None, True),
    (10, "Lone", "Lone", 1, None, None, False),
    (11, None, "Fusion", 1, None, None, False),
]


def test_rules_in_order(spark):
    got = run(spark, NODE_ROWS, [("Lone", "Screw", 4)], RULE_ROWS)
    same(got, brute(NODE_ROWS, [("Lone", "Screw", 4)], RULE_ROWS))
    nodes = {n[0]: n[1:] for n in got[0]}
    assert nodes["Mini cage"] == ("small", "Mini") and nodes["Screw"] == ("fixation", "A screw") and "Late" not in nodes


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    nodes = [(n, rng.choice([None, "a"]), None) for n in names[:12]]
    edges = list({(rng.choice(names[:12]), rng.choice(names[:12])) for _ in range(6)})
    edges = [(c, p, 1) for c, p in edges if c < p]
    rules = [(i, rng.choice(names), rng.choice([*names, None]), i, rng.choice([None, "b", "c"]), f"f{i}", rng.random() < 0.5) for i in range(50)]
    same(run(spark, nodes, edges, rules), brute(nodes, edges, rules))


def test_chain_of_rules(spark):
    rules = [(i, f"n{i}", f"n{i - 1}" if i else None, 1, "c", None, False) for i in range(12)]
    nodes, edges = run(spark, [], [], rules)
    assert len(nodes) == 12 and len(edges) == 11


def test_empty_rules(spark):
    assert run(spark, NODE_ROWS[:1], [("a", "b", 1)], []) == ([NODE_ROWS[0]], [("a", "b", 1)])


def test_under_root(spark):
    nodes = spark.createDataFrame([(n, None, None) for n in ("R", "A", "B", "C", "X")], NODES)
    edges = spark.createDataFrame([("B", "A", 1), ("X", "C", 1), ("R", "C", 1), ("Q", "P", 1)], EDGES)
    got = {tuple(r) for r in orphans.under_root(nodes, edges, "R").collect()} - {tuple(r) for r in edges.collect()}
    assert got == {("A", "R", 0)}  # C is above the root, P isn't a node
    assert orphans.under_root(nodes, edges, "none").count() == 4


def test_categories_as_if_run_one_by_one(spark):
    rules = [(["Fracture"], "trauma", False), (["osteo", "Osteo"], "metabolic", True), (["SCI"], "cord", False), (["Fract"], "late", True)]
    rows = [("Fracture of SCI", None), ("osteo Fracture", "old"), ("Osteopenia", "old"), ("Osteopenia", ""), ("sci", None), (None, "old"), (None, None), ("Fract osteo", None)]
    want = []
    for name, category in rows:
        now = category or None
        for parts, value, only_missing in rules:
            if name and any(p in name for p in parts) and not (only_missing and now):
                now = value
        want.append((name, now))
    got = [tuple(r) for r in orphans.categorise(spark.createDataFrame(rows, "name string, category string"), rules).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
