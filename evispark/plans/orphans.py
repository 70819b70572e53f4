"""Hierarchies repaired by rule tables, beside oracles that follow the rules recursively.

Nodes are customers, every fifth of them missing; a rule puts a customer below that of half
its number; some edges are there before, and some of these would make a rule's edge a loop.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import orphans
from evispark.sources import tables as t

# parts of part names, the category they tell, and whether it only fills
PARTS = [
    (["cold", "hot"], "thermal", False),
    (["widget"], "small goods", True),
    (["small", "tiny"], "small", False),
    (["a", "e"], "other", True),
]


def _name(k):
    return F.concat(F.lit("C"), k.cast("string"))


def tables(s, d):
    c = t.table(s, d, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    segment = F.lower("c_mktsegment")
    nodes = c.filter("c_custkey % 5 <> 0").select(_name(k).alias("name"), F.when(k % 4 != 0, segment).alias("category"), F.lit(None).cast("string").alias("full_name"))
    half = F.floor(k / 2)
    edges = c.filter("c_custkey % 7 = 2").select(_name(k).alias("child"), _name(k - 1).alias("parent"), F.lit(1).alias("level"))
    back = c.filter("c_custkey % 33 = 0 AND c_custkey > 0").select(_name(half).alias("child"), _name(k).alias("parent"), F.lit(2).alias("level"))
    rules = c.filter("c_custkey % 3 = 0 OR c_custkey % 10 = 5").select(
        k.alias("ord"), _name(k).alias("child"), F.when(k % 30 != 0, _name(half)).alias("parent"), (k % 4).cast("int").alias("level"),
        F.concat(F.lit("ruled "), segment).alias("category"), F.concat(F.lit("Customer "), k.cast("string")).alias("full_name"), (k % 2 == 0).alias("fill"),
    )
    return nodes, edges.unionByName(back).distinct(), rules


def edges(s, d):
    before, is_a, rules = tables(s, d)
    return orphans.ruled_edges(is_a, orphans.applicable(before, rules))


def nodes(s, d):
    before, _, rules = tables(s, d)
    return orphans.ruled_nodes(before, orphans.applicable(before, rules))


def rooted(s, d):
    """The hierarchy before the rules, its tops put under one customer."""
    before, is_a, _ = tables(s, d)
    return orphans.under_root(before, is_a, "C1")


def categories(s, d):
    p = t.table(s, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("category"))
    return orphans.categorise(p, PARTS, "p_name")


QUERIES = {"maintain_rule_edges": edges, "maintain_rule_nodes": nodes, "maintain_under_root": rooted, "maintain_categories": categories}

_TABLES = """n AS (SELECT 'C' || c_custkey AS name, CASE WHEN c_custkey % 4 <> 0 THEN lower(c_mktsegment) END AS category FROM customer WHERE c_custkey % 5 <> 0),
e AS (SELECT 'C' || c_custkey AS child, 'C' || (c_custkey - 1) AS parent, 1 AS level FROM customer WHERE c_custkey % 7 = 2
  UNION SELECT 'C' || (c_custkey // 2), 'C' || c_custkey, 2 FROM customer WHERE c_custkey % 33 = 0 AND c_custkey > 0),
u AS (SELECT c_custkey AS ord, 'C' || c_custkey AS child, CASE WHEN c_custkey % 30 <> 0 THEN 'C' || (c_custkey // 2) END AS parent, CAST(c_custkey % 4 AS INT) AS level,
  'ruled ' || lower(c_mktsegment) AS category, 'Customer ' || c_custkey AS full_name, c_custkey % 2 = 0 AS fill FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 10 = 5)"""
_APPLIED = """a AS (SELECT * FROM u WHERE parent IS NULL OR parent IN (SELECT name FROM n) UNION SELECT u.* FROM u JOIN a ON u.parent = a.child AND a.ord < u.ord)"""
_KEPT = """every AS (SELECT child, parent FROM e UNION SELECT child, parent FROM w),
up AS (SELECT child, parent FROM every UNION SELECT up.child, every.parent FROM up JOIN every ON up.parent = every.child)
SELECT child, parent, level FROM e UNION ALL
SELECT child, parent, level FROM w WHERE (child, parent) NOT IN (SELECT (child, parent) FROM e) AND child <> parent AND (parent, child) NOT IN (SELECT (child, parent) FROM up)"""
ORACLE = {
    "maintain_rule_edges": f"WITH RECURSIVE {_TABLES}, {_APPLIED}, w AS (SELECT child, parent, level FROM a WHERE parent IS NOT NULL), {_KEPT}",
    "maintain_rule_nodes": f"""WITH RECURSIVE {_TABLES}, {_APPLIED}
SELECT coalesce(name, child) AS name, CASE WHEN name IS NULL THEN a.category ELSE coalesce(n.category, CASE WHEN fill THEN a.category END) END AS category,
  CASE WHEN name IS NULL THEN full_name END AS full_name FROM n FULL JOIN a ON name = child""",
    "maintain_under_root": f"""WITH RECURSIVE {_TABLES}, w AS (SELECT DISTINCT parent AS child, 'C1' AS parent, 0 AS level FROM e
  WHERE parent NOT IN (SELECT child FROM e) AND parent <> 'C1' AND parent IN (SELECT name FROM n) AND 'C1' IN (SELECT name FROM n)), {_KEPT}""",
    "maintain_categories": """SELECT p_partkey, p_name, CASE WHEN p_name LIKE '%small%' OR p_name LIKE '%tiny%' THEN 'small' WHEN p_name LIKE '%cold%' OR p_name LIKE '%hot%' THEN 'thermal'
  WHEN p_partkey % 3 = 0 THEN p_type WHEN p_name LIKE '%widget%' THEN 'small goods' WHEN p_name LIKE '%a%' OR p_name LIKE '%e%' THEN 'other' END AS category FROM part""",
}
