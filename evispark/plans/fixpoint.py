"""Queries over hierarchies of any depth and over chains of renames, each beside its oracle.

The hierarchy is one of customers: in every fifth dozen the twelve form a cycle, elsewhere
each is below the one before, in chains of 40; every seventh is also below its nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import fixpoint, maintain
from evispark.sources import tables as t


def deep(s, d):
    c = t.table(s, d, "customer").select("c_custkey", "c_nationkey")
    k, name = F.col("c_custkey"), lambda x: F.concat(F.lit("C"), x.cast("string"))
    around = F.when(k % 12 == 11, k - 11).otherwise(k + 1)
    in_cycle = F.floor(k / 12) % 5 == 0
    parent = F.when(in_cycle, around).when(k % 40 != 0, k - 1)
    level = F.when(k % 9 != 0, F.lit(1))
    steps = c.filter(parent.isNotNull()).select(name(k).alias("child"), name(parent).alias("parent"), level.alias("level"))
    return steps.unionByName(c.filter("c_custkey % 7 = 0").select(name(k).alias("child"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent"), level.alias("level")))


def problems(s, d):
    nodes = t.table(s, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node"))
    every = nodes.unionByName(t.table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node")))
    return fixpoint.problems(deep(s, d), every)


def renames(s, d):
    """Parts renamed to the part of half their number, every third also to the next; so chains, forks and, at the end, one name."""
    p = t.table(s, d, "part").filter("p_partkey % 10 > 4").select("p_partkey")
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("P"), x.cast("string"))
    back = p.filter("p_partkey % 3 = 0").select(name(k).alias("old"), name(k + 1).alias("canonical"))
    again = p.filter("p_partkey % 6 = 0").select(name(k + 1).alias("old"), name(k).alias("canonical"))
    return p.select(name(k).alias("old"), name(F.floor(k / 2)).alias("canonical")).unionByName(back).unionByName(again)


def settled(s, d):
    """Renames followed to the end; of several last names the dearest part's is kept."""
    facts = t.table(s, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_retailprice").alias("price"))
    return fixpoint.settled_names(renames(s, d), [-F.coalesce("price", F.lit(0.0))], facts)


def merged_lines(s, d):
    """Lines counted by the part's settled name, by the edge writer that drops repeats."""
    lines = t.table(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name")).distinct()
    return maintain.redirect(lines, settled(s, d), ["name"]).groupBy("name").agg(F.count("*").alias("n_orders"))


QUERIES = {
    "hierarchy_deep_problems": problems,
    "hierarchy_deep_levels": lambda s, d: fixpoint.levels(deep(s, d)),
    "maintain_settled_names": settled,
    "maintain_merged_chains": merged_lines,
}

_DEEP = """edges AS (SELECT 'C' || c_custkey AS child, 'C' || CASE WHEN (c_custkey // 12) % 5 = 0 THEN CASE WHEN c_custkey % 12 = 11 THEN c_custkey - 11 ELSE c_custkey + 1 END ELSE c_custkey - 1 END AS parent,
  CASE WHEN c_custkey % 9 <> 0 THEN 1 END AS level FROM customer WHERE (c_custkey // 12) % 5 = 0 OR c_custkey % 40 <> 0
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, CASE WHEN c_custkey % 9 <> 0 THEN 1 END FROM customer WHERE c_custkey % 7 = 0)"""
_SETTLED = """k AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 10 > 4),
steps AS (SELECT DISTINCT * FROM (SELECT 'P' || k AS old, 'P' || (k // 2) AS canonical FROM k UNION ALL SELECT 'P' || k, 'P' || (k + 1) FROM k WHERE k % 3 = 0 UNION ALL SELECT 'P' || (k + 1), 'P' || k FROM k WHERE k % 6 = 0) WHERE old <> canonical),
both_ways AS (SELECT old AS a, canonical AS b FROM steps UNION SELECT canonical, old FROM steps),
linked(a, b) AS (SELECT a, a FROM both_ways UNION SELECT l.a, w.b FROM linked l JOIN both_ways w ON w.a = l.b),
component AS (SELECT a AS name, min(b) AS component FROM linked GROUP BY 1),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY component ORDER BY name IN (SELECT old FROM steps), coalesce(p_retailprice, 0) DESC, name) AS place
  FROM component c LEFT JOIN part ON 'P' || p_partkey = name),
settled AS (SELECT c.name AS old, r.name AS canonical FROM component c JOIN ranked r ON r.component = c.component AND r.place = 1 WHERE c.name <> r.name)"""

ORACLE = {
    "hierarchy_deep_problems": f"""WITH RECURSIVE {_DEEP}, above(node, ancestor) AS (SELECT child, parent FROM edges UNION SELECT a.node, e.parent FROM above a JOIN edges e ON e.child = a.ancestor),
every AS (SELECT 'C' || c_custkey AS node FROM customer UNION SELECT 'N' || n_nationkey FROM nation)
SELECT 'cycle' AS kind, node FROM above WHERE node = ancestor
UNION SELECT 'orphan', node FROM every WHERE node NOT IN (SELECT child FROM edges) AND node NOT IN (SELECT parent FROM edges)
UNION SELECT 'no_level', child FROM edges WHERE level IS NULL""",
    "hierarchy_deep_levels": f"""WITH RECURSIVE {_DEEP}, roots AS (SELECT DISTINCT parent AS node FROM edges WHERE parent NOT IN (SELECT child FROM edges)),
down(node, level) AS (SELECT node, 0 FROM roots UNION SELECT e.child, d.level + 1 FROM down d JOIN edges e ON e.parent = d.node WHERE d.level < 120)
SELECT node, min(level) AS level FROM down GROUP BY 1""",
    "maintain_settled_names": f"WITH RECURSIVE {_SETTLED} SELECT old, canonical FROM settled",
    "maintain_merged_chains": f"""WITH RECURSIVE {_SETTLED}, l AS (SELECT DISTINCT l_orderkey, 'P' || l_partkey AS name FROM lineitem)
SELECT coalesce(canonical, name) AS name, count(DISTINCT l_orderkey) AS n_orders FROM l LEFT JOIN settled ON old = name GROUP BY 1""",
}
