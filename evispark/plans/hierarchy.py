"""Hierarchy and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import hierarchy as h
from evispark.operators import inference
from evispark.sources import tables as t
from evispark.sources.tables import with_tables


def _up(s, d):
    return h.closure(t.is_a(s, d))


def _facts(s, d):
    return t.affects(s, d).withColumn("entity", F.concat(F.lit("S"), F.col("intervention").cast("string")))


def _group_facts(s, d):
    """Facts of which every third line reports on the intervention's whole category."""
    lines = t.affects(s, d).join(t.intervention(s, d).select("intervention", "category"), "intervention")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    return lines.withColumn("entity", F.when(F.col("line") % 3 == 0, name("N", "category")).otherwise(name("S", "intervention")))


def _group_treats(s, d):
    """Treatment links of interventions and of their categories, so that members inherit them."""
    own = t.treats(s, d).join(t.intervention(s, d).select("intervention", "category"), "intervention")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string")).alias("entity")
    return own.select(name("S", "intervention"), "pathology").union(own.select(name("N", "category"), "pathology")).distinct()


def _rule(name, **tables):
    return lambda s, d: inference.run_rule(name, **{k: f(s, d) for k, f in tables.items()})


QUERIES = {
    "hierarchy_closure": lambda s, d: _up(s, d).select("node", "ancestor", "distance", F.array_join("path", ">").alias("path")),
    "hierarchy_ancestors": lambda s, d: h.ancestors(_up(s, d), "S1"),
    "hierarchy_descendants": lambda s, d: h.descendants(_up(s, d), "R1"),
    "hierarchy_common_ancestor": lambda s, d: h.common_ancestors(_up(s, d), _pairs(s, d)),
    "hierarchy_levels": lambda s, d: h.levels(_up(s, d)),
    "hierarchy_similar": lambda s, d: h.similar_entities(_up(s, d)),
    "hierarchy_cousins": lambda s, d: h.kin_totals(_up(s, d), most=4).select("node", "distance", "n_relatives"),
    "hierarchy_tree": lambda s, d: h.tree(_up(s, d)),
    "hierarchy_problems": lambda s, d: h.problems(t.is_a(s, d), t.table(s, d, "customer").select(F.concat(F.lit("N"), (F.col("c_nationkey") * 2).cast("string")).alias("node")), _up(s, d)),
    "hierarchy_expand": lambda s, d: h.expand(_up(s, d), t.table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name")), 2),
    "hierarchy_related_evidence": lambda s, d: _related(s, d),
    "rule_transitive_hierarchy": _rule("transitive_hierarchy", up=_up),
    "rule_transitive_descendants": _rule("transitive_descendants", up=_up),
    "rule_transitive_treatment": _rule("transitive_treatment", is_a=t.is_a, treats=_group_treats),
    "rule_indirect_treatment": _rule("indirect_treatment", is_a=t.is_a, treats=_group_treats),
    "rule_comparable_siblings": _rule("comparable_siblings", is_a=t.is_a),
    "rule_comparable_by_category": _rule("comparable_by_category", intervention=t.intervention),
    "rule_comparison_papers": _rule("comparison_papers", investigates=t.investigates, papers=t.paper),
    "rule_aggregate_evidence": _rule("aggregate_evidence", is_a=t.is_a, facts=_group_facts),
    "rule_aggregate_by_pathology": _rule("aggregate_evidence_by_pathology", is_a=t.is_a, treats=_group_treats, facts=_group_facts),
    "rule_combined_outcomes": _rule("combined_outcomes", facts=_facts, investigates=t.investigates, papers=t.paper),
    "rule_conflict_detection": _rule("conflict_detection", facts=_facts),
    "rule_cross_intervention_conflicts": _rule("cross_intervention_conflicts", facts=_facts),
}


def _pairs(s, d):
    n = t.table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("S"), (F.col("s_suppkey") + 1).cast("string")).alias("b"))
    return n


def _related(s, d):
    """Papers of each node's relatives below a shared parent or grandparent, and of the node's ancestors up to there, summed by ancestor."""
    up = _up(s, d)
    papers = t.investigates(s, d).select(F.concat(F.lit("S"), F.col("intervention").cast("string")).alias("node"), "paper_id").groupBy("node").agg(F.count("*").alias("value"))
    kin = h.kin_totals(up, most=4, reach=2, values=papers).groupBy("node").agg(F.sum("total").alias("n_paper_links"), F.sum("n_relatives").alias("n_relatives"))
    above = up.filter("distance <= 2").join(papers.withColumnRenamed("node", "ancestor"), "ancestor", "left").groupBy("node").agg(F.count("*").alias("n_ancestors"), F.coalesce(F.sum("value"), F.lit(0)).alias("n_above"))
    links = (F.coalesce("n_paper_links", F.lit(0)) + F.col("n_above")).cast("long").alias("n_paper_links")
    return above.join(kin, "node", "left").select("node", links, F.coalesce("n_relatives", F.lit(0)).alias("n_relatives"), "n_ancestors")


_facts_sql = "facts AS (SELECT *, 'S' || intervention AS entity FROM affects)"
_self = "reach AS (SELECT node, ancestor, distance FROM up WHERE distance <= {0} UNION ALL SELECT DISTINCT n, n, 0 FROM (SELECT child AS n FROM is_a UNION SELECT parent FROM is_a) z)"
_group = """gt AS (SELECT 'S' || intervention AS entity, pathology FROM treats UNION SELECT 'N' || s_nationkey, pathology FROM treats JOIN supplier ON s_suppkey = intervention)"""
_group_facts_sql = "facts AS (SELECT a.*, CASE WHEN line % 3 = 0 THEN 'N' || s_nationkey ELSE 'S' || intervention END AS entity FROM affects a JOIN supplier ON s_suppkey = intervention)"
W = lambda x: f"CAST({x} AS DOUBLE) AS rule_weight"
_kin = """kin AS (SELECT a.node, b.node AS relative, min(a.distance + b.distance) AS distance FROM up a JOIN up b ON a.ancestor = b.ancestor AND a.node <> b.node
  WHERE a.distance + b.distance <= {0} AND a.distance <= {1} AND b.distance <= {1} {2} GROUP BY 1, 2)"""

# Kin in the narrow sense: neither is an ancestor of the other.
_apart = "AND NOT EXISTS (SELECT 1 FROM up z WHERE z.node = a.node AND z.ancestor = b.node) AND NOT EXISTS (SELECT 1 FROM up z WHERE z.node = b.node AND z.ancestor = a.node)"

ORACLE = {
    "hierarchy_closure": """WITH RECURSIVE is_a AS (SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'ROOT' FROM region),
up AS (SELECT child AS node, parent AS ancestor, 1 AS distance, child || '>' || parent AS path FROM is_a
  UNION ALL SELECT u.node, e.parent, u.distance + 1, u.path || '>' || e.parent FROM up u JOIN is_a e ON u.ancestor = e.child WHERE u.distance < 5)
SELECT node, ancestor, distance, path FROM up""",
    "hierarchy_ancestors": with_tables("up", then="SELECT DISTINCT ancestor, distance FROM up WHERE node = 'S1'"),
    "hierarchy_descendants": with_tables("up", then="SELECT DISTINCT node, distance FROM up WHERE ancestor = 'R1' AND distance <= 3"),
    "hierarchy_common_ancestor": with_tables(
        "up",
        then=""", p AS (SELECT 'S' || s_suppkey AS a, 'S' || (s_suppkey + 1) AS b FROM supplier),
c AS (SELECT p.a, p.b, x.ancestor, x.distance + y.distance AS total, row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.distance + y.distance, x.ancestor) AS rn
  FROM p JOIN up x ON x.node = p.a JOIN up y ON y.node = p.b AND x.ancestor = y.ancestor)
SELECT a, b, ancestor, total AS total_distance FROM c WHERE rn = 1""",
    ),
    "hierarchy_levels": with_tables("up", then="SELECT node, min(distance) AS level FROM up WHERE ancestor = 'ROOT' GROUP BY 1"),
    "hierarchy_similar": with_tables("up", then=", " + _kin.format(2, 1, "") + " SELECT * FROM kin"),
    "hierarchy_cousins": with_tables("up", then=", " + _kin.format(4, 3, _apart) + " SELECT node, distance, count(*) AS n_relatives FROM kin GROUP BY 1, 2"),
    "hierarchy_tree": with_tables("up", then="SELECT ancestor AS root, distance, count(DISTINCT node) AS n_descendants FROM up WHERE distance <= 3 AND ancestor NOT IN (SELECT child FROM is_a) GROUP BY 1, 2"),
    "hierarchy_problems": with_tables(
        "up",
        then="""SELECT 'orphan' AS kind, node FROM (SELECT DISTINCT 'N' || (c_nationkey * 2) AS node FROM customer) c WHERE node NOT IN (SELECT child FROM is_a UNION SELECT parent FROM is_a)
UNION SELECT 'cycle', node FROM up WHERE node = ancestor""",
    ),
    "hierarchy_expand": with_tables(
        "up",
        then=""", n AS (SELECT 'N' || n_nationkey AS name FROM nation)
SELECT name, name AS expanded FROM n UNION SELECT name, ancestor FROM n JOIN up ON node = name WHERE distance <= 2 UNION SELECT name, node FROM n JOIN up ON ancestor = name WHERE distance <= 2""",
    ),
    "hierarchy_related_evidence": with_tables(
        "up", "investigates",
        then=", " + _kin.format(4, 2, _apart)
        + """, n AS (SELECT 'S' || intervention AS x, count(*) AS n FROM investigates GROUP BY 1),
k AS (SELECT node, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_relatives FROM kin LEFT JOIN n ON relative = x GROUP BY 1),
a AS (SELECT node, count(*) AS n_ancestors, CAST(sum(n) AS BIGINT) AS n FROM up LEFT JOIN n ON ancestor = x WHERE distance <= 2 GROUP BY 1)
SELECT node, coalesce(k.n, 0) + coalesce(a.n, 0) AS n_paper_links, coalesce(n_relatives, 0) AS n_relatives, n_ancestors FROM a LEFT JOIN k USING (node)""",
    ),
    "rule_transitive_hierarchy": with_tables("up", then=f"SELECT node, ancestor, distance, {W(1)} FROM up"),
    "rule_transitive_descendants": with_tables("up", then=f"SELECT ancestor AS node, node AS descendant, distance, {W(1)} FROM up"),
    "rule_transitive_treatment": with_tables("up", "treats", then=f", {_self.format(3)}, {_group} SELECT node, pathology, min(distance) AS hierarchy_distance, {W(0.8)} FROM reach JOIN gt ON ancestor = entity GROUP BY 1, 2"),
    "rule_indirect_treatment": with_tables(
        "up", "treats",
        then=f", {_self.format(3)}, {_group} SELECT node, pathology, min(distance) AS hierarchy_distance, {W(0.7)} FROM reach JOIN gt ON ancestor = entity WHERE NOT EXISTS (SELECT 1 FROM gt z WHERE z.entity = node AND z.pathology = gt.pathology) GROUP BY 1, 2",
    ),
    "rule_comparable_siblings": with_tables("is_a", then=f"SELECT a.child AS first, b.child AS second, a.parent, {W(0.9)} FROM is_a a JOIN is_a b ON a.parent = b.parent AND a.child < b.child"),
    "rule_comparable_by_category": with_tables("intervention", then=f"SELECT a.intervention AS first, b.intervention AS second, a.category, {W(0.7)} FROM intervention a JOIN intervention b ON a.category = b.category AND a.intervention < b.intervention"),
    "rule_comparison_papers": with_tables(
        "investigates", "paper",
        then=f"""SELECT a.paper_id, a.intervention, string_agg(CAST(b.intervention AS VARCHAR), ',' ORDER BY b.intervention) AS compared_with, count(*) AS num_comparisons, year, evidence_level, {W(1)}
FROM investigates a JOIN investigates b ON a.paper_id = b.paper_id AND a.intervention <> b.intervention JOIN paper p ON p.paper_id = a.paper_id GROUP BY ALL""",
    ),
    "rule_aggregate_evidence": with_tables(
        "up", "affects",
        then=f""", {_group_facts_sql}, {_self.format(2)}
SELECT node, entity, outcome, direction, distance AS hierarchy_distance, count(*) AS n_findings, count(*) FILTER (WHERE is_significant) AS n_significant, min(p_value) AS least_p, {W(0.9)}
FROM reach JOIN facts ON entity = ancestor GROUP BY ALL""",
    ),
    "rule_aggregate_by_pathology": with_tables(
        "up", "treats", "affects",
        then=f""", {_group}, {_group_facts_sql}, {_self.format(2)}
SELECT node, pathology, f.entity, outcome, direction, distance AS hierarchy_distance, count(*) AS n_findings, min(p_value) AS least_p, {W(0.85)}
FROM reach JOIN gt ON gt.entity = ancestor JOIN facts f ON f.entity = ancestor WHERE is_significant GROUP BY ALL""",
    ),
    "rule_combined_outcomes": with_tables(
        "affects", "paper", "investigates",
        then=f""", {_facts_sql}
SELECT entity, outcome, source_paper_id, direction, p_value, is_significant, effect, evidence_level, {W(1)}
FROM facts f LEFT JOIN (SELECT i.paper_id, i.intervention, evidence_level FROM investigates i JOIN paper USING (paper_id)) p ON p.paper_id = source_paper_id AND p.intervention = f.intervention""",
    ),
    "rule_conflict_detection": with_tables(
        "affects",
        then=f""", {_facts_sql}
SELECT a.entity, a.outcome, count(*) AS n_pairs, {W(1)} FROM facts a JOIN facts b ON a.entity = b.entity AND a.outcome = b.outcome
AND a.source_paper_id <> b.source_paper_id AND a.direction <> b.direction AND a.is_significant AND b.is_significant GROUP BY 1, 2""",
    ),
    "rule_cross_intervention_conflicts": with_tables(
        "affects",
        then=f""", {_facts_sql}, c AS (SELECT outcome, entity, direction, count(*) AS n FROM facts WHERE is_significant GROUP BY 1, 2, 3)
SELECT a.outcome, (SELECT count(DISTINCT entity) FROM c z WHERE z.outcome = a.outcome) AS n_entities, CAST(sum(a.n * b.n) AS BIGINT) AS n_conflicts, {W(1)}
FROM c a JOIN c b ON a.outcome = b.outcome AND a.entity < b.entity AND a.direction <> b.direction GROUP BY 1""",
    ),
}
