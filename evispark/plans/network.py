"""Queries over citations, claims and chains of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import hierarchy as h
from evispark.operators import network as n
from evispark.operators import synthesis
from evispark.plans.evidence import synthesis_ctes
from evispark.sources import tables as t
from evispark.sources.tables import with_tables

D = lambda x: f"CAST({x} AS DOUBLE)"


def cites(s, d):
    """Citations: each paper cites the one of half its number; the context follows the paper's status."""
    o = t.table(s, d, "orders")
    older = o.select(F.col("o_orderkey").alias("target"))
    context = F.when(F.col("o_orderstatus") == "F", "supports").when(F.col("o_orderstatus") == "P", "contradicts").otherwise("background")
    edges = o.select(F.col("o_orderkey").alias("source"), F.floor(F.col("o_orderkey") / 2).alias("target"), context.alias("context"), (F.col("o_orderkey") * 37 % 101 / 100.0).cast("double").alias("confidence"))
    return edges.filter("source <> target").join(older, "target").select("source", "target", "context", "confidence")


def around(s, d):
    """The surroundings of a stated set of papers: those whose number is divisible by 100."""
    centres = t.paper(s, d).filter("paper_id % 100 = 0").select(F.col("paper_id").alias("node"))
    g = n.ego(cites(s, d), centres=centres).groupBy(F.col("node").alias("paper_id"))
    return g.agg(F.count_if(F.col("distance") == 1).alias("n_near"), F.count_if(F.col("distance") == 2).alias("n_far"))


def citation_scores(s, d):
    p = t.paper(s, d).select("paper_id", "year")
    who = t.investigates(s, d).groupBy("paper_id").agg(F.collect_list("intervention").alias("names"))
    known = p.join(who, "paper_id", "left")
    a = known.select(F.col("paper_id").alias("source"), F.col("year").alias("y1"), F.col("names").alias("n1"))
    b = known.select(F.col("paper_id").alias("target"), F.col("year").alias("y2"), F.col("names").alias("n2"))
    both = cites(s, d).select("source", "target").join(a, "source").join(b, "target")
    return both.select("source", "target", F.round(n.citation_confidence(F.col("y1"), F.col("y2"), F.col("n1"), F.col("n2")), 6).alias("confidence"))


def claim_stances(s, d):
    facts = t.affects(s, d)
    claims = facts.select("outcome").distinct().select(F.col("outcome").alias("claim_id"), "outcome", F.lit("improved").alias("claimed"), F.lit("worsened").alias("opposite"))
    # an outcome's name is one of a short list; by outcome the facts would be few tasks' work
    return n.stances(F.broadcast(claims), facts, t.parts(s, d, "lineitem")).groupBy("claim_id", "stance").agg(F.count("*").alias("n_papers"))


def chains(s, d):
    """Confidence of each intervention and outcome: its best findings, moved by the strength of their synthesis."""
    facts = t.evidence(s, d)
    strength = synthesis.synthesize(facts, "effect").select("intervention", "outcome", "strength")
    scored = facts.withColumn("score", (F.col("effect") / 100).cast("double")).join(strength, ["intervention", "outcome"])
    return n.chain_confidence(scored, ["intervention", "outcome"], "score", [F.desc("score"), F.asc("source_paper_id"), F.asc("line")], "strength")


def three_hops(s, d):
    """Paper to pathology, and paper to intervention to outcome, in one report."""
    g = t.studies(s, d).join(t.affects(s, d).withColumnRenamed("source_paper_id", "paper_id"), "paper_id")
    by = g.groupBy("pathology", "outcome", "intervention").agg(F.count("*").alias("n"))
    return by.groupBy("pathology", "outcome").agg(F.count("*").alias("n_interventions"), F.sum("n").alias("n_findings"))


def supplemented(s, d):
    facts = t.affects(s, d).select("intervention", "source_paper_id", "line", "direction", "effect", "is_significant")
    local = facts.filter("direction = 'improved' AND is_significant")
    extra = facts.filter("direction = 'improved' AND NOT is_significant")
    return n.supplement(local, extra, t.intervention(s, d), "intervention", 110).select("intervention", "source_paper_id", "line", "origin")


def drafted(s, d):
    hits = t.affects(s, d).select("source_paper_id", "line", "effect", "final")
    return n.first_per_document(hits, "source_paper_id", [F.desc("final"), F.asc("source_paper_id"), F.asc("line")], 25).select("source_paper_id", "line", "final")


def boosts(s, d):
    up, is_a = h.closure(t.is_a(s, d)), t.is_a(s, d)
    nodes = is_a.select(F.col("child").alias("node")).union(is_a.select("parent"))
    targets = is_a.filter("parent = 'R1'").select(F.col("child").alias("node"))
    return n.distance_boost(up, nodes, targets)


def by_outcome(s, d):
    """Findings grouped by outcome, with the papers they come from counted once."""
    g = t.affects(s, d).groupBy("outcome", "source_paper_id").agg(F.count("*").alias("n"))
    return g.groupBy("outcome").agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_papers"))


QUERIES = {
    "network_research_chain": lambda s, d: n.followers(cites(s, d), parts=t.parts(s, d, "orders")),
    "network_ego": around,
    "join_citing_papers": lambda s, d: n.citing(cites(s, d), t.paper(s, d)),
    "join_citation_confidence": citation_scores,
    "join_claim_stances": claim_stances,
    "join_three_hops": three_hops,
    "agg_chain_confidence": chains,
    "agg_review_papers": lambda s, d: n.reviews((t.investigates(s, d), "intervention"), (t.affects(s, d).withColumnRenamed("source_paper_id", "paper_id"), "outcome")),
    "agg_by_outcome": by_outcome,
    "fusion_supplement": supplemented,
    "fusion_first_per_document": drafted,
    "vector_hierarchy_boost": boosts,
}

CITES = """cites AS (SELECT a.o_orderkey AS source, b.o_orderkey AS target, CASE a.o_orderstatus WHEN 'F' THEN 'supports' WHEN 'P' THEN 'contradicts' ELSE 'background' END AS context,
  (a.o_orderkey * 37 % 101) / CAST(100 AS DOUBLE) AS confidence FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey // 2 AND a.o_orderkey <> b.o_orderkey)"""

ORACLE = {
    "network_research_chain": f"""WITH {CITES}, r AS (SELECT source AS paper, target AS root, 1 AS depth FROM cites
UNION ALL SELECT a.source, b.target, 2 FROM cites a JOIN cites b ON a.target = b.source
UNION ALL SELECT a.source, c.target, 3 FROM cites a JOIN cites b ON a.target = b.source JOIN cites c ON b.target = c.source)
SELECT paper, root, min(depth) AS depth FROM r WHERE paper <> root GROUP BY 1, 2""",
    "network_ego": f"""WITH {CITES}, nb AS (SELECT source AS a, target AS b FROM cites UNION SELECT target, source FROM cites),
r AS (SELECT a, b, 1 AS distance FROM nb UNION ALL SELECT x.a, y.b, 2 FROM nb x JOIN nb y ON x.b = y.a WHERE x.a <> y.b), m AS (SELECT a, b, min(distance) AS distance FROM r GROUP BY 1, 2)
SELECT a AS paper_id, count(*) FILTER (WHERE distance = 1) AS n_near, count(*) FILTER (WHERE distance = 2) AS n_far FROM m WHERE a % 100 = 0 GROUP BY 1""",
    "join_citing_papers": with_tables(
        "paper",
        then=f""", {CITES} SELECT target AS paper_id, count(*) AS n_citing, count(*) FILTER (WHERE context = 'supports') AS n_supporting, count(*) FILTER (WHERE context = 'contradicts') AS n_contradicting,
  max(confidence) AS best_confidence, max(year) AS newest_year FROM cites JOIN paper ON paper_id = source GROUP BY 1""",
    ),
    "join_citation_confidence": with_tables(
        "paper", "investigates",
        then=f""", {CITES}, k AS (SELECT paper_id, count(*) AS n FROM investigates GROUP BY 1),
m AS (SELECT source, target, count(*) AS n FROM cites JOIN investigates i ON i.paper_id = source JOIN investigates j ON j.paper_id = target AND j.intervention = i.intervention GROUP BY 1, 2),
x AS (SELECT c.source, c.target, CASE abs(b.year - a.year) WHEN 0 THEN {D(0.4)} WHEN 1 THEN {D(0.2)} ELSE {D(0)} END AS y, k.n AS names, coalesce(m.n, 0) AS found
  FROM cites c JOIN paper a ON a.paper_id = c.source JOIN paper b ON b.paper_id = c.target LEFT JOIN k ON k.paper_id = c.source LEFT JOIN m ON m.source = c.source AND m.target = c.target)
SELECT source, target, round(CASE WHEN names IS NULL THEN y / {D(0.4)} ELSE y + {D(0.6)} * found / names END, 6) AS confidence FROM x""",
    ),
    "join_claim_stances": with_tables(
        "affects",
        then=""", g AS (SELECT outcome, source_paper_id, bool_or(direction = 'improved') AS yes, bool_or(direction = 'worsened') AS opposed FROM affects GROUP BY 1, 2)
SELECT outcome AS claim_id, CASE WHEN yes AND NOT opposed THEN 'supporting' WHEN opposed AND NOT yes THEN 'refuting' ELSE 'neutral' END AS stance, count(*) AS n_papers FROM g GROUP BY 1, 2""",
    ),
    "join_three_hops": with_tables(
        "studies", "affects",
        then="SELECT pathology, outcome, count(DISTINCT intervention) AS n_interventions, count(*) AS n_findings FROM studies JOIN affects ON source_paper_id = paper_id GROUP BY 1, 2",
    ),
    "agg_chain_confidence": with_tables(
        "evidence",
        then=", " + synthesis_ctes("intervention, outcome", "evidence") + f""", r AS (SELECT intervention, outcome, effect / {D(100)} AS score,
  row_number() OVER (PARTITION BY intervention, outcome ORDER BY effect DESC, source_paper_id, line) AS place FROM evidence),
f AS (SELECT intervention, outcome, avg(score) AS score FROM r WHERE place <= 5 GROUP BY 1, 2)
SELECT intervention, outcome, round(least({D(1)}, score * CASE strength WHEN 'strong' THEN {D(1.2)} WHEN 'moderate' THEN {D(1)} WHEN 'weak' THEN {D(0.8)} ELSE {D(0.5)} END), 6) AS confidence
FROM f JOIN k USING (intervention, outcome)""",
    ),
    "agg_review_papers": with_tables(
        "investigates", "affects",
        then=""", a AS (SELECT paper_id, count(DISTINCT intervention) AS n_intervention FROM investigates GROUP BY 1), b AS (SELECT source_paper_id AS paper_id, count(DISTINCT outcome) AS n_outcome FROM affects GROUP BY 1)
SELECT * FROM a JOIN b USING (paper_id) WHERE n_intervention >= 4 AND n_outcome >= 4""",
    ),
    "agg_by_outcome": with_tables("affects", then="SELECT outcome, count(*) AS n_findings, count(DISTINCT source_paper_id) AS n_papers FROM affects GROUP BY 1"),
    "fusion_supplement": with_tables(
        "affects", "intervention",
        then=""", f AS (SELECT * FROM affects WHERE direction = 'improved'), k AS (SELECT i.intervention FROM intervention i LEFT JOIN f ON f.intervention = i.intervention AND f.is_significant GROUP BY 1 HAVING count(f.line) < 110)
SELECT intervention, source_paper_id, line, 'local' AS origin FROM f WHERE is_significant UNION ALL SELECT intervention, source_paper_id, line, 'extra' FROM f SEMI JOIN k USING (intervention) WHERE NOT is_significant""",
    ),
    "fusion_first_per_document": with_tables(
        "affects",
        then=""", r AS (SELECT source_paper_id, line, final, row_number() OVER (PARTITION BY source_paper_id ORDER BY final DESC, line) AS k FROM affects)
SELECT source_paper_id, line, final FROM r WHERE k = 1 ORDER BY final DESC, source_paper_id LIMIT 25""",
    ),
    "vector_hierarchy_boost": with_tables(
        "up",
        then=f""", w AS (SELECT child AS target FROM is_a WHERE parent = 'R1'), f AS (SELECT target AS node, 0 AS distance FROM w UNION ALL SELECT node, distance FROM up JOIN w ON ancestor = target WHERE distance <= 2
  UNION ALL SELECT ancestor, distance FROM up JOIN w ON node = target WHERE distance <= 2), m AS (SELECT node, min(distance) AS distance FROM f GROUP BY 1), x AS (SELECT child AS node FROM is_a UNION SELECT parent FROM is_a)
SELECT node, distance, CASE distance WHEN 0 THEN {D(1)} WHEN 1 THEN {D(0.85)} WHEN 2 THEN {D(0.7)} ELSE {D(0.5)} END AS boost FROM x LEFT JOIN m USING (node)""",
    ),
}
