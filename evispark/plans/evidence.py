"""Conflict, synthesis and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions.levels import CONFLICT, SYNTHESIS, case_sql
from evispark.operators import conflict, synthesis
from evispark.operators.pairs import pairs_within
from evispark.sources import tables as t
from evispark.sources.tables import with_tables

D = lambda x: f"CAST({x} AS DOUBLE)"

QUERIES = {
    "conflict_report": lambda s, d: conflict.conflict_report(t.evidence(s, d).repartition(t.parts(s, d, "lineitem"), *conflict.PAIR)),
    "conflict_gap_pairs": lambda s, d: conflict.gap_conflicts(t.evidence(s, d)),
    "conflict_within_pair": lambda s, d: conflict.opposed_counts(t.affects(s, d).filter("is_significant")),
    "conflict_across_interventions": lambda s, d: _across(s, d),
    "synthesis_pooled": lambda s, d: synthesis.pooled(t.evidence(s, d), "effect"),
    "synthesis_grade": lambda s, d: synthesis.synthesize(t.evidence(s, d), "effect"),
    "synthesis_i_squared": lambda s, d: synthesis.i_squared(t.affects(s, d).withColumn("variance", F.col("p_value") * 100), "effect", "variance", ("outcome",)),
    "synthesis_split": lambda s, d: synthesis.supporting_split(t.evidence(s, d)),
    "synthesis_hierarchical": lambda s, d: _hierarchical(s, d),
}


def _across(s, d):
    """Pairs of interventions of one category with significant findings in opposite directions on an outcome, from counts by direction."""
    facts = t.affects(s, d).filter("is_significant AND direction <> 'unchanged'").join(t.intervention(s, d), "intervention")
    # both directions in one row, so that a pair is a row of the result and isn't shuffled again
    counts = facts.groupBy("category", "outcome", "intervention").agg(F.count_if(F.col("direction") == "improved").alias("up"), F.count_if(F.col("direction") == "worsened").alias("down"))
    n = F.col("a.up") * F.col("b.down") + F.col("a.down") * F.col("b.up")
    pairs = pairs_within(counts, ["category", "outcome"], "intervention")
    return pairs.select(F.col("a.intervention").alias("first"), F.col("b.intervention").alias("second"), F.col("a.outcome").alias("outcome"), n.alias("n_conflicts")).filter("n_conflicts > 0")


def _hierarchical(s, d):
    """Synthesis of each category: its interventions' facts together."""
    facts = t.evidence(s, d).join(t.intervention(s, d).select("intervention", "category"), "intervention")
    return synthesis.synthesize(facts, "effect", ("category", "outcome"))


_score = case_sql("evidence_level", CONFLICT, 1.0)
_weight = case_sql("evidence_level", SYNTHESIS, 0.1)


def synthesis_ctes(keys: str, source: str) -> str:
    """Tables g, h and k of a synthesis by the keys; k has direction, heterogeneity and strength."""
    return f"""g AS (SELECT {keys}, count(*) AS n, avg(effect) AS m, stddev_samp(effect) AS sd,
  count(*) FILTER (WHERE evidence_level IN ('1a', '1b')) AS high_level, avg(CAST(CAST(is_significant AS INTEGER) AS DOUBLE)) AS significant, min(evidence_level) AS first_level,
  count(*) FILTER (WHERE direction = 'improved') * {D(1)} / count(*) AS up, count(*) FILTER (WHERE direction = 'worsened') * {D(1)} / count(*) AS down,
  count(*) FILTER (WHERE direction = 'unchanged') * {D(1)} / count(*) AS same FROM {source} GROUP BY {keys}),
h AS (SELECT *, CASE WHEN up >= {D(0.7)} THEN 'improved' WHEN down >= {D(0.7)} THEN 'worsened' WHEN same >= {D(0.7)} THEN 'unchanged' ELSE 'mixed' END AS direction,
  greatest(up, down, same) AS mode_share, CASE WHEN n < 2 THEN 'low' WHEN m = 0 THEN 'low' WHEN sd / abs(m) * 100 < 10 THEN 'low' WHEN sd / abs(m) * 100 < 30 THEN 'moderate' ELSE 'high' END AS heterogeneity FROM g),
k AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient' WHEN n >= 3 AND high_level >= 2 AND significant >= {D(0.7)} AND mode_share >= {D(0.8)} THEN 'strong'
  WHEN n >= 2 AND significant >= {D(0.5)} AND mode_share >= {D(0.6)} THEN 'moderate' ELSE 'weak' END AS strength FROM h)"""


def _synthesis_sql(keys: str, source: str) -> str:
    return f"""{synthesis_ctes(keys, source)}
SELECT {keys}, n, direction, heterogeneity, strength, substr('ABCD', CAST(least(3, CASE WHEN first_level IN ('1a', '1b') THEN 0 WHEN first_level IN ('2a', '2b') THEN 1 WHEN first_level = '3' THEN 2 ELSE 3 END
  + CASE heterogeneity WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END + CASE strength WHEN 'weak' THEN 1 WHEN 'insufficient' THEN 2 ELSE 0 END) + 1 AS INTEGER), 1) AS grade FROM k"""


ORACLE = {
    "conflict_report": with_tables(
        "evidence",
        then=f"""SELECT intervention, outcome, n_papers, n_improved, n_worsened, n_unchanged, n_significant,
  CASE WHEN top >= 9 THEN 'critical' WHEN top >= 7 THEN 'high' WHEN top >= 5 THEN 'medium' ELSE 'low' END AS severity,
  round({D(0.2)} * least({D(1)}, n / {D(10)}) + {D(0.4)} * mean_score / 10 + {D(0.3)} * n_significant / (n_improved + n_worsened)
    + {D(0.1)} * (1 - 2 * abs({D(0.5)} - {D("least(n_improved, n_worsened)")} / (n_improved + n_worsened))), 4) AS confidence,
  round({D("least(n_improved, n_worsened)")} / n, 4) AS conflict_ratio
FROM (SELECT intervention, outcome, count(DISTINCT source_paper_id) AS n_papers, count(*) AS n, count(*) FILTER (WHERE direction = 'improved') AS n_improved,
  count(*) FILTER (WHERE direction = 'worsened') AS n_worsened, count(*) FILTER (WHERE direction = 'unchanged') AS n_unchanged,
  max({_score}) FILTER (WHERE direction <> 'unchanged') AS top, avg({_score}) FILTER (WHERE direction <> 'unchanged') AS mean_score,
  count(*) FILTER (WHERE direction <> 'unchanged' AND is_significant) AS n_significant FROM evidence GROUP BY 1, 2) x
WHERE n_papers >= 2 AND n_improved > 0 AND n_worsened > 0""",
    ),
    "conflict_gap_pairs": with_tables(
        "evidence",
        then=f""", s AS (SELECT intervention, outcome, {_score} AS score, count(*) AS n FROM evidence GROUP BY 1, 2, 3)
SELECT a.intervention, a.outcome, CASE WHEN a.score >= 9 THEN 'high' WHEN a.score >= 7 THEN 'medium' ELSE 'low' END AS severity, CAST(sum(a.n * b.n) AS BIGINT) AS n_pairs
FROM s a JOIN s b ON a.intervention = b.intervention AND a.outcome = b.outcome AND a.score - b.score >= 5 GROUP BY 1, 2, 3""",
    ),
    "conflict_within_pair": with_tables(
        "affects",
        then=""", f AS (SELECT * FROM affects WHERE is_significant)
SELECT a.intervention, a.outcome, count(*) AS n_pairs, min(abs(a.source_paper_id - b.source_paper_id)) AS closest
FROM f a JOIN f b ON a.intervention = b.intervention AND a.outcome = b.outcome AND a.source_paper_id <> b.source_paper_id AND a.direction <> b.direction GROUP BY 1, 2""",
    ),
    "conflict_across_interventions": with_tables(
        "affects", "intervention",
        then=""", c AS (SELECT category, outcome, intervention, direction, count(*) AS n FROM affects JOIN intervention USING (intervention) WHERE is_significant AND direction <> 'unchanged' GROUP BY 1, 2, 3, 4)
SELECT a.intervention AS first, b.intervention AS second, a.outcome, CAST(sum(a.n * b.n) AS BIGINT) AS n_conflicts
FROM c a JOIN c b ON a.category = b.category AND a.outcome = b.outcome AND a.intervention < b.intervention AND a.direction <> b.direction GROUP BY 1, 2, 3""",
    ),
    "synthesis_pooled": with_tables(
        "evidence",
        then=f""", x AS (SELECT intervention, outcome, effect AS x, {_weight} AS w FROM evidence),
m AS (SELECT intervention, outcome, round(sum(w), 9) AS sw, round(sum(w * x), 9) / round(sum(w), 9) AS mean, count(*) AS n FROM x GROUP BY 1, 2),
v AS (SELECT intervention, outcome, mean, n, sqrt(sum(w * (x - mean) * (x - mean)) / any_value(sw)) / sqrt(n) AS se FROM x JOIN m USING (intervention, outcome) GROUP BY 1, 2, 3, 4)
SELECT intervention, outcome, n, round(mean, 6) AS pooled_mean, round(se, 6) AS std_error, round(mean - {D(1.96)} * se, 6) AS ci_low, round(mean + {D(1.96)} * se, 6) AS ci_high FROM v""",
    ),
    "synthesis_grade": with_tables("evidence", then=", " + _synthesis_sql("intervention, outcome", "evidence")),
    "synthesis_hierarchical": with_tables("evidence", "intervention", then=", j AS (SELECT * FROM evidence JOIN intervention USING (intervention)), " + _synthesis_sql("category, outcome", "j")),
    "synthesis_i_squared": with_tables(
        "affects",
        then=f""", x AS (SELECT outcome, effect AS x, CASE WHEN p_value * 100 > 0 THEN 1 / (p_value * 100) ELSE {D(0)} END AS w FROM affects),
m AS (SELECT outcome, sum(w * x) / sum(w) AS m, count(*) AS n FROM x GROUP BY 1),
q AS (SELECT outcome, n, sum(w * (x - m) * (x - m)) AS q FROM x JOIN m USING (outcome) GROUP BY 1, 2)
SELECT outcome, n, round(CASE WHEN n < 2 OR q IS NULL OR q <= 0 THEN {D(0)} ELSE greatest({D(0)}, (q - (n - 1)) / q * 100) END, 4) AS i_squared FROM q""",
    ),
    "synthesis_split": with_tables(
        "evidence",
        then=""", v AS (SELECT * FROM evidence WHERE direction <> 'unchanged'),
g AS (SELECT intervention, outcome, CASE WHEN count(*) FILTER (WHERE direction = 'improved') >= count(*) FILTER (WHERE direction = 'worsened') THEN 'improved' ELSE 'worsened' END AS main FROM v GROUP BY 1, 2),
p AS (SELECT DISTINCT intervention, outcome, direction = main AS supports, source_paper_id FROM v JOIN g USING (intervention, outcome)),
r AS (SELECT *, row_number() OVER (PARTITION BY intervention, outcome, supports ORDER BY source_paper_id) AS place FROM p)
SELECT intervention, outcome, count(*) FILTER (WHERE supports) AS n_supporting, count(*) FILTER (WHERE NOT supports) AS n_opposing,
  coalesce(string_agg(CAST(source_paper_id AS VARCHAR), ',' ORDER BY source_paper_id) FILTER (WHERE supports AND place <= 5), '') AS supporting,
  coalesce(string_agg(CAST(source_paper_id AS VARCHAR), ',' ORDER BY source_paper_id) FILTER (WHERE NOT supports AND place <= 5), '') AS opposing FROM r GROUP BY 1, 2""",
    ),
}
