"""Recommendation, export, ingestion and event-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import levels as lv
from evispark.operators import recommend as rc
from evispark.sources import files
from evispark.sources import tables as t
from evispark.sources.tables import with_tables
from evispark.streaming import ingest

D = lambda x: f"CAST({x} AS DOUBLE)"

#: (category of intervention, trait, comparison, value, kind, factor)
RULES = [(1, "balance", "lt", 0.0, "absolute", 1.0), (2, "balance", "gt", 9000.0, "relative", 1.0), (3, "segment", "ge", 3.0, "risk", 1.5), (3, "balance", "ge", 5000.0, "risk", 2.0), (4, "segment", "eq", 0.0, "relative", 1.0)]


def recommendations(s, d):
    c = t.table(s, d, "customer")
    patients = c.select(F.col("c_custkey").alias("patient_id"), F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 5).alias("segment"), "c_nationkey")
    rules = s.createDataFrame(RULES, "intervention long, trait string, op string, value double, kind string, factor double")
    matched = rc.matched_rules(patients, rules, ["balance", "segment"])
    facts = t.evidence(s, d).join(t.intervention(s, d).select("intervention", "category"), "intervention").withColumn("intervention", F.col("category").cast("long"))
    options = F.explode(F.array(*(F.lit(x).cast("long") for x in range(1, 6))))
    candidates = patients.select("patient_id", options.alias("intervention"), (F.col("c_nationkey") % 2 == 0).alias("first_line"))
    fit = patients.select("patient_id", options.alias("intervention"), ((F.col("segment") + 1) / 5.0).alias("fit_score"))
    return rc.recommend(candidates, matched, rc.evidence_scores(facts), fit)


def exported(s, d):
    p = t.paper(s, d).select("paper_id", "year", "evidence_level")
    lines = t.affects(s, d).select(F.col("source_paper_id").alias("paper_id"), "line", "intervention", "outcome")
    return files.export_documents(p, {"findings": (lines, "line")}).select("paper_id", F.get_json_object("json", "$.findings[0].outcome").alias("first_outcome"), F.size(F.from_json(F.get_json_object("json", "$.findings"), "array<struct<line:int>>")).alias("n_findings"))


def hourly(s, d):
    e = t.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.windowed_counts(e, "ts", "event_type", "6 hours").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def sliding(s, d):
    e = t.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.windowed_counts(e, "ts", "event_type", "1 day", slide="12 hours").groupBy("event_type").agg(F.count("*").alias("n_windows"), F.max("n_events").alias("busiest"))


def user_sessions(s, d):
    e = t.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = ingest.sessions(e, "ts", "user_id", "2 hours")
    return g.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n_events").alias("longest"))


def rollup_report(s, d):
    """Findings by category, outcome and direction with subtotals."""
    a = t.affects(s, d).join(t.intervention(s, d), "intervention")
    return a.rollup("category", "outcome").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def brief_summaries(s, d):
    """Turns of each conversation joined in order."""
    c = t.table(s, d, "conversations").filter("role = 'user'")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x.text, F.lit("")))
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(turns, "\n"), 256).alias("summary_key"), F.count("*").alias("n_turns"))


QUERIES = {
    "service_recommendations": recommendations,
    "service_export": exported,
    "service_summaries": brief_summaries,
    "events_windows": hourly,
    "events_sliding": sliding,
    "events_sessions": user_sessions,
    "report_rollup": rollup_report,
}
ORACLE = {
    "service_recommendations": with_tables(
        "evidence", "intervention",
        then=f""", e AS (SELECT category AS iv, avg(least({D(1)}, {lv.case_sql("evidence_level", lv.CLINICAL, 0.1)} * CASE WHEN is_significant THEN {D(1.3)} ELSE {D(1)} END)) AS es FROM evidence JOIN intervention USING (intervention) GROUP BY 1),
p AS (SELECT c_custkey AS patient_id, c_acctbal AS b, c_custkey % 5 AS g, c_nationkey % 2 = 0 AS fl FROM customer), x AS (SELECT p.*, CAST(iv AS BIGINT) AS iv, es FROM p, (SELECT unnest(range(1, 6)) AS iv) r LEFT JOIN e USING (iv)),
f AS (SELECT *, iv = 1 AND b < 0 AS abs_, (iv = 2 AND b > 9000) OR (iv = 4 AND g = 0) AS rel, CASE WHEN iv = 3 AND g >= 3 THEN {D(1.5)} ELSE {D(1)} END * CASE WHEN iv = 3 AND b >= 5000 THEN {D(2)} ELSE {D(1)} END AS risk FROM x)
SELECT patient_id, iv AS intervention, round(CASE WHEN abs_ THEN {D(0)} ELSE ({D(0.4)} * coalesce(es, {D(0.3)}) + {D(0.3)} / risk + {D(0.3)} * (g + 1) / {D(5)}) * CASE WHEN fl THEN {D(1.2)} ELSE {D(1)} END * CASE WHEN rel THEN {D(0.9)} ELSE {D(1)} END END, 6) AS score,
  CASE WHEN abs_ THEN 'contraindicated' WHEN rel THEN 'alternative' ELSE 'recommended' END AS verdict FROM f""",
    ),
    "service_export": with_tables(
        "paper", "affects",
        then=""", r AS (SELECT source_paper_id, outcome, row_number() OVER (PARTITION BY source_paper_id ORDER BY line, intervention, outcome) AS rn, count(*) OVER (PARTITION BY source_paper_id) AS n FROM affects)
SELECT paper_id, outcome AS first_outcome, CAST(n AS INTEGER) AS n_findings FROM paper LEFT JOIN r ON paper_id = source_paper_id AND rn = 1""",
    ),
    "service_summaries": "SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS summary_key, count(*) AS n_turns FROM conversations WHERE role = 'user' GROUP BY 1",
    "events_windows": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": """WITH w AS (SELECT event_type, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') AS b FROM events), u AS (SELECT event_type, b FROM w UNION ALL SELECT event_type, b - INTERVAL '12 hours' FROM w),
g AS (SELECT event_type, b, count(*) AS n FROM u GROUP BY 1, 2) SELECT event_type, count(*) AS n_windows, max(n) AS busiest FROM g GROUP BY 1""",
    "events_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l), g AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM g GROUP BY 1""",
    "report_rollup": with_tables("affects", "intervention", then="SELECT category, outcome, count(*) AS n, CAST(CASE WHEN category IS NULL THEN 3 WHEN outcome IS NULL THEN 1 ELSE 0 END AS INTEGER) AS level FROM affects JOIN intervention USING (intervention) GROUP BY ROLLUP (category, outcome)"),
}
