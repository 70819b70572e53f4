"""Queries that keep the graph's tables in order, and that sort questions and comments."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evispark.functions import classify
from evispark.operators import maintain as m
from evispark.plans.network import CITES, cites
from evispark.sources import tables as t
from evispark.sources.staging import staging_dir
from evispark.sources.tables import with_tables
from evispark.sources.writes import merge_write

KNOWN_RELATIONS = ("supports", "contradicts")
PART_RULES = [("^(?:economy|standard)", "plain"), ("^promo", "offer"), ("polished|plated", "finished")]


def _domains(s, d):
    """Customers as papers whose sub-domain is partly missing: null, empty or unknown."""
    segment = F.col("c_mktsegment")
    domain = F.when(segment == "BUILDING", "").when(segment == "MACHINERY", "Unknown").when(segment != "FURNITURE", segment)
    return t.table(s, d, "customer").select("c_custkey", "c_nationkey", domain.alias("sub_domain"))


def unclassified(s, d):
    return _domains(s, d).filter(F.coalesce("sub_domain", F.lit("")).isin("", "Unknown")).select("c_custkey")


def filled(s, d):
    values = t.table(s, d, "customer").join(t.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("sub_domain"))
    return m.fill_missing(_domains(s, d), values, ["c_custkey"], ["sub_domain"]).select("c_custkey", "sub_domain")


def appended(s, d):
    """Pathologies of each intervention, with its own nation's added where it lacks it."""
    have = t.treats(s, d).groupBy("intervention").agg(F.collect_list("pathology").alias("pathologies"))
    own = t.intervention(s, d).join(t.pathology(s, d), F.col("category") == F.col("pathology_key")).select("intervention", F.array("pathology").alias("pathologies"))
    return m.append_once(have, own, ["intervention"], "pathologies").select("intervention", F.array_join("pathologies", "|").alias("pathologies"))


def parents(s, d):
    n, r = t.table(s, d, "nation"), t.table(s, d, "region")
    code = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    concepts = n.select(F.col("n_name").alias("name"), code("N", "n_nationkey").alias("code"), code("R", "n_regionkey").alias("parent_code"))
    concepts = concepts.unionByName(r.select(F.col("r_name").alias("name"), code("R", "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent_code")))
    return m.infer_parents(n.select(F.col("n_name").alias("name")), concepts)


def garbage(s, d):
    nodes = t.intervention(s, d).select("intervention", "name")
    degree = t.affects(s, d).groupBy("intervention").agg(F.count("*").alias("degree")).join(nodes, "intervention").select("name", "degree")
    return m.garbage(nodes, degree, "name", "[05]$", 600)


def redirected(s, d):
    """Each paper's interventions, with those of one category merged into the first."""
    i = t.intervention(s, d)
    kept = i.groupBy("category").agg(F.min("intervention").alias("canonical"))
    mapping = i.join(kept, "category").filter("intervention <> canonical").select(F.col("intervention").alias("old"), "canonical")
    return m.redirect(t.investigates(s, d), mapping, ["intervention"]).select("paper_id", "intervention")


def by_rules(s, d):
    return m.assign_by_rules(t.table(s, d, "part").select("p_partkey", "p_type"), "p_type", PART_RULES, "kind").select("p_partkey", "kind")


def replaced(s, d):
    """Lines of each paper, with one new line in place of all lines of pending papers."""
    lines = t.affects(s, d).select("source_paper_id", "line", "effect")
    new = t.paper(s, d).filter("status = 'P'").select(F.col("paper_id").alias("source_paper_id"), F.lit(0).alias("line"), F.lit(1.0).alias("effect"))
    whole = m.replace_children(lines, new, "source_paper_id")
    return whole.groupBy("source_paper_id").agg(F.count("*").alias("n_lines"), F.sum("effect").alias("effect"))


def checked_relations(s, d):
    edges = cites(s, d).withColumnRenamed("context", "kind").withColumn("confidence", F.col("confidence") * 1.25)
    valid, refused = m.valid_relations(edges, KNOWN_RELATIONS)
    both = valid.withColumn("valid", F.lit(True)).unionByName(refused.withColumn("valid", F.lit(False)))
    return both.groupBy("kind", "valid").agg(F.count("*").alias("n"))


def merge_counters(s, d):
    """What two merges of customers wrote: all of them, then a new nation for every third and a new name for every tenth."""
    c = t.table(s, d, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_custkey").cast("string").alias("name"), F.col("c_nationkey").cast("int").alias("nation"), F.col("c_acctbal").alias("balance"))
    moved = c.filter("CAST(name AS BIGINT) % 3 = 0").withColumns({"nation": (F.col("nation") + 1) % 25, "balance": F.lit(None).cast("double")})
    added = c.filter("CAST(name AS BIGINT) % 10 = 0").withColumns({"name": F.concat(F.lit("X"), "name"), "nation": F.lit(None).cast("int")})
    path = f"{staging_dir(s)}/merged-{uuid.uuid4().hex}"
    found = [merge_write(s, path, changes, ["label", "name"], "label") for changes in (c, moved.unionByName(added))]
    rows = [(i, x.created, x.updated, x.properties_set) for i, x in enumerate(found, start=1)]
    return s.createDataFrame(rows, "step int, created long, updated long, properties_set long")


def sorted_questions(s, d):
    c = t.table(s, d, "conversations").filter("role = 'user'")
    kind, comment = classify.first(F.col("text"), classify.QUERY_TYPES, "exploratory"), classify.first(F.col("text"), classify.COMMENTS, "minor")
    return c.groupBy(F.coalesce(kind, F.lit("exploratory")).alias("kind"), F.coalesce(comment, F.lit("minor")).alias("comment")).agg(F.count("*").alias("n"))


QUERIES = {
    "filter_unclassified": unclassified,
    "maintain_fill_missing": filled,
    "maintain_append_once": appended,
    "maintain_infer_parents": parents,
    "maintain_garbage": garbage,
    "maintain_redirect": redirected,
    "maintain_assign_rules": by_rules,
    "maintain_replace_children": replaced,
    "maintain_valid_relations": checked_relations,
    "text_question_types": sorted_questions,
    "maintain_merge_counters": merge_counters,
}

_DOMAINS = "domains AS (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN 'Unknown' WHEN 'FURNITURE' THEN NULL ELSE c_mktsegment END AS sub_domain FROM customer)"
_first = lambda rules, default: "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in rules) + f" ELSE '{default}' END"

ORACLE = {
    "maintain_merge_counters": """SELECT 1 AS step, count(*) AS created, 0 AS updated, count(c_nationkey) + count(c_acctbal) AS properties_set FROM customer
UNION ALL SELECT 2, count(*) FILTER (WHERE c_custkey % 10 = 0), count(*) FILTER (WHERE c_custkey % 3 = 0), count(*) FILTER (WHERE c_custkey % 3 = 0) + count(c_acctbal) FILTER (WHERE c_custkey % 10 = 0) FROM customer""",
    "filter_unclassified": f"WITH {_DOMAINS} SELECT c_custkey FROM domains WHERE sub_domain IS NULL OR sub_domain IN ('', 'Unknown')",
    "maintain_fill_missing": f"WITH {_DOMAINS} SELECT c_custkey, coalesce(nullif(sub_domain, ''), n_name) AS sub_domain FROM domains LEFT JOIN nation ON c_nationkey = n_nationkey",
    "maintain_append_once": with_tables(
        "treats", "intervention",
        then=""", r AS (SELECT intervention, pathology FROM treats UNION SELECT intervention, pathology FROM intervention JOIN pathology ON category = pathology_key)
SELECT intervention, string_agg(pathology, '|' ORDER BY pathology) AS pathologies FROM r GROUP BY 1""",
    ),
    "maintain_infer_parents": "SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> r_name",
    "maintain_garbage": with_tables("affects", "intervention", then="SELECT name FROM intervention i LEFT JOIN affects a ON a.intervention = i.intervention WHERE regexp_matches(name, '[05]$') GROUP BY name HAVING count(a.line) <= 600"),
    "maintain_redirect": with_tables(
        "investigates", "intervention",
        then="SELECT DISTINCT paper_id, k AS intervention FROM investigates JOIN (SELECT intervention, min(intervention) OVER (PARTITION BY category) AS k FROM intervention) USING (intervention)",
    ),
    "maintain_assign_rules": "SELECT p_partkey, " + " ".join(["CASE", *(f"WHEN regexp_matches(lower(p_type), '{p}') THEN '{k}'" for p, k in PART_RULES), "END AS kind FROM part"]),
    "maintain_replace_children": with_tables(
        "affects", "paper",
        then=""", r AS (SELECT source_paper_id, effect FROM affects ANTI JOIN (SELECT paper_id FROM paper WHERE status = 'P') p ON p.paper_id = source_paper_id
  UNION ALL SELECT paper_id, CAST(1 AS DOUBLE) FROM paper WHERE status = 'P') SELECT source_paper_id, count(*) AS n_lines, sum(effect) AS effect FROM r GROUP BY 1""",
    ),
    "maintain_valid_relations": f"WITH {CITES} SELECT context AS kind, context IN ('supports', 'contradicts') AND confidence * CAST(1.25 AS DOUBLE) BETWEEN 0 AND 1 AS valid, count(*) AS n FROM cites GROUP BY 1, 2",
    "text_question_types": f"SELECT {_first(classify.QUERY_TYPES, 'exploratory')} AS kind, {_first(classify.COMMENTS, 'minor')} AS comment, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1, 2",
}
