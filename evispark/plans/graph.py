"""Filter, join and plain aggregation queries over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import levels as lv
from evispark.functions.numeric import rounded
from evispark.operators import filters as f
from evispark.operators.pairs import pairs_within
from evispark.sources import tables as t
from evispark.sources.tables import with_tables

D = lambda x: f"CAST({x} AS DOUBLE)"


def by_level(s, d):
    return f.newest(f.level_filter(t.paper(s, d), ["1a"], ["BUILDING"]), 50).select("paper_id", "year", "sub_domain")


def level_ranked(s, d):
    p = f.level_filter(t.paper(s, d), f.acceptable_levels("2a"))
    return p.groupBy("evidence_level", "year").agg(F.count("*").alias("n_papers")).withColumn("level_rank", lv.rank("evidence_level", 5))


def demographics_or(s, d):
    """Papers that meet any of the conditions, joined to their own findings."""
    p = t.paper(s, d).filter((F.col("sample_size") > 400) | (F.col("year") == 1999) & (F.col("status") == "P"))
    a = t.affects(s, d)
    return a.join(p, a.source_paper_id == p.paper_id).groupBy("outcome").agg(F.count("*").alias("n_findings"), F.count_distinct("paper_id").alias("n_papers"))


def effective(s, d):
    a = t.affects(s, d).filter("is_significant AND direction = 'improved' AND outcome = 'PROMO'")
    return a.orderBy(F.asc_nulls_last("p_value"), "source_paper_id", "line").limit(100).select("intervention", "source_paper_id", "line", "p_value")


def outcome_fallback(s, d):
    hits = f.exact_or_like(t.affects(s, d).select("intervention", "outcome"), "outcome", "STANDARD polished")
    return hits.groupBy("outcome", "exact").agg(F.count_distinct("intervention").alias("n_interventions"))


def visible_papers(s, d):
    return f.visible(t.paper(s, d), 7, shared=F.col("status") == "P").groupBy("status").agg(F.count("*").alias("n_papers"))


def cohorts(s, d):
    p = f.optional(t.paper(s, d), F.col("sample_size") >= 100, None, F.col("sub_domain") == "MACHINERY")
    links = t.investigates(s, d)
    g = p.join(links, "paper_id").groupBy("paper_id", "sample_size").agg(F.array_join(F.array_sort(F.collect_set(F.col("intervention").cast("string"))), ",").alias("interventions"))
    return g.orderBy(F.desc("sample_size"), "paper_id").limit(50)


def follow_ups(s, d):
    a = t.affects(s, d).filter(F.col("effect").between(10, 20))
    return a.groupBy("source_paper_id").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"), F.min("effect").alias("earliest")).filter("earliest > 15")


def costs(s, d):
    return t.affects(s, d).groupBy("intervention").agg(rounded(F.avg("final"), 4).alias("mean_cost"), F.round(F.sum("final"), 2).alias("total_cost")).filter("mean_cost > 25000")


def quality_rating(s, d):
    """Interventions rated by their share of significant findings, at or above moderate."""
    g = t.affects(s, d).groupBy("intervention").agg(F.avg(F.col("is_significant").cast("double")).alias("share"))
    rating = F.when(F.col("share") >= 0.6, "high").when(F.col("share") >= 0.55, "moderate").when(F.col("share") >= 0.5, "low").otherwise("very low")
    points = F.when(F.col("rating") == "high", 4).when(F.col("rating") == "moderate", 3).when(F.col("rating") == "low", 2).otherwise(1)
    return g.withColumn("rating", rating).withColumn("points", points).filter("points >= 3").select("intervention", "rating", "points")


def general_search(s, d):
    return t.table(s, d, "part").filter(F.contains(F.lower("p_name"), F.lit("part 1")) | (F.col("p_type") == "PROMO")).groupBy("p_brand").agg(F.count("*").alias("n"))


def rare_unmapped(s, d):
    """Interventions without a frequent treatment link and with few references, references counted before the join."""
    refs = t.investigates(s, d).groupBy("intervention").agg(F.count("*").alias("refs"))
    strong = t.treats(s, d).filter("paper_count >= 30")
    return f.without_partner(t.intervention(s, d), strong, "intervention").join(refs, "intervention", "left").select("intervention", F.coalesce("refs", F.lit(0)).alias("refs")).filter("refs <= 600")


def papers_without_lines(s, d):
    o = t.table(s, d, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderstatus")
    return f.without_partner(o, t.affects(s, d).select(F.col("source_paper_id").alias("paper_id")), "paper_id").groupBy("o_orderstatus").agg(F.count("*").alias("n_papers"))


def duplicate_names(s, d):
    c = t.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_key"))
    return c.groupBy("text_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def pathology_interventions(s, d):
    """Treatment links with the intervention's significant outcomes, aggregated before the left join."""
    sig = t.affects(s, d).filter("is_significant").groupBy("intervention").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"), F.count("*").alias("n_significant"))
    return t.treats(s, d).join(sig, "intervention", "left").select("intervention", "pathology", "paper_count", "outcomes", "n_significant")


def treatment_comparison(s, d):
    """Pairs of interventions of one category that treat a pathology, with mean p-values on the outcomes they share."""
    means = t.affects(s, d).groupBy("intervention", "outcome").agg(F.avg("p_value").alias("p"))
    # one map of outcomes an intervention, as long as the list of outcomes, so that pairs meet their means without a shuffle by outcome
    maps = means.groupBy("intervention").agg(F.map_from_entries(F.collect_list(F.struct("outcome", rounded(F.col("p"), 6)))).alias("of"))
    # and one list of pathologies, so that a pair meets once and not once for each that it shares
    treated = t.treats(s, d).groupBy("intervention").agg(F.collect_list("pathology").alias("pathologies"))
    tr = treated.join(t.intervention(s, d).select("intervention", "category"), "intervention").join(maps, "intervention")
    pairs = pairs_within(tr, ["category"], "intervention")
    names = [F.col("a.intervention").alias("first"), F.col("b.intervention").alias("second")]
    shared = pairs.select(*names, F.col("a.of").alias("own"), F.col("b.of").alias("other"), F.explode(F.array_intersect("a.pathologies", "b.pathologies")).alias("pathology"))
    rows = shared.select("pathology", "first", "second", "other", F.explode("own").alias("outcome", "p1"))
    return rows.select("pathology", "first", "second", "outcome", "p1", F.try_element_at("other", F.col("outcome")).alias("p2"))


def head_to_head(s, d):
    """Papers that report on two interventions, with counts of their findings for each."""
    parts = t.parts(s, d, "lineitem")
    g = t.affects(s, d).repartition(parts, "source_paper_id").groupBy("source_paper_id", "intervention").agg(F.min("p_value").alias("p"))
    a, b = g.alias("a"), g.alias("b")
    both = a.join(b, (F.col("a.source_paper_id") == F.col("b.source_paper_id")) & (F.col("a.intervention") < F.col("b.intervention")))
    # most pairs share one paper, so pairs are dealt first and counted once
    pairs = both.select(F.col("a.intervention").alias("first"), F.col("b.intervention").alias("second"), (F.col("a.p") < F.col("b.p")).alias("stronger")).repartition(parts, "first", "second")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n_papers"), F.count_if("stronger").alias("first_stronger"))


def paper_star(s, d):
    """Each paper with its pathology, interventions and outcomes; branches aggregated before they meet."""
    ints = t.investigates(s, d).groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%05d", "intervention"))), ",").alias("interventions"))
    outs = t.affects(s, d).groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"))
    return t.studies(s, d).join(ints, "paper_id", "left").join(outs, "paper_id", "left")


def compare_outcomes(s, d):
    """Outcomes of two categories side by side: shared, or of one only."""
    facts = t.affects(s, d).filter("is_significant").join(t.intervention(s, d).select("intervention", "category"), "intervention")
    facts = facts.withColumn("outcome", F.concat_ws("/", "outcome", F.col("effect").cast("int").cast("string")))
    one = facts.filter("category = 1").groupBy("outcome").agg(F.count("*").alias("n1"))
    two = facts.filter("category = 2").groupBy("outcome").agg(F.count("*").alias("n2"))
    where = F.when(F.col("n1").isNotNull() & F.col("n2").isNotNull(), "shared").when(F.col("n2").isNull(), "first").otherwise("second")
    return one.join(two, "outcome", "full_outer").select("outcome", "n1", "n2", where.alias("bucket"))


def evidence_chain(s, d):
    """Pathology to intervention to outcome: findings of papers that study the pathology."""
    a = t.affects(s, d).filter("is_significant")
    st = t.studies(s, d)
    return a.join(st, a.source_paper_id == st.paper_id).groupBy("pathology", "intervention", "outcome").agg(F.count("*").alias("n_findings"), F.round(F.min("p_value"), 6).alias("least_p")).filter("n_findings >= 2")


def descendant_evidence(s, d):
    """Findings of every group through its members, on outcomes whose name contains a word."""
    a = t.affects(s, d).filter(F.contains("outcome", F.lit("AN")))
    g = a.groupBy("intervention", "outcome").agg(F.count("*").alias("n"), F.count_if(F.col("is_significant") | (F.col("p_value") < 0.05)).alias("n_sig"))
    groups = t.intervention(s, d).join(t.pathology(s, d), F.col("category") == F.col("pathology_key")).select("intervention", "region_key")
    return g.join(groups, "intervention").groupBy("region_key", "outcome").agg(F.sum("n").alias("n_findings"), F.sum("n_sig").alias("n_significant"))


def shared_entities(s, d):
    """Interventions in all of a customer's papers (intersection) and in any (union), for customers with papers enough."""
    p = t.paper(s, d).select("paper_id", "owner")
    total = p.groupBy("owner").agg(F.count("*").alias("n_papers"))
    per = p.join(t.investigates(s, d), "paper_id").groupBy("owner", "intervention").agg(F.count("*").alias("n"))
    g = per.join(total, "owner").groupBy("owner", "n_papers").agg(F.count("*").alias("n_union"), F.count_if(F.col("n") == F.col("n_papers")).alias("n_common"))
    return g.filter("n_papers >= 3")


def document_list(s, d):
    """Papers with counts of their lines, tier 1 being the significant ones."""
    a = t.affects(s, d).groupBy("source_paper_id").agg(F.count("*").alias("n_chunks"), F.count_if("is_significant").alias("n_tier1"))
    p = t.paper(s, d)
    return p.join(a, p.paper_id == a.source_paper_id, "left").groupBy("sub_domain", "year").agg(F.count("*").alias("n_papers"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("n_tier1"), F.lit(0)).alias("n_tier1"))


def paper_relations(s, d):
    """Undirected neighbours: papers of one owner in successive years, both ways, without repeats."""
    p = t.paper(s, d).select("paper_id", "owner", "year")
    out = p.alias("a").join(p.alias("b"), (F.col("a.owner") == F.col("b.owner")) & (F.col("a.year") + 1 == F.col("b.year"))).select(F.col("a.paper_id").alias("paper_id"), F.col("b.paper_id").alias("other"))
    both = out.withColumn("direction", F.lit("out")).union(out.select(F.col("other"), F.col("paper_id"), F.lit("in")))
    return both.distinct().groupBy("paper_id").agg(F.count_if(F.col("direction") == "out").alias("n_out"), F.count_if(F.col("direction") == "in").alias("n_in"))


def citation_match(s, d):
    """Best earlier order for each return: same customer (year within one), most confident, ties by key."""
    o = t.table(s, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderstatus")
    want, have = o.filter("o_orderstatus = 'P'").alias("w"), o.filter("o_orderstatus <> 'P'").alias("h")
    pairs = want.join(have, (F.col("w.o_custkey") == F.col("h.o_custkey")) & (F.abs(F.col("w.year") - F.col("h.year")) <= 1))
    year = F.when(F.col("w.year") == F.col("h.year"), 0.4).otherwise(0.2)
    score = F.round(year + F.when(F.col("w.o_orderpriority") == F.col("h.o_orderpriority"), 0.6).otherwise(0.0), 4)
    scored = pairs.select(F.col("w.o_orderkey").alias("citing"), F.col("h.o_orderkey").alias("cited"), score.alias("confidence"))
    best = F.max_by(F.struct("cited", "confidence"), F.struct("confidence", -F.col("cited")))
    return scored.groupBy("citing").agg(best.alias("x")).select("citing", "x.cited", "x.confidence")


def outcome_aggregation(s, d):
    g = t.affects(s, d).groupBy("intervention", "outcome")
    return g.agg(F.count_distinct("source_paper_id").alias("study_count"), rounded(F.avg(F.when(F.col("rate") > 0, F.col("rate") * 100)), 4).alias("mean_rate"), F.max("effect").alias("largest"))


def topic_clusters(s, d):
    """Sub-domains by size, with the newest ten papers of each."""
    p = t.paper(s, d)
    top = f.best_per_group(p, ["sub_domain"], [F.desc("year"), F.col("paper_id")], 10)
    names = top.groupBy("sub_domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))), lambda x: x.paper_id.cast("string")), ",").alias("newest"))
    return p.groupBy("sub_domain").agg(F.count("*").alias("n_papers")).join(names, "sub_domain")


def graph_stats(s, d):
    """Rows of each vertex and edge table."""
    kinds = {"paper": t.table(s, d, "orders"), "intervention": t.table(s, d, "supplier"), "pathology": t.table(s, d, "nation"), "affects": t.table(s, d, "lineitem"), "investigates": t.investigates(s, d), "is_a": t.is_a(s, d)}
    out = None
    for name, df in kinds.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def import_statistics(s, d):
    p = t.paper(s, d)
    return p.groupBy("year").agg(*(F.count_if(F.col("status") == x).alias(f"n_{x.lower()}") for x in "FOP"), F.count_if(F.col("status").isNull()).alias("n_unknown"))


def evidence_counts(s, d):
    return t.affects(s, d).groupBy("intervention").agg(F.count_distinct("outcome").alias("n_outcomes"), F.count("*").alias("n_findings"), rounded(F.avg("p_value"), 6).alias("mean_p"), F.min("p_value").alias("least_p"), F.max("p_value").alias("most_p"))


def best_evidence(s, d):
    """Interventions for each pathology by best level, then number of papers; the first five."""
    tr = t.investigates(s, d).join(t.studies(s, d), "paper_id").join(t.paper(s, d).select("paper_id", "evidence_level"), "paper_id")
    g = tr.groupBy("pathology", "intervention").agg(F.min(lv.rank("evidence_level", 7)).alias("best_rank"), F.count("*").alias("n_papers"))
    return f.best_per_group(g, ["pathology"], [F.asc("best_rank"), F.desc("n_papers"), F.asc("intervention")], 5)


def recommendation(s, d):
    g = t.affects(s, d).groupBy("intervention", "outcome").agg(F.count("*").alias("evidence_count"), F.avg("p_value").alias("p"), F.count_if("is_significant").alias("n_significant"))
    verdict = F.when((F.col("n_significant") >= 60) & (F.col("p") < 0.04), "recommended").when(F.col("n_significant") >= 50, "consider").otherwise("insufficient")
    return g.select("intervention", "outcome", "evidence_count", rounded(F.col("p"), 6).alias("mean_p"), "n_significant", verdict.alias("recommendation"))


def usage_cost(s, d):
    """Priced sums over the event log, with those since a time."""
    e = t.table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n_calls"), F.sum("k").alias("tokens"), F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).alias("n_recent"), F.round(F.sum("value") * 0.8 / 1000 + F.sum("k") * 4.0 / 1000, 6).alias("cost"))


def reasoning_confidence(s, d):
    """Confidence of the five strongest findings of each outcome, with a bonus for agreement."""
    e = t.evidence(s, d).withColumn("w", lv.weight("evidence_level", lv.REASONER, 0.25))
    top = f.best_per_group(e, ["outcome", "intervention"], [F.desc("w"), F.asc("p_value"), F.asc("source_paper_id"), F.asc("line")], 5)
    g = top.groupBy("outcome", "intervention").agg(F.avg("w").alias("m"), F.count_distinct("direction").alias("kinds"))
    boost = F.when(F.col("kinds") == 1, 1.2).when(F.col("kinds") == 2, 1.0).otherwise(0.8)
    return g.select("outcome", "intervention", rounded(F.least(F.lit(1.0), F.col("m") * boost), 6).alias("confidence"))


def level_distribution(s, d):
    return t.evidence(s, d).groupBy("evidence_level", "direction").agg(F.count("*").alias("n"))


QUERIES = {
    "filter_by_level": by_level,
    "filter_level_ranked": level_ranked,
    "filter_demographics_or": demographics_or,
    "filter_effective": effective,
    "filter_outcome_fallback": outcome_fallback,
    "filter_visible": visible_papers,
    "filter_cohorts": cohorts,
    "filter_follow_ups": follow_ups,
    "filter_costs": costs,
    "filter_quality_rating": quality_rating,
    "filter_general_search": general_search,
    "filter_rare_unmapped": rare_unmapped,
    "filter_without_lines": papers_without_lines,
    "filter_duplicates": duplicate_names,
    "join_pathology_interventions": pathology_interventions,
    "join_treatment_comparison": treatment_comparison,
    "join_head_to_head": head_to_head,
    "join_paper_star": paper_star,
    "join_compare_outcomes": compare_outcomes,
    "join_evidence_chain": evidence_chain,
    "join_descendant_evidence": descendant_evidence,
    "join_shared_entities": shared_entities,
    "join_document_list": document_list,
    "join_paper_relations": paper_relations,
    "join_citation_match": citation_match,
    "agg_outcomes": outcome_aggregation,
    "agg_topic_clusters": topic_clusters,
    "agg_graph_stats": graph_stats,
    "agg_import_statistics": import_statistics,
    "agg_evidence_counts": evidence_counts,
    "agg_best_evidence": best_evidence,
    "agg_recommendation": recommendation,
    "agg_usage_cost": usage_cost,
    "agg_reasoning_confidence": reasoning_confidence,
    "agg_level_distribution": level_distribution,
}

_rank5 = "CASE evidence_level WHEN '1a' THEN 1 WHEN '1b' THEN 2 WHEN '2a' THEN 3 WHEN '2b' THEN 4 ELSE {0} END"
ORACLE = {
    "filter_by_level": with_tables("paper", then="SELECT paper_id, year, sub_domain FROM paper WHERE evidence_level = '1a' AND sub_domain = 'BUILDING' ORDER BY year DESC NULLS FIRST, paper_id LIMIT 50"),
    "filter_level_ranked": with_tables("paper", then=f"SELECT evidence_level, year, count(*) AS n_papers, {_rank5.format(5)} AS level_rank FROM paper WHERE evidence_level IN ('1a', '1b', '2a') GROUP BY 1, 2, 4"),
    "filter_demographics_or": with_tables("evidence", then="SELECT outcome, count(*) AS n_findings, count(DISTINCT paper_id) AS n_papers FROM evidence WHERE sample_size > 400 OR (year = 1999 AND status = 'P') GROUP BY 1"),
    "filter_effective": with_tables("affects", then="SELECT intervention, source_paper_id, line, p_value FROM affects WHERE is_significant AND direction = 'improved' AND outcome = 'PROMO' ORDER BY p_value ASC NULLS LAST, source_paper_id, line LIMIT 100"),
    "filter_outcome_fallback": with_tables("affects", then="SELECT outcome, false AS exact, count(DISTINCT intervention) AS n_interventions FROM affects WHERE lower(outcome) LIKE '%standard%' OR 'standard polished' LIKE '%' || lower(outcome) || '%' GROUP BY 1"),
    "filter_visible": with_tables("paper", then="SELECT status, count(*) AS n_papers FROM paper WHERE owner = 7 OR status = 'P' GROUP BY 1"),
    "filter_cohorts": with_tables("paper", "investigates", then="SELECT paper_id, sample_size, string_agg(CAST(intervention AS VARCHAR), ',' ORDER BY CAST(intervention AS VARCHAR)) AS interventions FROM paper JOIN investigates USING (paper_id) WHERE sample_size >= 100 AND sub_domain = 'MACHINERY' GROUP BY 1, 2 ORDER BY sample_size DESC, paper_id LIMIT 50"),
    "filter_follow_ups": with_tables("affects", then="SELECT source_paper_id, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes, min(effect) AS earliest FROM affects WHERE effect BETWEEN 10 AND 20 GROUP BY 1 HAVING min(effect) > 15"),
    "filter_costs": with_tables("affects", then="SELECT intervention, round(avg(final), 4) AS mean_cost, round(sum(final), 2) AS total_cost FROM affects GROUP BY 1 HAVING avg(final) > 25000"),
    "filter_quality_rating": with_tables(
        "affects",
        then=f""", g AS (SELECT intervention, avg(CAST(CAST(is_significant AS INTEGER) AS DOUBLE)) AS share FROM affects GROUP BY 1)
SELECT intervention, CASE WHEN share >= {D(0.6)} THEN 'high' ELSE 'moderate' END AS rating, CASE WHEN share >= {D(0.6)} THEN 4 ELSE 3 END AS points FROM g WHERE share >= {D(0.55)}""",
    ),
    "filter_general_search": "SELECT p_brand, count(*) AS n FROM part WHERE lower(p_name) LIKE '%part 1%' OR p_type = 'PROMO' GROUP BY 1",
    "filter_rare_unmapped": with_tables(
        "treats", "intervention",
        then=", r AS (SELECT intervention, count(*) AS refs FROM investigates GROUP BY 1) SELECT intervention, coalesce(refs, 0) AS refs FROM intervention LEFT JOIN r USING (intervention) WHERE intervention NOT IN (SELECT intervention FROM treats WHERE paper_count >= 30) AND coalesce(refs, 0) <= 600",
    ),
    "filter_without_lines": "SELECT o_orderstatus, count(*) AS n_papers FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1",
    "filter_duplicates": "SELECT sha256(text) AS text_key, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "join_pathology_interventions": with_tables(
        "treats", "affects",
        then=", g AS (SELECT intervention, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes, count(*) AS n_significant FROM affects WHERE is_significant GROUP BY 1) SELECT intervention, pathology, paper_count, outcomes, n_significant FROM treats LEFT JOIN g USING (intervention)",
    ),
    "join_treatment_comparison": with_tables(
        "treats", "affects", "intervention",
        then=""", m AS (SELECT intervention, outcome, avg(p_value) AS p FROM affects GROUP BY 1, 2), r AS (SELECT intervention, pathology, category FROM treats JOIN intervention USING (intervention))
SELECT a.pathology, a.intervention AS first, b.intervention AS second, x.outcome, round(x.p, 6) AS p1, round(y.p, 6) AS p2
FROM r a JOIN r b ON a.pathology = b.pathology AND a.category = b.category AND a.intervention < b.intervention JOIN m x ON x.intervention = a.intervention LEFT JOIN m y ON y.intervention = b.intervention AND y.outcome = x.outcome""",
    ),
    "join_head_to_head": with_tables(
        "affects",
        then=""", g AS (SELECT source_paper_id, intervention, min(p_value) AS p FROM affects GROUP BY 1, 2)
SELECT a.intervention AS first, b.intervention AS second, count(*) AS n_papers, count(*) FILTER (WHERE a.p < b.p) AS first_stronger FROM g a JOIN g b ON a.source_paper_id = b.source_paper_id AND a.intervention < b.intervention GROUP BY 1, 2""",
    ),
    "join_paper_star": with_tables(
        "studies", "investigates", "affects",
        then=""", i AS (SELECT paper_id, string_agg(lpad(CAST(intervention AS VARCHAR), 5, '0'), ',' ORDER BY intervention) AS interventions FROM investigates GROUP BY 1),
o AS (SELECT source_paper_id AS paper_id, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes FROM affects GROUP BY 1)
SELECT paper_id, pathology, interventions, outcomes FROM studies LEFT JOIN i USING (paper_id) LEFT JOIN o USING (paper_id)""",
    ),
    "join_compare_outcomes": with_tables(
        "affects", "intervention",
        then=f""", f AS (SELECT category, outcome || '/' || CAST(CAST(effect AS INTEGER) AS VARCHAR) AS outcome FROM affects JOIN intervention USING (intervention) WHERE is_significant),
a AS (SELECT outcome, count(*) AS n1 FROM f WHERE category = 1 GROUP BY 1), b AS (SELECT outcome, count(*) AS n2 FROM f WHERE category = 2 GROUP BY 1)
SELECT outcome, n1, n2, CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN 'shared' WHEN n2 IS NULL THEN 'first' ELSE 'second' END AS bucket FROM a FULL JOIN b USING (outcome)""",
    ),
    "join_evidence_chain": with_tables("affects", "studies", then="SELECT pathology, intervention, outcome, count(*) AS n_findings, round(min(p_value), 6) AS least_p FROM affects JOIN studies ON source_paper_id = paper_id WHERE is_significant GROUP BY 1, 2, 3 HAVING count(*) >= 2"),
    "join_descendant_evidence": with_tables("affects", "intervention", "pathology", then="SELECT region_key, outcome, count(*) AS n_findings, count(*) FILTER (WHERE is_significant) AS n_significant FROM affects JOIN intervention USING (intervention) JOIN pathology ON category = pathology_key WHERE outcome LIKE '%AN%' GROUP BY 1, 2"),
    "join_shared_entities": with_tables(
        "paper", "investigates",
        then=""", c AS (SELECT owner, count(*) AS n_papers FROM paper GROUP BY 1), p AS (SELECT owner, intervention, count(*) AS n FROM paper JOIN investigates USING (paper_id) GROUP BY 1, 2)
SELECT owner, n_papers, count(*) AS n_union, count(*) FILTER (WHERE n = n_papers) AS n_common FROM p JOIN c USING (owner) WHERE n_papers >= 3 GROUP BY 1, 2""",
    ),
    "join_document_list": with_tables(
        "paper", "affects",
        then=""", a AS (SELECT source_paper_id, count(*) AS n, count(*) FILTER (WHERE is_significant) AS s FROM affects GROUP BY 1)
SELECT sub_domain, year, count(*) AS n_papers, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chunks, CAST(coalesce(sum(s), 0) AS BIGINT) AS n_tier1 FROM paper LEFT JOIN a ON paper_id = source_paper_id GROUP BY 1, 2""",
    ),
    "join_paper_relations": with_tables(
        "paper",
        then=""", o AS (SELECT a.paper_id, b.paper_id AS other FROM paper a JOIN paper b ON a.owner = b.owner AND a.year + 1 = b.year), u AS (SELECT paper_id, other, 'out' AS direction FROM o UNION SELECT other, paper_id, 'in' FROM o)
SELECT paper_id, count(*) FILTER (WHERE direction = 'out') AS n_out, count(*) FILTER (WHERE direction = 'in') AS n_in FROM u GROUP BY 1""",
    ),
    "join_citation_match": f"""WITH o AS (SELECT *, year(o_orderdate) AS y FROM orders),
p AS (SELECT w.o_orderkey AS citing, h.o_orderkey AS cited, round(CASE WHEN w.y = h.y THEN {D(0.4)} ELSE {D(0.2)} END + CASE WHEN w.o_orderpriority = h.o_orderpriority THEN {D(0.6)} ELSE {D(0)} END, 4) AS confidence
  FROM o w JOIN o h ON w.o_custkey = h.o_custkey AND abs(w.y - h.y) <= 1 WHERE w.o_orderstatus = 'P' AND h.o_orderstatus <> 'P'),
r AS (SELECT *, row_number() OVER (PARTITION BY citing ORDER BY confidence DESC, cited) AS rn FROM p) SELECT citing, cited, confidence FROM r WHERE rn = 1""",
    "agg_outcomes": with_tables("affects", then="SELECT intervention, outcome, count(DISTINCT source_paper_id) AS study_count, round(avg(CASE WHEN rate > 0 THEN rate * 100 END), 4) AS mean_rate, max(effect) AS largest FROM affects GROUP BY 1, 2"),
    "agg_topic_clusters": with_tables(
        "paper",
        then=""", r AS (SELECT *, row_number() OVER (PARTITION BY sub_domain ORDER BY year DESC, paper_id) AS rn FROM paper)
SELECT sub_domain, count(*) AS n_papers, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 10) AS newest FROM r GROUP BY 1""",
    ),
    "agg_graph_stats": with_tables(
        "investigates", "is_a",
        then="""SELECT 'paper' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'intervention', count(*) FROM supplier UNION ALL SELECT 'pathology', count(*) FROM nation
UNION ALL SELECT 'affects', count(*) FROM lineitem UNION ALL SELECT 'investigates', count(*) FROM investigates UNION ALL SELECT 'is_a', count(*) FROM is_a""",
    ),
    "agg_import_statistics": with_tables("paper", then="SELECT year, count(*) FILTER (WHERE status = 'F') AS n_f, count(*) FILTER (WHERE status = 'O') AS n_o, count(*) FILTER (WHERE status = 'P') AS n_p, count(*) FILTER (WHERE status IS NULL) AS n_unknown FROM paper GROUP BY 1"),
    "agg_evidence_counts": with_tables("affects", then="SELECT intervention, count(DISTINCT outcome) AS n_outcomes, count(*) AS n_findings, round(avg(p_value), 6) AS mean_p, min(p_value) AS least_p, max(p_value) AS most_p FROM affects GROUP BY 1"),
    "agg_best_evidence": with_tables(
        "paper", "studies", "investigates",
        then=f""", g AS (SELECT pathology, intervention, min({_rank5.format(7)}) AS best_rank, count(*) AS n_papers FROM investigates JOIN studies USING (paper_id) JOIN paper USING (paper_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pathology ORDER BY best_rank, n_papers DESC, intervention) AS rank FROM g) SELECT * FROM r WHERE rank <= 5""",
    ),
    "agg_recommendation": with_tables(
        "affects",
        then=f""", g AS (SELECT intervention, outcome, count(*) AS evidence_count, avg(p_value) AS p, count(*) FILTER (WHERE is_significant) AS n_significant FROM affects GROUP BY 1, 2)
SELECT intervention, outcome, evidence_count, round(p, 6) AS mean_p, n_significant, CASE WHEN n_significant >= 60 AND p < {D(0.04)} THEN 'recommended' WHEN n_significant >= 50 THEN 'consider' ELSE 'insufficient' END AS recommendation FROM g""",
    ),
    "agg_usage_cost": f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, count(*) AS n_calls, CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS n_recent, round(sum(value) * {D(0.8)} / 1000 + sum(k) * {D(4.0)} / 1000, 6) AS cost FROM e GROUP BY 1""",
    "agg_reasoning_confidence": with_tables(
        "evidence",
        then=f""", w AS (SELECT *, {lv.case_sql("evidence_level", lv.REASONER, 0.25)} AS w FROM evidence),
r AS (SELECT *, row_number() OVER (PARTITION BY outcome, intervention ORDER BY w DESC, p_value, source_paper_id, line) AS rn FROM w),
g AS (SELECT outcome, intervention, avg(w) AS m, count(DISTINCT direction) AS kinds FROM r WHERE rn <= 5 GROUP BY 1, 2)
SELECT outcome, intervention, round(least({D(1)}, m * CASE kinds WHEN 1 THEN {D(1.2)} WHEN 2 THEN {D(1)} ELSE {D(0.8)} END), 6) AS confidence FROM g""",
    ),
    "agg_level_distribution": with_tables("evidence", then="SELECT evidence_level, direction, count(*) AS n FROM evidence GROUP BY 1, 2"),
}
