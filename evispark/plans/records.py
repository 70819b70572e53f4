"""Queries over paper records, reported values, sections and small upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.api import EvidenceGraph
from evispark.functions import classify, identifiers, numeric
from evispark.operators import chunk, maintain, normalize
from evispark.plans import hierarchy as hierarchy_plans
from evispark.plans.concepts import _list_sql, _pick, _pick_sql
from evispark.plans.network import CITES, cites
from evispark.sources import files
from evispark.sources import tables as t
from evispark.sources.tables import with_tables

D = lambda x: f"CAST({x} AS DOUBLE)"

# Wordings from which the test tables' sections and places are made.
PARTS = (
    "Background and objective of the abstract", "Materials and methods: participants were randomised", "Results: significant findings in the outcomes", "Discussion of limitations", "In summary we conclude",
    "no word of any part", "Methods and results and methods", "Introduction: the aim, the rationale",
)
DOMAINS = ("lumbar stenosis and disc herniation", "adult scoliosis deformity", "burst fracture after injury", "metastatic tumour of the spine", "an animal model in vitro", "nothing of these", "fracture in stenosis")
PLACES = ("lumbar spine", "C5", "T10 level", "sacral bone", "hip", "L5-S1", " iliac crest ", "SI JOINT", "a+b (c) [d]: e*f?")
REPORTED = ("improved", "n/a", "worsened", "", "unchanged")


def significant_facts(s, d):
    return t.affects(s, d).filter(numeric.significant(F.col("p_value"), 0.03)).groupBy("direction").agg(F.count("*").alias("n"), F.round(F.max("p_value"), 6).alias("greatest_p"))


def reported(s, d):
    li = t.table(s, d, "lineitem")
    some = lambda column, n, k: F.when(F.col("l_orderkey") % n != k, F.col(column))
    got = numeric.reported_direction(_pick(REPORTED, F.col("l_orderkey")), some("l_quantity", 3, 0), some("l_discount", 4, 1), some("l_tax", 5, 2), some("l_discount", 2, 0), F.col("l_tax"))
    return li.groupBy("l_linenumber", got.alias("direction")).agg(F.count("*").alias("n"))


def sections(s, d):
    p = t.table(s, d, "part")
    x = classify.section(_pick(PARTS, F.col("p_size")), F.col("p_partkey") % 10 / 10.0)
    return p.select("p_partkey", x.alias("x")).select("p_partkey", "x.section", "x.tier", "x.confidence")


def sub_domains(s, d):
    x = classify.best(_pick(DOMAINS, F.col("p_partkey") + F.col("p_size")), classify.SUB_DOMAINS, "Unknown")
    return t.table(s, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.label", "x.confidence")


def place_names(s, d):
    x = _pick(PLACES, F.col("p_partkey"))
    return t.table(s, d, "part").select("p_partkey", identifiers.region(x).alias("region"), identifiers.entity_name(x).alias("name"), identifiers.lucene_escape(x).alias("escaped"))


def embedding_inputs(s, d):
    return t.table(s, d, "documents").select("doc_id", F.sha2(identifiers.embedding_input(F.col("text"), 2000), 256).alias("input_key"))


def structured_abstracts(s, d):
    text = F.concat(F.lit("BACKGROUND: about "), "p_name", F.lit(". METHODS: "), F.col("p_size").cast("string"), F.lit(" patients. RESULTS: fine"))
    p = t.table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 5 == 0, F.lit("one RESULTS: label only")).otherwise(text).alias("text"))
    return chunk.explode_text(p, chunk.structured_abstract).select("doc_id", "chunk_index", "section", "content")


def changed_relations(s, d):
    """Relations of odd sources deleted, and those of every third target given full confidence."""
    edges = cites(s, d)
    kept = maintain.delete(edges, edges.filter("source % 2 = 1"), ["source", "target"])
    new = kept.filter("target % 3 = 0").select("source", "target", F.lit(1.0).alias("confidence"))
    return maintain.upsert(kept, new, ["source", "target"]).groupBy("context").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("confidence"))


def _records(s, d):
    """Orders as paper records: interventions, pathologies and outcomes in arrays."""
    a = t.affects(s, d)
    outcome = F.struct(
        F.col("outcome").alias("name"), F.col("intervention").cast("string").alias("intervention"), F.col("effect").cast("string").alias("value"), F.lit(None).cast("string").alias("value_control"),
        "p_value", F.lit(None).cast("boolean").alias("is_significant"), "direction",
    )
    facts = a.groupBy(F.col("source_paper_id").alias("k")).agg(F.collect_list(outcome).alias("outcomes"), F.collect_set(F.concat(F.lit(" S"), "intervention")).alias("interventions"))
    p = t.paper(s, d).join(t.pathology(s, d), "pathology_key").join(facts, F.col("paper_id") == F.col("k"), "left")
    return p.select(
        F.when(F.col("paper_id") % 50 == 0, " ").otherwise(F.col("paper_id").cast("string")).alias("paper_id"), "year", "evidence_level", "sub_domain", "interventions",
        F.array("pathology", F.lit(" ")).alias("pathologies"), F.array().cast("array<string>").alias("anatomy_levels"), "outcomes",
    )


def record_tables(s, d):
    """Rows of each graph table that paper records give."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in files.graph_tables(_records(s, d)).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def secondary_entities(s, d):
    """Outcomes of papers as nodes, the first paper winning, with the number of their edges."""
    papers = _records(s, d).filter("outcomes IS NOT NULL").select(F.col("paper_id").alias("k"), F.transform("outcomes", lambda x: F.struct(x["name"].alias("name"))).alias("items"))
    nodes, edges = maintain.explode_items(papers, "items", "k")
    return nodes.join(edges, "name").groupBy("name").agg(F.count("*").alias("n_papers"))


def registered(s, d):
    """Aliases after the names that no stage knows are registered under themselves."""
    aliases = s.createDataFrame([("red widget", "WIDGET", 0), ("blue bolt", "BOLT", 1)], "alias string, canonical string, ord int")
    unknown = normalize.unregistered(normalize.normalize(t.table(s, d, "part").select(F.col("p_name").alias("name")), aliases))
    return normalize.register(aliases, unknown.select(F.col("name").alias("alias"), F.upper("name").alias("canonical")))


QUERIES = {
    "filter_significance": significant_facts,
    "text_reported_directions": reported,
    "text_sections": sections,
    "text_sub_domains": sub_domains,
    "text_place_names": place_names,
    "text_embedding_inputs": embedding_inputs,
    "text_structured_abstracts": structured_abstracts,
    "maintain_changed_relations": changed_relations,
    "maintain_record_tables": record_tables,
    "maintain_secondary_entities": secondary_entities,
    "maintain_register_aliases": registered,
    "hierarchy_directed": lambda s, d: EvidenceGraph(s, d).hierarchy("N1", "both"),
    "rule_by_name": lambda s, d: EvidenceGraph(s, d).infer("comparable_siblings"),
}


def _scored(rules, names) -> str:
    hits = {n: " + ".join(f"{w} * len(regexp_extract_all(lower(x), '{p}'))" for m, p, w in rules if m == n) for n in names}
    return ", ".join(f"{D('(' + v + ')')} AS s{i}" for i, v in enumerate(hits.values()))


_parts = list(dict.fromkeys(n for n, _, _ in classify.SECTIONS))
_domains = list(dict.fromkeys(n for n, _, _ in classify.SUB_DOMAINS))
_ranges = ((0.0, 0.1), (0.05, 0.25), (0.15, 0.45), (0.35, 0.75), (0.55, 0.9), (0.8, 1.0))
_mixed = ", ".join(f"{D(0.8)} * s{i} / total + {D(0.2)} * CASE WHEN spot BETWEEN {D(a)} AND {D(b)} THEN 1 ELSE 0 END AS m{i}" for i, (a, b) in enumerate(_ranges))
_some = lambda column, n, k: f"CASE WHEN l_orderkey % {n} <> {k} THEN {column} END"
_by = lambda a, b: f"CASE WHEN abs({b} - {a}) < {D(0.001)} THEN 'unchanged' WHEN {b} > {a} THEN 'improved' ELSE 'worsened' END"

ORACLE = {
    "filter_significance": with_tables("affects", then=f"SELECT direction, count(*) AS n, round(max(p_value), 6) AS greatest_p FROM affects WHERE p_value < {D(0.03)} GROUP BY 1"),
    "text_reported_directions": f"""WITH x AS (SELECT l_linenumber, {_pick_sql(REPORTED, "l_orderkey")} AS e, {_some("l_quantity", 3, 0)} AS b, {_some("l_discount", 4, 1)} AS f, {_some("l_tax", 5, 2)} AS v, {_some("l_discount", 2, 0)} AS c, l_tax AS p FROM lineitem)
SELECT l_linenumber, CASE WHEN e IN ('improved', 'worsened', 'unchanged') THEN e WHEN b IS NOT NULL AND f IS NOT NULL THEN {_by("b", "f")} WHEN v IS NOT NULL AND c IS NOT NULL THEN {_by("c", "v")} WHEN p >= {D(0.05)} THEN 'unchanged' ELSE 'unknown' END AS direction, count(*) AS n FROM x GROUP BY 1, 2""",
    "text_sections": f"""WITH a AS (SELECT p_partkey, {_pick_sql(PARTS, "p_size")} AS x, p_partkey % 10 / {D(10)} AS spot FROM part), b AS (SELECT *, {_scored(classify.SECTIONS, _parts)} FROM a),
c AS (SELECT *, greatest({" + ".join(f"s{i}" for i in range(len(_parts)))}, {D(1)}) AS total FROM b), e AS (SELECT *, {_mixed} FROM c), g AS (SELECT *, greatest({", ".join(f"m{i}" for i in range(len(_parts)))}) AS top FROM e),
h AS (SELECT p_partkey, CASE WHEN top < {D(0.3)} THEN 'other' {" ".join(f"WHEN m{i} = top THEN '{n}'" for i, n in enumerate(_parts))} END AS section, top FROM g)
SELECT p_partkey, section, CASE WHEN section IN ('abstract', 'results', 'conclusion') THEN 1 ELSE 2 END AS tier, round(top, 6) AS confidence FROM h""",
    "text_sub_domains": f"""WITH a AS (SELECT p_partkey, {_pick_sql(DOMAINS, "p_partkey + p_size")} AS x FROM part), b AS (SELECT *, {_scored(classify.SUB_DOMAINS, _domains)} FROM a),
c AS (SELECT *, greatest({", ".join(f"s{i}" for i in range(len(_domains)))}) AS top, {" + ".join(f"s{i}" for i in range(len(_domains)))} AS total FROM b)
SELECT p_partkey, CASE WHEN top = 0 THEN 'Unknown' {" ".join(f"WHEN s{i} = top THEN '{n}'" for i, n in enumerate(_domains))} END AS label, round(CASE WHEN total > 0 THEN top / total ELSE {D(0)} END, 6) AS confidence FROM c""",
    "text_place_names": f"""WITH i AS (SELECT p_partkey, CAST(p_partkey % {len(PLACES)} AS INTEGER) + 1 AS i FROM part)
SELECT p_partkey, nullif({_list_sql(("lumbar", "cervical", "thoracic", "sacral", "", "lumbar", "", "", ""))}[i], '') AS region, {_list_sql(("Lumbar spine", "C5", "T10 level", "Sacral bone", "Hip", "L5-S1", "Iliac crest", "SI JOINT", "A+b (c) [d]: e*f?"))}[i] AS name,
  {_list_sql(("lumbar spine", "C5", "T10 level", "sacral bone", "hip", "L5\\-S1", " iliac crest ", "SI JOINT", "a\\+b \\(c\\) \\[d\\]\\: e\\*f\\?"))}[i] AS escaped FROM i""",
    "text_embedding_inputs": "SELECT doc_id, sha256(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 2000)) AS input_key FROM documents",
    "text_structured_abstracts": """WITH p AS (SELECT * FROM part WHERE p_size % 5 <> 0) SELECT p_partkey AS doc_id, 0 AS chunk_index, 'background' AS section, 'about ' || p_name || '.' AS content FROM p
UNION ALL SELECT p_partkey, 1, 'methods', p_size || ' patients.' FROM p UNION ALL SELECT p_partkey, 2, 'results', 'fine' FROM p""",
    "maintain_changed_relations": f"WITH {CITES} SELECT context, count(*) AS n, round(sum(CASE WHEN target % 3 = 0 THEN 1 ELSE confidence END), 3) AS confidence FROM cites WHERE source % 2 = 0 GROUP BY 1",
    "maintain_record_tables": with_tables(
        "paper", "affects", "investigates",
        then="""SELECT 'paper' AS kind, count(*) AS n FROM paper WHERE paper_id % 50 <> 0 UNION ALL SELECT 'investigates', count(*) FROM investigates WHERE paper_id % 50 <> 0
UNION ALL SELECT 'studies', count(*) FROM paper WHERE paper_id % 50 <> 0 UNION ALL SELECT 'involves', 0 UNION ALL SELECT 'affects', count(*) FROM affects WHERE source_paper_id % 50 <> 0""",
    ),
    "maintain_secondary_entities": with_tables("affects", then="SELECT outcome AS name, count(DISTINCT CASE WHEN source_paper_id % 50 = 0 THEN -1 ELSE source_paper_id END) AS n_papers FROM affects GROUP BY 1"),
    "maintain_register_aliases": """SELECT 'red widget' AS alias, 'WIDGET' AS canonical, 0 AS ord UNION ALL SELECT 'blue bolt', 'BOLT', 1
UNION ALL SELECT DISTINCT lower(p_name), upper(p_name), 2 FROM part WHERE p_name NOT IN ('red widget', 'blue bolt')""",
    "rule_by_name": hierarchy_plans.ORACLE["rule_comparable_siblings"],
    "hierarchy_directed": with_tables("up", then="SELECT ancestor AS name, min(distance) AS distance, 'up' AS side FROM up WHERE node = 'N1' AND distance <= 3 GROUP BY 1 UNION ALL SELECT node, min(distance), 'down' FROM up WHERE ancestor = 'N1' AND distance <= 3 GROUP BY 1"),
}
