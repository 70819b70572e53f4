"""Text function, normalisation, extraction, maintenance and cache queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import classify, identifiers, numeric, references
from evispark.operators import cache, chunk, extract, maintain, normalize, search
from evispark.sources import tables as t
from evispark.sources.tables import with_tables

D = lambda x: f"CAST({x} AS DOUBLE)"

# Common words by language. Fixed values.
COMMON = {"en": "the|and|of|that", "fr": "les|des|que|pour", "de": "der|die|und|nicht", "es": "los|las|que|para"}
DESIGN_TEXT = {"F": "Retrospective cohort of patients", "O": "A non-randomised comparison", "P": "Randomized controlled trial"}
ALIASES = [("small ring", "RING-S"), ("ring small", "RING-X"), ("red widget", "WIDGET"), ("blue bolt", "BOLT"), ("large gear", "GEAR"), ("green gear", "GEAR"), ("widget", "WIDGET")]


def page_identifiers(s, d):
    p = t.table(s, d, "pages")
    return p.select("page_id", identifiers.host(F.col("url")).alias("host"), identifiers.document_kind(F.col("url")).alias("kind"), identifiers.title_of(F.col("html")).alias("title"))


def page_text(s, d):
    plain = identifiers.visible_text(F.col("html"))
    return t.table(s, d, "pages").select("page_id", F.length(plain).cast("long").alias("n_chars"), F.sha2(plain, 256).alias("text_key"))


def document_identifiers(s, d):
    x = F.col("text")
    return t.table(s, d, "documents").select("doc_id", identifiers.year(x).alias("year"), F.size(identifiers.emails(x)).alias("n_emails"), numeric.number_in(x).alias("first_number"), identifiers.doi(x).alias("doi"))


def language_votes(s, d):
    rules = [(lang, rf"(?:^|[^a-z])(?:{w})(?:[^a-z]|$)", 1.0) for lang, w in COMMON.items()]
    best = classify.best(F.col("text"), rules, "unknown")
    return t.table(s, d, "documents").select("doc_id", best.alias("x")).select("doc_id", "x.label", "x.confidence")


def study_designs(s, d):
    o = t.table(s, d, "orders").withColumn("text", t.choose("o_orderstatus", DESIGN_TEXT))
    g = o.withColumn("design", classify.study_design(F.col("text"))).withColumn("level", classify.level_of_design(F.col("design")))
    return g.groupBy("design", "level").agg(F.count("*").alias("n"))


def directions(s, d):
    li = t.table(s, d, "lineitem")
    got = numeric.change_direction(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_linestatus") == "O")
    return li.groupBy("l_linestatus", got.alias("direction")).agg(F.count("*").alias("n"))


def comparisons(s, d):
    p = t.table(s, d, "part")
    x = numeric.comparison(F.col("p_retailprice"), F.col("p_size") * 30.0, F.col("p_size") > 20)
    return p.select("p_partkey", x.alias("x")).select("p_partkey", "x.difference", "x.percent", "x.favours", "x.confidence")


def segment_rows(s, d):
    text = F.concat(F.lit("L"), (F.col("p_size") % 4 + 1).cast("string"), F.lit("-"), (F.col("p_size") % 5 + 2).cast("string"))
    return t.table(s, d, "part").select(F.explode(identifiers.segments(text)).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))


def title_pairs(s, d):
    """All pairs of classes of equal titles whose sets of words agree to a half or more."""
    words = t.table(s, d, "part").select("p_partkey", F.explode(normalize.words(F.col("p_name"))).alias("word"))
    return search.similarity_join(words, "p_partkey", "word", 0.5)


def _aliases(s):
    return s.createDataFrame([(a, c, i) for i, (a, c) in enumerate(ALIASES)], "alias string, canonical string, ord int")


def normalized(s, d):
    names = t.table(s, d, "part").select(F.col("p_name").alias("name"))
    found = normalize.normalize(names, _aliases(s))
    return found.filter("method IN ('exact', 'token')").select("name", "canonical", "method", F.round("confidence", 6).alias("confidence"))


def fuzzy(s, d):
    names = t.table(s, d, "part").select(F.concat(F.col("p_name"), F.lit("s")).alias("name"))
    return normalize.normalize(names, _aliases(s)).select("name", "canonical", "method", F.round("confidence", 6).alias("confidence"))


def alias_mentions(s, d):
    words = s.createDataFrame([("the", "EN"), ("of the", "EN"), ("que", "ROMANCE"), ("der", "DE")], "alias string, canonical string")
    return normalize.mentions(t.table(s, d, "documents"), words)


def chunks(s, d):
    return chunk.explode_text(t.table(s, d, "documents"), chunk.recursive_chunks).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("content")).alias("longest"))


def tiered_chunks(s, d):
    return chunk.explode_text(t.table(s, d, "documents"), chunk.tiered_chunks).groupBy("doc_id", "section").agg(F.count("*").alias("n_chunks"))


def paragraph_chunks(s, d):
    return chunk.explode_text(t.table(s, d, "documents"), chunk.paragraph_chunks).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("content")).alias("longest"))


def candidate_names(s, d):
    return normalize.candidates(t.table(s, d, "part").select(F.col("p_name").alias("name")), _aliases(s), 3)


def section_chunks(s, d):
    return chunk.explode_text(t.table(s, d, "documents"), chunk.section_chunks).groupBy("doc_id", "section").agg(F.count("*").alias("n_chunks"))


def _abstracts(s, d):
    """A short abstract for each part, with statistics, citations and study elements made from its columns."""
    digit = lambda c: (F.col("p_size") % c).cast("string")
    text = F.concat(
        F.lit("We studied "), (F.col("p_size") + 10).cast("string"), F.lit(" patients with "), "p_name", F.lit(" pain who underwent "), "p_name", F.lit(" fusion versus plain rods in clinics. "),
        F.lit("Primary outcome was walking score. The HR "), F.floor(F.col("p_size") % 20 / 10).cast("string"), F.lit("."), digit(10), F.lit(" (95% CI 0."), digit(9), F.lit("-1."), digit(7),
        F.lit("), p = 0.0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("; it failed in "), "p_size", F.lit(".5%. As Author"), "p_size", F.lit(" et al. ("), (F.col("p_size") + 1960).cast("string"),
        F.lit(") said [3, "), "p_size", F.lit("], see (Doe and Roe, 1999)."),
    )
    return t.table(s, d, "part").select("p_partkey", text.alias("text"))


def statistics(s, d):
    found = extract.extract(_abstracts(s, d), extract.statistics, extract.STATISTICS, "p_partkey")
    return found.select("p_partkey", "kind", "value", "low", "high", "p_value", "direction", "significant")


def citation_markers(s, d):
    return extract.extract(_abstracts(s, d), extract.citations, extract.CITATIONS, "p_partkey").select("p_partkey", "style", "marker", "author", "year")


def study_elements(s, d):
    return extract.extract(_abstracts(s, d), extract.study_elements, extract.ELEMENTS, "p_partkey").select("p_partkey", "kind", "phrase")


def formatted(s, d):
    o, c = t.table(s, d, "orders"), t.table(s, d, "customer")
    b = o.join(c, o.o_custkey == c.c_custkey)
    key = F.col("o_orderkey").cast("string")
    pages = F.concat((F.col("o_orderkey") + 1000).cast("string"), F.lit("-"), (F.col("o_orderkey") + 1011).cast("string"))
    args = (F.array(F.concat(F.lit("Ann Bea "), F.col("c_name"))), F.concat(F.lit("Order "), key), F.col("c_mktsegment"), F.year("o_orderdate"), F.col("o_custkey"), pages)
    return b.select("o_orderkey", references.vancouver(*args).alias("vancouver"), references.apa(*args).alias("apa"))


def upserted(s, d):
    c = t.table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 5 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 10 == 0, 100000).otherwise(0)).alias("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "renamed").alias("c_name"))
    return maintain.upsert(c, new, ["c_custkey"])


def first_and_last(s, d):
    o = t.table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    last = maintain.last_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    first = maintain.first_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    return first.join(last, "o_custkey")


def merged(s, d):
    """Brands by name, names that differ in case being one: that with a code (an even size) first, then that of most parts."""
    p = t.table(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), "p_brand", "p_size")
    nodes = p.groupBy("name").agg(F.max((F.col("p_size") % 2 == 0).cast("int")).alias("coded"), F.count("*").alias("degree"))
    mapping = maintain.case_duplicates(nodes, "name", [-F.col("coded"), -F.col("degree")])
    edges = p.select(F.col("name"), F.col("p_brand").alias("target"))
    return maintain.redirect(edges, mapping, ["name"]).groupBy("name").agg(F.count("*").alias("n_targets"))


def deleted(s, d):
    gone = t.table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    out = maintain.delete_cascade({"paper": (t.table(s, d, "orders"), "o_orderkey"), "affects": (t.table(s, d, "lineitem"), "l_orderkey")}, gone, "k")
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in out.items()]
    return rows[0].unionByName(rows[1])


def backfilled(s, d):
    return maintain.backfill_treats(t.investigates(s, d), t.studies(s, d))


def covered(s, d):
    c = t.table(s, d, "customer").withColumn("code", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    sup = t.table(s, d, "supplier").withColumn("code", F.when(F.col("s_acctbal") > 0, F.lit("x")).otherwise(""))
    return maintain.coverage({"customer": c, "supplier": sup}, "code")


def violations(s, d):
    return maintain.key_violations(t.affects(s, d), ["intervention", "outcome", "source_paper_id"]).select("intervention", "outcome", "source_paper_id", F.col("count").alias("n"))


def cache_hits(s, d):
    log = cache.hit_rates(t.table(s, d, "events"), "user_id", "ts", 6 * 3600)
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hits"))


QUERIES = {
    "text_page_identifiers": page_identifiers,
    "text_page_visible": page_text,
    "text_document_identifiers": document_identifiers,
    "text_language_votes": language_votes,
    "text_study_designs": study_designs,
    "text_directions": directions,
    "text_comparisons": comparisons,
    "text_segments": segment_rows,
    "text_title_similarity": title_pairs,
    "text_normalize": normalized,
    "text_normalize_fuzzy": fuzzy,
    "text_mentions": alias_mentions,
    "text_chunks": chunks,
    "text_section_chunks": section_chunks,
    "text_tiered_chunks": tiered_chunks,
    "text_paragraph_chunks": paragraph_chunks,
    "text_normalize_candidates": candidate_names,
    "text_statistics": statistics,
    "text_citations": citation_markers,
    "text_study_elements": study_elements,
    "text_references": formatted,
    "maintain_upsert": upserted,
    "maintain_first_last": first_and_last,
    "maintain_merge_case": merged,
    "maintain_delete_cascade": deleted,
    "maintain_backfill": backfilled,
    "maintain_coverage": covered,
    "maintain_key_violations": violations,
    "cache_hit_rates": cache_hits,
}

_host = "regexp_extract(lower(url), '^[a-z]+://(?:www\\.)?([^/:?#]+)', 1)"
_kinds = " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{k}'" for k, p in identifiers.URL_KINDS)
_plain = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_hits = lambda w: f"len(regexp_extract_all(lower(text), '(?:^|[^a-z])(?:{w})(?:[^a-z]|$)'))"
_votes = ", ".join(f"{D(_hits(w))} AS {lang}" for lang, w in COMMON.items())
_words = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> ''))"
_case = " ".join(f"WHEN {x} = top THEN '{x}'" for x in COMMON)

ORACLE = {
    "text_page_identifiers": f"SELECT page_id, {_host} AS host, CASE {_kinds} ELSE 'webpage' END AS kind, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages",
    "text_page_visible": f"SELECT page_id, length({_plain}) AS n_chars, sha256({_plain}) AS text_key FROM pages",
    "text_document_identifiers": """SELECT doc_id, TRY_CAST(regexp_extract(text, '\\b((?:19|20)\\d{2})\\b', 1) AS INTEGER) AS year, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS INTEGER) AS n_emails,
  TRY_CAST(regexp_extract(text, '([-+]?\\d*\\.?\\d+)', 1) AS DOUBLE) AS first_number, nullif(regexp_replace(regexp_extract(lower(text), '(10\\.\\d{4,9}/[-._;()/:a-z0-9]+)', 1), '[.,;)]+$', ''), '') AS doi FROM documents""",
    "text_language_votes": f"""WITH v AS (SELECT doc_id, {_votes} FROM documents), w AS (SELECT *, greatest({", ".join(COMMON)}) AS top, {" + ".join(COMMON)} AS total FROM v)
SELECT doc_id, CASE WHEN top = 0 THEN 'unknown' {_case} END AS label, round(CASE WHEN total > 0 THEN top / total ELSE {D(0)} END, 6) AS confidence FROM w""",
    "text_study_designs": "SELECT CASE o_orderstatus WHEN 'F' THEN 'retrospective-cohort' WHEN 'O' THEN 'other' ELSE 'RCT' END AS design, CASE o_orderstatus WHEN 'F' THEN '3' WHEN 'O' THEN '5' ELSE '1b' END AS level, count(*) AS n FROM orders GROUP BY 1, 2",
    "text_directions": f"""WITH x AS (SELECT l_linestatus, l_quantity AS b, l_extendedprice / 1000 AS f FROM lineitem)
SELECT l_linestatus, CASE WHEN b = 0 THEN 'unknown' WHEN abs((f - b) / abs(b)) < {D(0.05)} THEN 'unchanged' WHEN (f > b) = (l_linestatus = 'O') THEN 'improved' ELSE 'worsened' END AS direction, count(*) AS n FROM x GROUP BY 1, 2""",
    "text_comparisons": f"""WITH x AS (SELECT p_partkey, p_size, p_retailprice AS i, p_size * {D(30)} AS c FROM part)
SELECT p_partkey, round(i - c, 6) AS difference, round((i - c) / abs(c) * 100, 6) AS percent, CASE WHEN i = c THEN 'neither' WHEN (i > c) = (p_size > 20) THEN 'intervention' ELSE 'control' END AS favours,
  round(least(abs((i - c) / abs(c) * 100) / 10, {D(1)}), 6) AS confidence FROM x""",
    "text_segments": """WITH x AS (SELECT p_size % 4 + 1 AS a, p_size % 5 + 2 AS b FROM part),
r AS (SELECT a, b, unnest(range(a, b)) AS i FROM x WHERE a < b), u AS (SELECT 'L' || i || '-' || (i + 1) AS segment FROM r UNION ALL SELECT 'L' || a || '-' || b FROM x WHERE a >= b)
SELECT segment, count(*) AS n FROM u GROUP BY 1""",
    "text_title_similarity": f"""WITH s AS (SELECT p_partkey, list_sort({_words("p_name")}) AS items FROM part), c AS (SELECT items, min(p_partkey) AS id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS first, b.id AS second, a.n AS n_first, b.n AS n_second, len(list_intersect(a.items, b.items)) / {D("len(list_distinct(list_concat(a.items, b.items)))")} AS similarity FROM c a JOIN c b ON a.id < b.id)
SELECT first, second, n_first, n_second, round(similarity, 6) AS similarity FROM p WHERE similarity >= {D(0.5)}""",
    "text_normalize": f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), a(alias, canonical, ord) AS (VALUES {", ".join(f"('{a}', '{c}', {i})" for i, (a, c) in enumerate(ALIASES))}),
e AS (SELECT name, canonical, ord, row_number() OVER (PARTITION BY name ORDER BY ord) AS rn FROM n JOIN a ON lower(name) = alias),
w AS (SELECT name, canonical, ord, CAST(len(list_intersect({_words("name")}, {_words("alias")})) AS DOUBLE) / greatest(len({_words("name")}), len({_words("alias")})) AS share FROM n, a WHERE name NOT IN (SELECT name FROM e)),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY share DESC, ord) AS rn FROM w WHERE share >= {D(0.8)})
SELECT name, canonical, 'exact' AS method, {D(1)} AS confidence FROM e WHERE rn = 1 UNION ALL SELECT name, canonical, 'token', round({D(0.9)} + {D(0.1)} * share, 6) FROM k WHERE rn = 1""",
    "text_mentions": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS a, unnest(list_concat(w[2:], [''])) AS b FROM w),
m AS (SELECT doc_id, 'EN' AS canonical FROM e WHERE a = 'the' UNION ALL SELECT doc_id, 'EN' FROM e WHERE a = 'of' AND b = 'the' UNION ALL SELECT doc_id, 'ROMANCE' FROM e WHERE a = 'que' UNION ALL SELECT doc_id, 'DE' FROM e WHERE a = 'der')
SELECT doc_id, canonical, count(*) AS n_mentions FROM m GROUP BY 1, 2""",
    "text_statistics": f"""WITH x AS (SELECT p_partkey, p_size, p_size % 20 / {D(10)} AS v, p_size % 9 / {D(10)} AS low, 1 + p_size % 7 / {D(10)} AS high, (p_partkey % 9 + 1) / {D(100)} AS p FROM part)
SELECT p_partkey, 'hazard_ratio' AS kind, v AS value, low, high, p AS p_value, CASE WHEN v < 1 THEN 'decreased' WHEN v > 1 THEN 'increased' ELSE 'neutral' END AS direction, p < {D(0.05)} AS significant FROM x
UNION ALL SELECT p_partkey, 'percentage', p_size + {D(0.5)}, NULL, NULL, p, NULL, p < {D(0.05)} FROM x""",
    "text_citations": """SELECT p_partkey, 'narrative' AS style, 'Author' || p_size || ' et al. (' || (p_size + 1960) || ')' AS marker, 'Author' || p_size AS author, CAST(p_size + 1960 AS INTEGER) AS year FROM part
UNION ALL SELECT p_partkey, 'number', '[3, ' || p_size || ']', NULL, NULL FROM part UNION ALL SELECT p_partkey, 'paren', '(Doe and Roe, 1999)', 'Doe', 1999 FROM part""",
    "text_study_elements": """SELECT p_partkey, 'population' AS kind, (p_size + 10) || ' patients with ' || p_name || ' pain' AS phrase FROM part UNION ALL SELECT p_partkey, 'intervention', p_name || ' fusion' FROM part
UNION ALL SELECT p_partkey, 'comparison', 'plain rods' FROM part UNION ALL SELECT p_partkey, 'outcome', 'walking score' FROM part""",
    "text_references": """WITH b AS (SELECT *, 'Order ' || o_orderkey AS title, c_name || ' AB' AS author, CAST(o_orderkey + 1000 AS VARCHAR) AS p, CAST(o_orderkey + 1011 AS VARCHAR) AS q FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, CASE WHEN length(p) <> length(q) THEN 0 WHEN p[1:5] = q[1:5] AND length(p) > 5 THEN 5 WHEN p[1:4] = q[1:4] AND length(p) > 4 THEN 4 WHEN p[1:3] = q[1:3] THEN 3 WHEN p[1:2] = q[1:2] THEN 2 WHEN p[1:1] = q[1:1] THEN 1 ELSE 0 END AS same FROM b)
SELECT o_orderkey, author || '. ' || title || '. ' || c_mktsegment || '. ' || year(o_orderdate) || ';' || o_custkey || ':' || p || '-' || substr(q, same + 1) || '.' AS vancouver,
  author || ' (' || year(o_orderdate) || '). ' || title || '. ' || c_mktsegment || ', ' || o_custkey || ', ' || p || '-' || q || '.' AS apa FROM k""",
    "maintain_upsert": """WITH n AS (SELECT c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 100000 ELSE 0 END AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' END AS new_name FROM customer WHERE c_custkey % 5 = 0)
SELECT c_custkey, coalesce(new_name, c_name) AS c_name, c_acctbal FROM customer FULL JOIN n USING (c_custkey)""",
    "maintain_first_last": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (WHERE a = 1) AS first_order, max(o_orderkey) FILTER (WHERE z = 1) AS last_order FROM r GROUP BY 1""",
    "maintain_merge_case": """WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_brand, p_size FROM part),
n AS (SELECT name, max(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS coded, count(*) AS degree FROM p GROUP BY 1),
c AS (SELECT name, lower(name) AS low, row_number() OVER (PARTITION BY lower(name) ORDER BY coded DESC, degree DESC, name) AS place FROM n)
SELECT c.name, count(DISTINCT p_brand) AS n_targets FROM p JOIN c ON lower(p.name) = low AND place = 1 GROUP BY 1""",
    "maintain_delete_cascade": "SELECT 'paper' AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'affects', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "maintain_backfill": with_tables("investigates", "studies", then="SELECT intervention, pathology, count(*) AS paper_count, min(paper_id) AS first_paper FROM investigates JOIN studies USING (paper_id) GROUP BY 1, 2"),
    "maintain_coverage": f"""SELECT 'customer' AS label, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS mapped, round(count(*) FILTER (WHERE c_acctbal > 0) * {D(100)} / count(*), 4) AS percent FROM customer
UNION ALL SELECT 'supplier', count(*), count(*) FILTER (WHERE s_acctbal > 0), round(count(*) FILTER (WHERE s_acctbal > 0) * {D(100)} / count(*), 4) FROM supplier""",
    "maintain_key_violations": with_tables("affects", then="SELECT intervention, outcome, source_paper_id, count(*) AS n FROM affects GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "cache_hit_rates": """WITH l AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE epoch_us(ts) - epoch_us(prev) <= 21600000000) AS n_hits FROM l GROUP BY 1""",
}
