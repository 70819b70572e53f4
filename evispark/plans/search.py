"""Ranking, vector, text-search, fusion and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import levels as lv
from evispark.operators import rank as r
from evispark.operators import search as se
from evispark.sources import tables as t
from evispark.sources.tables import with_tables

D = lambda x: f"CAST({x} AS DOUBLE)"
YEAR = 2001


def _hits(s, d):
    """Search hits for the rankers: papers with scores derived from their order."""
    p = t.paper(s, d)
    return p.select(
        "paper_id", "year", "evidence_level", "sub_domain", "sample_size",
        ((F.col("paper_id") * 37) % 1000 / 1000.0).alias("semantic_score"),
        F.when(F.col("paper_id") % 3 == 0, (F.col("paper_id") * 53) % 1000 / 1000.0).alias("graph_score"),
        (F.col("paper_id") % 3 + 1).cast("int").alias("tier"),
        F.when(F.col("status") == "F", "original").when(F.col("status") == "O", "background").otherwise("other").alias("source_type"),
    )


HITS = """hits AS (SELECT paper_id, year, evidence_level, sub_domain, sample_size, (paper_id * 37) % 1000 / CAST(1000 AS DOUBLE) AS semantic_score,
  CASE WHEN paper_id % 3 = 0 THEN (paper_id * 53) % 1000 / CAST(1000 AS DOUBLE) END AS graph_score, CAST(paper_id % 3 + 1 AS INTEGER) AS tier,
  CASE status WHEN 'F' THEN 'original' WHEN 'O' THEN 'background' ELSE 'other' END AS source_type FROM paper)"""


def multi_factor(preset):
    return lambda s, d: r.multi_factor(_hits(s, d), YEAR, preset).select("paper_id", "final_score")


def _multi_sql(preset):
    w = [x / sum(r.PRESETS[preset]) for x in r.PRESETS[preset]]
    return with_tables(
        "paper",
        then=f""", {HITS} SELECT paper_id, round({D(0)} + {D(w[0])} * least({D(1)}, greatest({D(0)}, CASE WHEN graph_score IS NOT NULL THEN {D(0.7)} * semantic_score + {D(0.3)} * graph_score ELSE semantic_score END))
 + {D(w[1])} * {lv.case_sql("evidence_level", lv.MULTI_FACTOR, 0.2)} + {D(w[2])} * CASE WHEN {YEAR} - year <= 0 THEN {D(1)} ELSE greatest({D(0.1)}, pow({D(0.5)}, ({YEAR} - year) / {D(5)})) END
 + {D(w[3])} * CASE tier WHEN 1 THEN {D(1)} WHEN 2 THEN {D(0.6)} ELSE {D(0.2)} END + {D(w[4])} * CASE source_type WHEN 'original' THEN {D(1)} WHEN 'background' THEN {D(0.4)} ELSE {D(0.7)} END, 6) AS final_score FROM hits""",
    )


def authority(s, d):
    h = _hits(s, d)
    score = 0.4 * F.col("semantic_score") * (0.5 + 0.5 * lv.weight("evidence_level", lv.HYBRID, 0.1)) + 0.3 * r.authority(h, YEAR) + 0.3 * F.coalesce("graph_score", F.lit(0.0))
    return h.select("paper_id", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


def graph_scored(s, d):
    e = t.evidence(s, d).groupBy("intervention", "outcome", "direction", "evidence_level").agg(F.count("*").alias("n"))
    return e.withColumn("score", F.round(r.graph_score(F.col("direction"), "evidence_level"), 6)).groupBy("intervention", "outcome").agg(F.round(F.sum(F.col("score") * F.col("n")), 4).alias("total"), F.max("score").alias("best"))


def normalised(s, d):
    return r.min_max(t.affects(s, d).groupBy("intervention").agg(F.sum("effect").alias("total")), "total", "scaled").select("intervention", F.round("scaled", 6).alias("scaled"))


def adaptive(s, d):
    h = _hits(s, d)
    g = h.filter("graph_score IS NOT NULL").select("paper_id", "graph_score")
    v = h.filter("semantic_score >= 0.3").select("paper_id", F.col("semantic_score").alias("vector_score"))
    return r.merge_adaptive(g, v, "paper_id", "evidence")


def fused(s, d):
    h = _hits(s, d)
    lists = {
        "vector": (h.select("sub_domain", "paper_id", F.col("semantic_score").alias("score")), 0.7),
        "graph": (h.filter("graph_score IS NOT NULL").select("sub_domain", "paper_id", F.col("graph_score").alias("score")), 0.3),
    }
    return r.reciprocal_rank_fusion(lists, "paper_id", [F.desc("score"), F.asc("paper_id")], ("sub_domain",))


def best_of(s, d):
    h = _hits(s, d)
    a = h.select("paper_id", (F.col("semantic_score") * 0.9).alias("score"), F.lit("vector").alias("kind"))
    b = h.filter("graph_score IS NOT NULL").select("paper_id", F.col("graph_score").alias("score"), F.lit("graph").alias("kind"))
    return r.keep_best([a, b], "paper_id", "score", ["kind"]).withColumn("score", F.round("score", 6))


def tier_fill(s, d):
    h = _hits(s, d).select("sub_domain", "tier", F.col("semantic_score").alias("score"), F.col("paper_id").alias("id"))
    return r.fill_tiers(h, ["sub_domain"], 25).select("sub_domain", "id", "tier", "place")


def _vectors(s, d):
    return se.with_norm(t.spread(t.table(s, d, "embeddings")))


def _queries(s, d):
    """The stated query set: every vector whose identifier is divisible by 100."""
    v = _vectors(s, d).filter(F.col("vec_id") % 100 == 0)
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("norm").alias("query_norm"), F.col("label").alias("query_label"))


def vector_top(s, d):
    return se.nearest(_vectors(s, d), _queries(s, d), 10, others=True).select("query_id", "vec_id", "similarity", "place")


def vector_filtered(s, d):
    near = se.nearest(_vectors(s, d), _queries(s, d), 30, others=True)
    kept = near.filter((se.rescaled(F.col("similarity")) >= 0.5) & (F.col("label") == F.col("query_label")))
    return kept.groupBy("query_id").agg(F.count("*").alias("n_kept"), F.max("similarity").alias("best"))


def hybrid(s, d):
    """Vector hits of documents with their quality as graph evidence."""
    near = se.nearest(_vectors(s, d), _queries(s, d), 30)
    labels = t.table(s, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    g = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.1).otherwise(0.5)
    return near.join(labels, "vec_id", "left").select("query_id", "vec_id", F.round(0.4 * g + 0.6 * se.rescaled(F.col("similarity")), 9).alias("score"))


def overlap(s, d):
    v, q = _vectors(s, d), _queries(s, d)
    half = lambda df, c: df.withColumn(c, F.slice(c, 1, 32))
    a = se.nearest(v, q, 10)
    short = se.with_norm(half(v, "embedding"))
    hq = half(q, "query").withColumn("query_norm", F.sqrt(se.dot(F.col("query"), F.col("query"))))
    return se.overlap_at_k(a, se.nearest(short, hq, 10), 10)


def cached(s, d):
    v = _vectors(s, d)
    entries = v.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("operation"), "embedding", "norm")
    probes = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("probe_id"), F.col("label").alias("operation"), "embedding", "norm")
    return se.nearest_cached(entries, probes, 0.05)


def text_search(s, d):
    return se.bm25(t.spread(t.table(s, d, "documents").select("doc_id", "text")), t.table(s, d, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text"))


def paper_overlap(s, d):
    """Papers of one owner compared by their sets of interventions and outcomes."""
    g = t.affects(s, d).groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.collect_set("intervention").alias("interventions"), F.collect_set("outcome").alias("outcomes"))
    p = g.join(t.paper(s, d).select("paper_id", "owner", F.array("sub_domain").alias("domains")), "paper_id")
    pairs = p.alias("a").join(p.alias("b"), (F.col("a.owner") == F.col("b.owner")) & (F.col("a.paper_id") < F.col("b.paper_id")))
    score = se.weighted_overlap({"domains": 0.25, "interventions": 0.3, "outcomes": 0.45})
    return pairs.select(F.col("a.paper_id").alias("first"), F.col("b.paper_id").alias("second"), F.round(score, 6).alias("similarity")).filter("similarity >= 0.5")


def similar_sets(s, d):
    """All pairs of papers (as classes of equal sets) whose intervention sets agree to 0.6 or more."""
    return se.similarity_join(t.investigates(s, d), "paper_id", "intervention", 0.6)


QUERIES = {
    "rank_multi_factor": multi_factor("balanced"),
    "rank_recent_research": multi_factor("recent_research"),
    "rank_high_evidence": multi_factor("high_evidence"),
    "rank_authority": authority,
    "rank_graph_scores": graph_scored,
    "rank_min_max": normalised,
    "rank_adaptive_merge": adaptive,
    "rank_tier_fill": tier_fill,
    "fusion_rrf": fused,
    "fusion_best_of": best_of,
    "vector_top_k": vector_top,
    "vector_post_filter": vector_filtered,
    "vector_hybrid": hybrid,
    "vector_overlap_at_k": overlap,
    "vector_semantic_cache": cached,
    "text_bm25": text_search,
    "similarity_weighted_overlap": paper_overlap,
    "similarity_join": similar_sets,
}

_cos = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
NEAR = """q AS (SELECT vec_id AS query_id, embedding AS query, label AS query_label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, query_label, vec_id, label, round({0}, 6) AS similarity FROM q, embeddings {1}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM s)"""
_near = lambda where="": NEAR.format(_cos.format("embedding", "query"), where)
_jac = lambda a, b: f"CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b})))"

ORACLE = {
    "rank_multi_factor": _multi_sql("balanced"),
    "rank_recent_research": _multi_sql("recent_research"),
    "rank_high_evidence": _multi_sql("high_evidence"),
    "rank_authority": with_tables(
        "paper",
        then=f""", {HITS}, w AS (SELECT *, {lv.case_sql("evidence_level", lv.HYBRID, 0.1)} AS w FROM hits)
SELECT paper_id, round(least({D(1)}, {D(0.4)} * semantic_score * ({D(0.5)} + {D(0.5)} * w) + {D(0.3)} * (w * CASE WHEN sample_size >= 500 THEN {D(1.2)} WHEN sample_size >= 100 THEN {D(1.1)} WHEN sample_size >= 30 THEN {D(1)} ELSE {D(0.9)} END
 * CASE WHEN {YEAR} - year <= 2 THEN {D(1.1)} WHEN {YEAR} - year <= 5 THEN {D(1)} ELSE {D(0.9)} END) + {D(0.3)} * coalesce(graph_score, {D(0)})), 6) AS score FROM w""",
    ),
    "rank_graph_scores": with_tables(
        "evidence",
        then=f""", s AS (SELECT intervention, outcome, round(least({D(1)}, {lv.case_sql("evidence_level", lv.HYBRID, 0.1)} * CASE direction WHEN 'improved' THEN {D(1.2)} WHEN 'worsened' THEN {D(0.8)} ELSE {D(0.9)} END), 6) AS score FROM evidence)
SELECT intervention, outcome, round(sum(score), 4) AS total, max(score) AS best FROM s GROUP BY 1, 2""",
    ),
    "rank_min_max": with_tables("affects", then=", g AS (SELECT intervention, sum(effect) AS total FROM affects GROUP BY 1), e AS (SELECT min(total) AS lo, max(total) AS hi FROM g) SELECT intervention, round((total - lo) / (hi - lo), 6) AS scaled FROM g, e"),
    "rank_adaptive_merge": with_tables(
        "paper",
        then=f""", {HITS}, g AS (SELECT paper_id, graph_score AS g FROM hits WHERE graph_score IS NOT NULL), v AS (SELECT paper_id, semantic_score AS v FROM hits WHERE semantic_score >= {D(0.3)}),
b AS (SELECT paper_id, coalesce(g, {D(0)}) AS g, coalesce(v, {D(0)}) AS v FROM g FULL JOIN v USING (paper_id)) SELECT paper_id, round(CASE WHEN g > 0 AND v > 0 THEN {D(0.75)} * g + {D(0.25)} * v WHEN g > 0 THEN g ELSE v END, 6) AS score FROM b""",
    ),
    "rank_tier_fill": with_tables("paper", then=f", {HITS}, p AS (SELECT sub_domain, paper_id AS id, tier, row_number() OVER (PARTITION BY sub_domain ORDER BY tier, semantic_score DESC, paper_id) AS place FROM hits) SELECT * FROM p WHERE place <= 25"),
    "fusion_rrf": with_tables(
        "paper",
        then=f""", {HITS}, k AS (SELECT sub_domain, paper_id, {D(0.7)} AS w, row_number() OVER (PARTITION BY sub_domain ORDER BY semantic_score DESC, paper_id) AS place FROM hits
UNION ALL SELECT sub_domain, paper_id, {D(0.3)}, row_number() OVER (PARTITION BY sub_domain ORDER BY graph_score DESC, paper_id) FROM hits WHERE graph_score IS NOT NULL),
u AS (SELECT sub_domain, paper_id, w / (60 + place) AS part FROM k WHERE place <= 200) SELECT sub_domain, paper_id, round(sum(part), 12) AS rrf FROM u GROUP BY 1, 2""",
    ),
    "fusion_best_of": with_tables(
        "paper",
        then=f""", {HITS}, u AS (SELECT paper_id, semantic_score * {D(0.9)} AS score, 'vector' AS kind FROM hits UNION ALL SELECT paper_id, graph_score, 'graph' FROM hits WHERE graph_score IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, kind DESC) AS rn FROM u) SELECT paper_id, round(score, 6) AS score, kind FROM o WHERE rn = 1""",
    ),
    "vector_top_k": f"WITH {_near('WHERE vec_id <> query_id')} SELECT query_id, vec_id, similarity, place FROM near WHERE place <= 10",
    "vector_post_filter": f"WITH {_near('WHERE vec_id <> query_id')} SELECT query_id, count(*) AS n_kept, max(similarity) AS best FROM near WHERE place <= 30 AND (1 + similarity) / 2 >= {D(0.5)} AND label = query_label GROUP BY 1",
    "vector_hybrid": f"WITH {_near()} SELECT query_id, vec_id, round({D(0.4)} * CASE quality WHEN 1 THEN {D(1)} WHEN 0 THEN {D(0.1)} ELSE {D(0.5)} END + {D(0.6)} * ((1 + similarity) / 2), 9) AS score FROM near LEFT JOIN labels ON doc_id = vec_id WHERE place <= 30",
    "vector_overlap_at_k": f"""WITH {_near()}, h AS (SELECT query_id, vec_id, round({_cos.format("embedding[1:32]", "query[1:32]")}, 6) AS similarity FROM q, embeddings),
hn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM h)
SELECT a.query_id, round(count(b.vec_id) / {D(10)}, 6) AS overlap FROM near a LEFT JOIN hn b ON a.query_id = b.query_id AND a.vec_id = b.vec_id AND b.place <= 10 WHERE a.place <= 10 GROUP BY 1""",
    "vector_semantic_cache": f"""WITH p AS (SELECT vec_id AS probe_id, label AS operation, embedding AS query FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT probe_id, vec_id AS entry_id, {_cos.format("embedding", "query")} AS sim FROM p JOIN embeddings ON label = operation WHERE vec_id <> probe_id),
o AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, entry_id) AS rn FROM s WHERE sim > {D(0.05)}) SELECT probe_id, entry_id, round(sim, 6) AS similarity FROM o WHERE rn = 1""",
    "text_bm25": f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS terms FROM documents),
n AS (SELECT count(*) AS n_docs, avg(len(terms)) AS mean_length FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id % 100 = 0),
e AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + {D(0.5)}) / (df + {D(0.5)})) * tf * {D(2.2)} / (tf + {D(1.2)} * ({D(0.25)} + {D(0.75)} * length / mean_length))), 6) AS score
FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2""",
    "similarity_weighted_overlap": with_tables(
        "paper", "affects",
        then=f""", g AS (SELECT source_paper_id AS paper_id, list(DISTINCT intervention) AS i, list(DISTINCT outcome) AS o FROM affects GROUP BY 1), p AS (SELECT paper_id, owner, sub_domain, i, o FROM paper JOIN g USING (paper_id)),
x AS (SELECT a.paper_id AS first, b.paper_id AS second, round({D(0.25)} * CASE WHEN a.sub_domain = b.sub_domain THEN {D(1)} ELSE {D(0)} END + {D(0.3)} * ({_jac("a.i", "b.i")}) + {D(0.45)} * ({_jac("a.o", "b.o")}), 6) AS similarity
FROM p a JOIN p b ON a.owner = b.owner AND a.paper_id < b.paper_id) SELECT * FROM x WHERE similarity >= {D(0.5)}""",
    ),
    "similarity_join": with_tables(
        "investigates",
        then=f""", s AS (SELECT paper_id, list(intervention ORDER BY intervention) AS items FROM investigates GROUP BY 1), c AS (SELECT items, min(paper_id) AS id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT id, len(items) AS size, unnest(items) AS e FROM c),
p AS (SELECT a.id AS first, b.id AS second, count(*) AS common, any_value(a.size) AS sa, any_value(b.size) AS sb FROM e a JOIN e b ON a.e = b.e AND a.id < b.id GROUP BY 1, 2)
SELECT first, second, x.n AS n_first, y.n AS n_second, round(common / {D("(sa + sb - common)")}, 6) AS similarity FROM p JOIN c x ON x.id = first JOIN c y ON y.id = second WHERE common / {D("(sa + sb - common)")} >= {D(0.6)}""",
    ),
}
