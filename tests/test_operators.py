"""Edge cases that the driver's tables don't hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evispark.functions import classify, identifiers, numeric, references
from evispark.operators import cache, chunk, conflict, extract, filters, hierarchy, inference, maintain, network, normalize, rank, recommend, search, synthesis
from evispark.sources import files
from evispark.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, **values):
    from pyspark.sql import Row

    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


# hierarchy


def test_closure_with_diamond_and_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")], "child string, parent string")
    up = hierarchy.closure(edges)
    assert up.filter("node = 'a' AND ancestor = 'd'").count() == 2
    assert {(r.node, r.ancestor, r.distance) for r in up.filter("node = 'x'").collect()} == {("x", "y", 1), ("x", "x", 2)}
    assert rows(hierarchy.problems(edges, spark.createDataFrame([("lost",), ("a",)], "node string"), up)) == [("cycle", "x"), ("cycle", "y"), ("orphan", "lost")]
    assert rows(hierarchy.common_ancestors(up, spark.createDataFrame([("b", "c")], "a string, b string"))) == [("b", "c", "d", 2)]
    assert rows(hierarchy.levels(up)) == [("a", 2), ("b", 1), ("c", 1)]


def test_rules_refuse_what_they_do_not_know(spark):
    with pytest.raises(KeyError, match="no rule"):
        inference.run_rule("nothing")
    with pytest.raises(ValueError, match="needs"):
        inference.run_rule("transitive_treatment", up=spark.range(1))


# evidence


EVIDENCE = "intervention string, outcome string, source_paper_id long, evidence_level string, direction string, is_significant boolean, effect double"


def test_conflict_report_needs_both_directions(spark):
    df = spark.createDataFrame(
        [("i", "o", 1, "1a", "improved", True, 1.0), ("i", "o", 2, "5", "worsened", None, 2.0), ("i", "p", 1, "1a", "improved", True, 1.0), ("j", "o", 1, "1a", "improved", True, 1.0), ("j", "o", 1, "2a", "worsened", True, 1.0), ("k", "o", 3, None, None, None, None)],
        EVIDENCE,
    )
    found = conflict.conflict_report(df).collect()
    assert [(r.intervention, r.outcome, r.severity, r.n_significant) for r in found] == [("i", "o", "critical", 1)]
    assert found[0].confidence == pytest.approx(0.2 * 0.2 + 0.4 * 5.5 / 10 + 0.3 * 0.5 + 0.1 * 1, abs=1e-4)


def test_synthesis_values(spark):
    data = [("i", "o", k, "1a", "improved", True, v) for k, v in enumerate((10.0, 11.0, 12.0))]
    df = spark.createDataFrame(data, EVIDENCE)
    got = synthesis.synthesize(df, "effect").first()
    assert (got.direction, got.heterogeneity, got.strength, got.grade) == ("improved", "low", "strong", "A")
    pool = synthesis.pooled(df, "effect").first()
    assert pool.pooled_mean == 11.0 and pool.std_error == pytest.approx((2 / 3) ** 0.5 / 3**0.5, abs=1e-6)
    single = synthesis.synthesize(df.filter("effect = 10"), "effect").first()
    assert (single.strength, single.grade) == ("insufficient", "C")


def test_i_squared(spark):
    df = spark.createDataFrame([("a", 1.0, 0.1), ("a", 3.0, 0.1), ("b", 1.0, 0.1), ("c", 1.0, 0.0), ("c", 2.0, -1.0)], "k string, x double, v double")
    got = {r.k: r.i_squared for r in synthesis.i_squared(df, "x", "v", ("k",)).collect()}
    assert got["b"] == 0 and got["c"] == 0 and got["a"] == pytest.approx((20 - 1) / 20 * 100, abs=1e-3)


# filters


def test_exact_before_like(spark):
    df = spark.createDataFrame([("Fusion Rate",), ("fusion time",), ("Pain",)], "outcome string")
    assert rows(filters.exact_or_like(df, "outcome", "Fusion Rate")) == [("Fusion Rate", True)]
    assert rows(filters.exact_or_like(df, "outcome", "Fusion score")) == [("Fusion Rate", False), ("fusion time", False)]
    assert rows(filters.exact_or_like(df, "outcome", "nothing")) == []


def test_levels():
    assert filters.acceptable_levels("2a") == ["1a", "1b", "2a"] and len(filters.acceptable_levels("?")) == 9


# numbers and directions


@pytest.mark.parametrize(("text", "value"), [("85.2%", 85.2), ("about -3 mm", -3.0), ("not reported", None), ("", None), (".5", 0.5)])
def test_number_in(spark, text, value):
    assert one(spark, numeric.number_in(F.col("t")), t=text) == value


@pytest.mark.parametrize(("text", "value"), [("p < 0.05", 0.05), ("P=.001", 0.001), ("0.03", 0.03), ("12", None), ("n.s.", None)])
def test_p_value(spark, text, value):
    assert one(spark, numeric.p_value(F.col("t")), t=text) == value


def test_directions(spark):
    got = lambda b, f, up: one(spark, numeric.change_direction(F.col("b"), F.col("f"), F.lit(up)), b=b, f=f)
    assert [got(0.0, 1.0, True), got(100.0, 104.0, True), got(100.0, 120.0, True), got(100.0, 120.0, False)] == ["unknown", "unchanged", "improved", "worsened"]


# classification and identifiers


@pytest.mark.parametrize(
    ("text", "design"),
    [("Multi-center randomized trial", "RCT"), ("a non-randomized study", "other"), ("Systematic review and meta-analysis", "meta-analysis"), ("", ""), ("chart review", "other"), ("prospective cohort", "prospective-cohort")],
)
def test_study_design(spark, text, design):
    assert one(spark, classify.study_design(F.col("t")), t=text) == design


def test_sections_and_ties(spark):
    got = one(spark, classify.section(F.col("t"), F.lit(0.5)), t="Results: the main finding was significant")
    assert (got.section, got.tier) == ("results", 1)
    assert one(spark, classify.section(F.col("t"), F.lit(0.5)), t="nothing here").section == "other"
    assert one(spark, classify.best(F.col("t"), [("x", "a", 1), ("y", "a", 1)], "none"), t="a").label == "x"


def test_identifiers(spark):
    text = "See doi: 10.1000/ABC.123). PMID: 12345678, ISBN 978-3-16-148410-0, 2019"
    assert one(spark, identifiers.doi(F.col("t")), t=text) == "10.1000/abc.123"
    assert one(spark, identifiers.pmid(F.col("t")), t=text) == "12345678"
    assert one(spark, identifiers.isbn(F.col("t")), t=text) == "9783161484100"
    assert one(spark, identifiers.segments(F.col("t")), t="L3-5") == ["L3-4", "L4-5"]
    assert one(spark, identifiers.segments(F.col("t")), t="L5-S1") == ["L5-S1"]
    assert [one(spark, identifiers.last_name(F.col("t")), t=x) for x in ("Smith, John", "Park SM", "Ann Lee")] == ["Smith", "Park", "Lee"]
    assert one(spark, identifiers.lucene_escape(F.col("t")), t="a+b (c)") == r"a\+b \(c\)"


def test_references(spark):
    args = [F.array(F.lit("Smith, John A"), F.lit("Ann Lee")), F.lit("Title"), F.lit("Spine"), F.lit(2020), F.lit(5), F.lit("1234-1241")]
    assert one(spark, references.vancouver(*args), a=1) == "Smith JA, Lee A. Title. Spine. 2020;5:1234-41."
    assert one(spark, references.apa(*args), a=1) == "Smith JA, & Lee A (2020). Title. Spine, 5, 1234-1241."
    assert one(spark, references.ris(args[0], args[1], args[2], args[3], F.lit(None).cast("string")), a=1).split("\n") == ["TY  - JOUR", "AU  - Smith, John A", "AU  - Ann Lee", "TI  - Title", "JO  - Spine", "PY  - 2020", "ER  - "]


# normalisation


def test_normalize_stages(spark):
    aliases = spark.createDataFrame([("Lumbar Fusion", "LF", 0), ("fusion lumbar", "FL", 1), ("Laminectomy", "LAM", 2)], "alias string, canonical string, ord int")
    names = spark.createDataFrame([("lumbar  fusion",), ("the lumbar fusion of it",), ("laminectomi",), ("zzz",), ("LUMBAR fusion",)], "name string")
    got = {r.name: (r.canonical, r.method) for r in normalize.normalize(names, aliases).collect()}
    assert got == {"lumbar  fusion": ("LF", "exact"), "LUMBAR fusion": ("LF", "exact"), "laminectomi": ("LAM", "fuzzy"), "the lumbar fusion of it": (None, "none"), "zzz": (None, "none")}
    more = normalize.register(aliases, spark.createDataFrame([("zzz", "Z"), ("laminectomy", "other")], "alias string, canonical string"))
    assert more.count() == 4


def test_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert normalize.common_subsequence(a, b) == table[-1][-1]


# chunks and extraction


def test_chunks():
    text = "One sentence here. " * 100
    got = chunk.recursive_chunks(text, 200, 20)
    assert all(len(c) <= 221 for c in got) and "".join(chunk.recursive_chunks("x" * 1200, 500, 0)) == "x" * 1200
    assert chunk.recursive_chunks(None) == [] and chunk.recursive_chunks("  ") == []
    paper = "Title\nAbstract\nShort one. Two.\nMethods\nWe did it.\nReferences\n1. A"
    assert [s for s, _ in chunk.section_chunks(paper)] == ["abstract", "methods"]
    assert [s for s, _ in chunk.structured_abstract("BACKGROUND: a. RESULTS: b.")] == ["background", "results"] and chunk.structured_abstract("plain") == []


def test_statistics_and_links():
    found = extract.statistics("HR 0.75 (95% CI 0.60-0.95), p = 0.02. The OR = 1.2. Success in 85% of cases." + " " * 120 + "p=0.9")
    assert [(x["kind"], x["value"]) for x in found] == [("hazard_ratio", 0.75), ("odds_ratio", 1.2), ("percentage", 85.0)]
    assert found[0]["low"] == 0.6 and found[0]["significant"] and found[0]["direction"] == "decreased"
    for gap, linked in ((99, True), (100, False)):
        assert (extract.statistics("HR = 2" + "," * gap + "p=0.01")[0]["p_value"] is not None) == linked


def test_citations_and_elements():
    got = extract.citations("As shown [1, 3-5] and (Smith et al., 2020); Jones (2019) agrees.")
    assert [(x["style"], x["author"], x["year"]) for x in got] == [("number", None, None), ("paren", "Smith", 2020), ("narrative", "Jones", 2019)]
    kinds = {x["kind"]: x["phrase"] for x in extract.study_elements("We enrolled 120 patients with stenosis. They underwent open fusion compared with laminectomy in 2 years.")}
    assert kinds["population"].startswith("120 patients") and kinds["intervention"] == "open fusion" and kinds["comparison"] == "laminectomy"


# ranking and search


def test_fusion_and_merge(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.5)], "k string, score double")
    b = spark.createDataFrame([("y", 0.7)], "k string, score double")
    order = [F.desc("score"), F.asc("k")]
    got = {r.k: r.rrf for r in rank.reciprocal_rank_fusion({"a": (a, 0.7), "b": (b, 0.3)}, "k", order).collect()}
    assert got == {"x": pytest.approx(0.7 / 61), "y": pytest.approx(0.7 / 62 + 0.3 / 61)}
    merged = {r.k: r.score for r in rank.merge_adaptive(a.withColumnRenamed("score", "graph_score"), b.withColumnRenamed("score", "vector_score"), "k", "factual").collect()}
    assert merged == {"x": 0.9, "y": pytest.approx(0.7 * 0.5 + 0.3 * 0.7)}
    same = spark.createDataFrame([("p", 2.0), ("q", 2.0)], "k string, s double")
    assert [r.n for r in rank.min_max(same, "s", "n").collect()] == [1.0, 1.0]


def test_zero_vectors(spark):
    v = search.with_norm(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>"))
    q = v.filter("vec_id = 2").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("norm").alias("query_norm"))
    assert [(r.vec_id, r.similarity) for r in search.nearest(v, q, 3).orderBy("place").collect()] == [(2, 1.0), (1, 0.0), (3, -1.0)]


def test_nearest_moves_a_bounded_number_of_rows(spark, monkeypatch):
    """In cells and blocks as in one: equal to all pairs, with ties by identifier; only k rows a query and cell are ranked."""
    rng = random.Random(5)
    pool = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)] + [[0.0] * 4]
    rows = [(i, rng.choice(pool), i % 3) for i in range(600)]
    v = spark.createDataFrame([*rows, (600, None, 0), (601, [1.0, None, 0.0, 0.0], 0), (602, [1.0], 0)], "vec_id long, embedding array<double>, label int")
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    monkeypatch.setattr(search, "CELL", 50)
    for others in (False, True):
        df = search.nearest(v, q, 3, others=others)
        got = {}
        for r in sorted(df.collect(), key=lambda r: r.place):
            got.setdefault(r.query_id, []).append((r.vec_id, r.similarity, r.label))
        norm = lambda x: math.sqrt(sum(a * a for a in x)) or 1.0
        for i, x, _ in rows[::10]:
            all_pairs = [(j, round(sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y), 6) + 0.0, label) for j, y, label in rows if not (others and i == j)]
            assert got.pop(i) == [(j, pytest.approx(c), label) for j, c, label in sorted(all_pairs, key=lambda r: (-r[1], r[0]))[:3]]
        assert not got
        plan = df._jdf.queryExecution().toString()
        assert "Join" not in plan  # no row for each pair


def test_similarity_join_is_exact(spark):
    rng = random.Random(1)
    sets = {i: frozenset(rng.sample(range(12), rng.randint(1, 6))) for i in range(60)}
    df = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "k long, e long")
    classes = {}
    for i, s in sets.items():
        classes.setdefault(s, []).append(i)
    want = set()
    names = {min(m): (s, len(m)) for s, m in classes.items()}
    for a in names:
        for b in names:
            x, y = names[a][0], names[b][0]
            if a < b and len(x & y) / len(x | y) >= 0.5:
                want.add((a, b, names[a][1], names[b][1]))
    assert {(r.first, r.second, r.n_first, r.n_second) for r in search.similarity_join(df, "k", "e", 0.5).collect()} == want


# maintenance


def test_upsert_and_append(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    got = maintain.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert rows(got) == [(1, "a", "x"), (2, "c", None), (3, "d", None)]
    filled = maintain.fill_missing(base, spark.createDataFrame([(1, "n"), (2, "n")], "k int, w string"), ["k"], ["w"])
    assert rows(filled) == [(1, "a", "x"), (2, "b", "n")]
    ids = spark.createDataFrame([(1, ["p"])], "k int, ids array<string>")
    more = maintain.append_once(ids, spark.createDataFrame([(1, ["p", "q"]), (4, ["z"])], "k int, ids array<string>"), ["k"], "ids")
    assert rows(more) == [(1, ["p", "q"]), (4, ["z"])]


def test_merge_and_redirect(spark):
    nodes = spark.createDataFrame([("Fusion", 3), ("fusion", 9), ("Pain", 1)], "name string, degree int")
    mapping = maintain.case_duplicates(nodes, "name", [-F.col("degree")])
    assert rows(mapping) == [("Fusion", "fusion")]
    edges = spark.createDataFrame([("Fusion", "Pain"), ("fusion", "Pain"), ("Fusion", "fusion")], "a string, b string")
    assert rows(maintain.redirect(edges, mapping, ["a", "b"])) == [("fusion", "Pain")]
    assert rows(maintain.garbage(nodes, nodes, "name", "^P", 10)) == [("Pain",)]


def test_backfill_without_reviews(spark):
    inv = spark.createDataFrame([(1, "i"), *((2, f"i{k}") for k in range(4))], "paper_id int, intervention string")
    stu = spark.createDataFrame([(1, "p"), *((2, f"p{k}") for k in range(4))], "paper_id int, pathology string")
    assert rows(maintain.backfill_treats(inv, stu)) == [("i", "p", 1, 1)]


def test_relations_and_items(spark):
    edges = spark.createDataFrame([("a", "b", "SUPPORTS", 0.5), ("a", "a", "SUPPORTS", 0.5), ("a", "b", "OTHER", 0.5), ("a", "b", "SUPPORTS", None)], "source string, target string, kind string, confidence double")
    good, bad = maintain.valid_relations(edges, ["SUPPORTS"])
    assert good.count() == 1 and bad.count() == 3
    papers = spark.createDataFrame([(1, [("x", 1)]), (2, [("x", 2), ("y", 3)])], "paper_id int, items array<struct<name:string,size:int>>")
    nodes, links = maintain.explode_items(papers, "items", "paper_id")
    assert rows(nodes) == [("x", 1), ("y", 3)] and links.count() == 3


def test_recommendation_verdicts(spark):
    candidates = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "c", False)], "patient_id int, intervention string, first_line boolean")
    matched = spark.createDataFrame([(1, "a", "relative", 1.0), (1, "b", "absolute", 1.0), (1, "c", "risk", 2.0)], "patient_id int, intervention string, kind string, factor double")
    none = spark.createDataFrame([], "intervention string, evidence_score double")
    fit = spark.createDataFrame([], "patient_id int, intervention string, fit_score double")
    got = {r.intervention: (r.score, r.verdict) for r in recommend.recommend(candidates, matched, none, fit).collect()}
    assert got == {"a": (pytest.approx(0.57 * 1.2 * 0.9), "alternative"), "b": (0.0, "contraindicated"), "c": (pytest.approx(0.12 + 0.15 + 0.15), "recommended")}


# caches, sources and streams


def test_query_cache(spark):
    held = cache.QueryCache(size=2)
    for name in ("a", "b", "a", "c"):
        held.get(name, {"x": 1}, lambda: spark.range(3))
    assert held.stats() == {"entries": 2, "hits": 1, "misses": 3, "hit_rate": 0.25}
    assert held.invalidate("c") == 1


def test_embedding_cache(spark):
    import datetime as dt

    now = dt.datetime(2024, 1, 2)
    wanted = spark.createDataFrame([(1, "Hello  World"), (2, "new"), (3, "old")], "id int, text string")
    stored = spark.createDataFrame([("hello world", dt.datetime(2024, 1, 1, 23)), ("old", dt.datetime(2023, 1, 1))], "text string, created_at timestamp")
    stored = stored.select(cache.text_key().alias("key"), F.array(F.lit(1.0)).alias("embedding"), "created_at")
    hits, misses = cache.split_hits(wanted, stored, F.lit(now), 86400)
    assert [r.id for r in hits.collect()] == [1] and sorted(r.id for r in misses.collect()) == [2, 3]


PAPERS = """{"paper_id": "p1", "evidence_level": "1a", "interventions": ["A", " "], "pathologies": ["X"], "outcomes": [{"intervention": "A", "name": "O", "p_value": 0.01, "direction": "improved"}]}
{"paper_id": "", "interventions": ["B"]}
not json
"""


def test_json_source_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(PAPERS)
    tables = files.graph_tables(files.read_papers(spark, str(tmp_path / "in")))
    assert {k: df.count() for k, df in tables.items()} == {"paper": 1, "investigates": 1, "studies": 1, "involves": 0, "affects": 1}
    assert tables["affects"].first().is_significant
    files.write_graph(tables, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph" / "affects")).count() == 1

    def take():
        query = ingest.ingest(ingest.paper_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"), files.graph_tables)
        query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out" / "paper")).count()

    assert take() == 1
    (tmp_path / "in" / "two.json").write_text(PAPERS.replace("p1", "p2"))
    assert take() == 2


def test_raw_files_and_query_text(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert [r.text for r in files.read_raw(spark, str(tmp_path), "*.bin", lambda b: b.decode().upper()).collect()] == ["ABC"]
    assert files.search_query("fusion", 2019, None, ["Review"]) == 'fusion AND 2019:3000[pdat] AND ("Review"[pt])'


def test_stream_windows_equal_batch(spark, tmp_path):
    spark.range(200).selectExpr("timestamp_seconds(1700000000 + id * 60) AS ts", "'k' || id % 2 AS kind", "CAST(id AS DOUBLE) AS value", "id AS event_id").write.parquet(str(tmp_path / "ev"))
    batch = spark.read.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev"))
    query = ingest.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("windows")) == rows(ingest.windowed_counts(batch, "ts", "kind"))
    assert ingest.sessions(batch, "ts", "kind", "5 minutes").count() == 2


def test_followers_and_ego_with_cycle_and_hub(spark):
    cites = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (1, 5), (6, 1), (7, 7)], "source long, target long")
    found = {(r.paper, r.root): r.depth for r in network.followers(cites).collect()}
    assert found[(4, 1)] == 3 and (7, 7) not in found and (2, 2) not in found
    near = {(r.node, r.neighbour): r.distance for r in network.ego(cites, 2, spark.createDataFrame([(6,)], "node long")).collect()}
    assert near == {(6, 1): 1, (6, 2): 2, (6, 5): 2}
    assert network.ego(cites.filter("source > 99")).count() == 0


def test_citation_confidence(spark):
    cases = [
        (2000, 2000, ["a", "b"], ["b"], 0.7),
        (2000, 2001, None, ["b"], 0.5),
        (None, 2001, ["a"], None, 0.0),
        (None, 2001, None, ["b"], 0.5),
        (2000, None, [], [], 0.0),
    ]
    df = spark.createDataFrame(cases, "cy int, y int, ca array<string>, a array<string>, want double")
    got = df.select("want", network.citation_confidence(F.col("cy"), F.col("y"), F.col("ca"), F.col("a")).alias("got")).collect()
    assert [round(r.got, 6) for r in got] == [r.want for r in got]


def test_stances_and_chain_confidence(spark):
    facts = spark.createDataFrame([("o", 1, "improved"), ("o", 2, "worsened"), ("o", 3, "improved"), ("o", 3, "worsened"), ("o", 4, None), ("x", 5, "improved")], "outcome string, source_paper_id int, direction string")
    claims = spark.createDataFrame([(9, "o", "improved", "worsened")], "claim_id int, outcome string, claimed string, opposite string")
    assert rows(network.stances(claims, facts)) == [(9, 1, "supporting"), (9, 2, "refuting"), (9, 3, "neutral"), (9, 4, "neutral")]
    scored = spark.createDataFrame([("a", i, 1.0, "high") for i in range(6)] + [("b", 1, 0.5, None)], "k string, i int, score double, strength string")
    assert rows(network.chain_confidence(scored, ["k"], "score", [F.desc("score"), F.asc("i")], "strength")) == [("a", 1.0), ("b", 0.5)]


def test_supplement_and_first_per_document(spark):
    kind = "k string, doc int, score double"
    local, extra = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 3, 1.0)], kind), spark.createDataFrame([("a", 4, 1.0), ("b", 5, 1.0), ("c", 6, 1.0)], kind)
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert rows(network.supplement(local, extra, keys, "k", 2).select("doc", "origin")) == [(1, "local"), (2, "local"), (3, "local"), (5, "extra"), (6, "extra")]
    hits = spark.createDataFrame([("a", 1, 0.2), ("b", 1, 0.9), ("c", 2, 0.9), ("d", 3, 0.1)], kind)
    assert rows(network.first_per_document(hits, "doc", [F.desc("score"), F.asc("doc")], 2).select("k", "doc")) == [("b", 1), ("c", 2)]


def test_distance_boost_and_reviews(spark):
    is_a = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "child string, parent string")
    nodes = spark.createDataFrame([(n,) for n in "abcdx"], "node string")
    found = network.distance_boost(hierarchy.closure(is_a), nodes, spark.createDataFrame([("a",)], "node string"))
    assert {r.node: r.boost for r in found.collect()} == {"a": 1.0, "b": 0.85, "c": 0.7, "d": 0.5, "x": 0.5}
    one_paper = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (2, "p")], "paper_id int, m string")
    assert [r.paper_id for r in network.reviews((one_paper, "m"), least=2).collect()] == [1]
