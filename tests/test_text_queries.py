"""Queries that SQL can't express, against brute force on the small tables and on texts with structure."""

import random
import re

import duckdb
import pytest

from evispark.operators import chunk, normalize
from evispark.plans import registry, text

SF_DIR = "/root/testdata/sf0.001"


def table(sql):
    return duckdb.connect().execute(sql).fetchall()


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[j - 1]))
        row = new
    return row[-1]


def brute_normalize(name, aliases, least_overlap=0.8, least_ratio=0.85):
    words = lambda x: set(re.findall(r"[^\W_]+", x.lower()))
    low = " ".join(name.lower().split())
    exact = [c for a, c in aliases if a == low]
    if exact:
        return exact[0], "exact", 1.0
    shares = [(len(words(name) & words(a)) / max(len(words(name)), len(words(a))), -i, c) for i, (a, c) in enumerate(aliases)]
    best = max(shares, key=lambda x: x[:2])
    if best[0] >= least_overlap:
        return best[2], "token", round(0.9 + 0.1 * best[0], 6)
    ratios = [(round(2 * longest_common(low, a) / (len(low) + len(a)), 6), -i, c) for i, (a, c) in enumerate(aliases)]
    best = max(ratios, key=lambda x: x[:2])
    return (best[2], "fuzzy", best[0]) if best[0] >= least_ratio else (None, "none", None)


def test_fuzzy_names_equal_brute_force(spark):
    got = {r.name: (r.canonical, r.method, r.confidence) for r in registry.QUERIES["text_normalize_fuzzy"](spark, SF_DIR).collect()}
    names = [n for (n,) in table(f"SELECT DISTINCT p_name || 's' FROM '{SF_DIR}/part.parquet'")]
    assert got == {n: brute_normalize(n, text.ALIASES) for n in names}
    assert {m for _, m, _ in got.values()} >= {"fuzzy", "none"}


def test_typos_anywhere_are_found(spark):
    rng = random.Random(4)
    aliases = [("large gear", "GEAR"), ("blue bolt", "BOLT"), ("lumbar stenosis", "LS"), ("ab", "AB"), ("x", "X"), ("spinal fusion", "SF")]
    names = {"1arge gear", "xblue bolt", "a", "ab", "abc", "x", "xx", "stenosis lumbar", ""}
    for alias, _ in aliases:
        for _ in range(30):
            letters = list(alias)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
            names.add("".join(letters))
    table_ = spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(aliases)], "alias string, canonical string, ord int")
    got = {r.name: (r.canonical, r.method, r.confidence) for r in normalize.normalize(spark.createDataFrame([(n,) for n in names], "name string"), table_).collect()}
    want = {n: brute_normalize(n, aliases) if n else (None, "none", None) for n in names}
    assert {n: (c, m, None if v is None else round(v, 6)) for n, (c, m, v) in got.items()} == want


STRUCTURED = """Some title line

Abstract
Short summary of it. It ends here.

1. Methods:
We did this. Then that! And more?

Results
All went well.

References
[1] Doe, 1999.
"""


def test_chunks_of_documents(spark):
    docs = dict(table(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'"))
    got = {r.doc_id: (r.n_chunks, r.longest) for r in registry.QUERIES["text_chunks"](spark, SF_DIR).collect()}
    for doc, content in docs.items():
        bare = chunk.recursive_chunks(content, overlap=0)
        lapped = chunk.recursive_chunks(content)
        flat = lambda parts: re.sub(r"[\s.]+", "", "".join(parts))
        assert flat(bare) == flat([content])  # nothing but separators is lost, in order
        assert all(len(c) <= 512 for c in bare) and all(b.endswith(a) and len(b) <= 512 + 51 for a, b in zip(bare, lapped))
        assert len(bare) == len(lapped) <= 1 + len(content) // 100
        assert got.get(doc, (0, None)) == (len(lapped), max(map(len, lapped), default=None))


def test_section_and_tiered_chunks(spark):
    assert chunk.section_chunks(STRUCTURED) == [
        ("abstract", "Short summary of it. It ends here."),
        ("methods", "We did this. Then that! And more?"),
        ("results", "All went well."),
    ]
    assert chunk.tiered_chunks(STRUCTURED) == [
        ("2:other", "Some title line"),
        ("1:abstract", "Short summary of it. It ends here."),
        ("2:methods", "We did this. Then that! And more?"),
        ("1:results", "All went well."),
        ("2:references", "[1] Doe, 1999."),
    ]
    assert chunk.tiered_chunks(None) == chunk.section_chunks("") == []
    many = "Results\n" + " ".join(f"Sentence number {i} has six words." for i in range(300))
    parts = chunk.section_chunks(many)
    assert len(parts) > 3 and all(len(c.split()) <= 500 for _, c in parts) and " ".join(c for _, c in parts) == many[8:]


@pytest.mark.parametrize("name, fn", [("text_section_chunks", chunk.section_chunks), ("text_tiered_chunks", chunk.tiered_chunks)])
def test_sections_of_documents(spark, name, fn):
    got = {(r.doc_id, r.section): r.n_chunks for r in registry.QUERIES[name](spark, SF_DIR).collect()}
    want = {}
    for doc, content in table(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'"):
        for section, body in fn(content):
            assert body.strip()
            want[doc, section] = want.get((doc, section), 0) + 1
    assert got == want and len({d for d, _ in got}) > 100


def test_query_cache_forgets_in_time(spark):
    from evispark.operators import cache

    now = [0.0]
    held = cache.QueryCache(size=4, ttl_seconds=10, clock=lambda: now[0])
    for at, name in ((0, "a"), (5, "a"), (11, "a"), (12, "b")):
        now[0] = at
        held.get(name, {}, lambda: spark.range(3))
    assert held.stats() == {"entries": 2, "hits": 1, "misses": 3, "hit_rate": 0.25}
    now[0] = 21.5
    assert held.clean() == 1 and list(name for name, *_ in held.held.values()) == ["b"]


def test_candidates_equal_brute_force(spark):
    got = {}
    for r in registry.QUERIES["text_normalize_candidates"](spark, SF_DIR).collect():
        got.setdefault(r.name, {})[r.place] = (r.canonical, r.score)
    pairs = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    for (name,) in table(f"SELECT DISTINCT p_name FROM '{SF_DIR}/part.parquet'"):
        best = {}
        for alias, canonical in text.ALIASES:
            if pairs(name) & pairs(alias):
                best[canonical] = max(best.get(canonical, 0), round(2 * longest_common(name, alias) / (len(name) + len(alias)), 6))
        want = sorted(((c, s) for c, s in best.items() if s > 0.3), key=lambda x: (-x[1], x[0]))[:3]
        assert got.get(name, {}) == dict(enumerate(want, 1))


def test_few_aliases_are_broadcast(spark):
    """A table made of rows has no known size; still no run of words is shuffled to meet a few aliases."""
    texts = spark.createDataFrame([(1, "Of the sea, the"), (2, None), (3, "")], "doc_id long, text string")
    found = normalize.mentions(texts, spark.createDataFrame([("the", "EN"), ("of the", "EN")], "alias string, canonical string"))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "EN", 3)]


def test_paragraph_chunks(spark):
    assert chunk.paragraph_chunks("one\n\ntwo\n \nthree", least=5, most=9) == ["one two", "three"]
    assert chunk.paragraph_chunks(None) == [] and chunk.merged(["a" * 300, "b", "c" * 300], 200, 1500) == ["a" * 300 + " b", "c" * 300]
    got = {r.doc_id: (r.n_chunks, r.longest) for r in registry.QUERIES["text_paragraph_chunks"](spark, SF_DIR).collect()}
    for doc, content in table(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'"):
        parts = chunk.paragraph_chunks(content)
        flat = lambda x: re.sub(r"[\s.]+", "", x)
        assert flat("".join(parts)) == flat(content) and all(len(p) <= 1500 for p in parts)
        assert got.get(doc, (0, None)) == (len(parts), max(map(len, parts), default=None))
