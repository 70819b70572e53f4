"""Citations matched to papers: by hand, against brute force, and the recall of garbled references."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evispark.operators import linkage
from evispark.plans import linkage as plan

SCHEMA = "{} long, identifier string, authors array<string>, year int, title string"


def low(x):
    return x.strip(" ").lower() if x is not None and x.strip(" ") else None


def brute(citations, papers):
    """By the definition, every citation with every paper."""
    words = lambda x: set(filter(None, re.split(r"[\W_]+", (x or "").lower())))
    out = []
    for cid, ci, ca, cy, ct in citations:
        names = [low(a) for a in ca or [] if low(a)]
        found = []
        for pid, pi, pa, py, pt in papers:
            have = [low(a) for a in pa or [] if low(a)]
            x, y = words(ct), words(pt)
            similarity = round(len(x & y) / max(len(x | y), 1), 6)
            by_author = bool(names) and cy is not None and cy == py and names[0] in " ".join(have) and (similarity > 0.6 or not x or not y)
            near = cy is None or py is None or abs(cy - py) <= 1
            way = 1 if low(ci) and low(ci) == low(pi) else 2 if by_author else 3 if similarity > 0.6 and near else None
            off = None if cy is None or py is None else abs(cy - py)
            got = (0.4 if off == 0 else 0.2 if off == 1 else 0) + 0.6 * sum(any(a in p for p in have) for a in names) / max(len(names), 1)
            most = (0.4 if cy is not None else 0) + (0.6 if names else 0)
            confidence = round(got / most, 6) if most else 0.5
            if way == 1:
                found.append((1, 0, 0, pid, confidence, similarity))
            elif way:
                found.append((way, -confidence, -similarity, pid, confidence, similarity))
        if found:
            way, _, _, pid, confidence, similarity = min(found)
            out.append((cid, pid, ("identifier", "author", "title")[way - 1], confidence, similarity))
    return sorted(out)


def run(spark, citations, papers):
    c = spark.createDataFrame(citations, SCHEMA.format("citation_id"))
    p = spark.createDataFrame(papers, SCHEMA.format("paper_id"))
    return sorted(tuple(r) for r in linkage.match_citations(c, p).collect())


PAPERS = [
    (1, "10.1/A", ["Kim JH", "Park S"], 2020, "Fusion of the lumbar spine in adults"),
    (2, "10.1/a", ["Kim JH"], 2020, "Another work"),
    (3, None, ["Li W"], 2019, None),
    (4, None, ["Limura"], 2019, None),
    (5, " ", [], 2018, "Decompression with or without fusion"),
    (6, None, None, None, "Decompression with or without fusion"),
    (7, None, ["Kim JH", None, " "], 2021, "fusion of the lumbar spine in adults."),
    (8, None, ["Öz"], 2000, "Über die Wirbelsäule"),
    (9, None, ["Li W"], 2019, "A title"),
    (10, None, ["Limit"], 2019, "x " * 300 + " ".join(f"w{i}" for i in range(200))),
]
CITATIONS = [
    (1, " 10.1/A ", None, None, None),
    (2, None, ["kim"], 2020, "Fusion of the lumbar spine, in adults"),
    (3, None, ["kim"], 2020, None),
    (4, None, ["li"], 2019, None),
    (5, None, ["Li"], 2019, "Something else altogether"),
    (6, None, None, 2018, "decompression with fusion or without"),
    (7, None, None, None, "Decompression: with or without fusion"),
    (8, None, ["Nobody"], 2020, "Fusion of the lumbar spine in adults"),
    (9, "", ["öz", "Li"], 1999, "über DIE wirbelsäule"),
    (10, None, [], None, ""),
    (11, None, [""], 2022, "Fusion of the lumbar spine in adults"),
    (12, "10.9/none", ["jh"], 2021, "a b c"),
    (13, None, ["x"], None, " ".join(f"w{i}" for i in range(40, 200))),
    (14, None, ["kim"], 2020, "Fusion of the lumbar spine, in adults"),
]


def test_every_way_and_every_null(spark):
    got = run(spark, CITATIONS, PAPERS)
    assert got == brute(CITATIONS, PAPERS)
    ways = {r[0]: (r[1], r[2]) for r in got}
    assert ways[1] == (1, "identifier") and ways[2] == ways[14] == (1, "author") and ways[5] == (3, "author")
    assert ways[8] == (1, "title") and ways[13] == (10, "title") and 10 not in ways and 12 not in ways


@pytest.mark.parametrize("empty", [0, 1])
def test_empty_tables(spark, empty):
    assert run(spark, [] if empty else CITATIONS, PAPERS if empty else []) == []


def test_random_records_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(14)]
    some = lambda x, p=0.8: x if rng.random() < p else None

    def record(i):
        names = [rng.choice(["Lee", "Leeuw", "Kim A", "Kimura", "Xu", "O"]) for _ in range(rng.randrange(3))]
        return (i, some(f"id{rng.randrange(60)}", 0.1), some(names), some(2000 + rng.randrange(4)), some(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(7)))))

    citations, papers = [record(i) for i in range(150)], [record(i) for i in range(150)]
    assert run(spark, citations, papers) == brute(citations, papers)


@pytest.mark.parametrize("most", [0, 20])
def test_frequent_authors_are_met_within_like_titles(spark, monkeypatch, most):
    monkeypatch.setattr(linkage, "HOT", most)
    test_every_way_and_every_null(spark)
    test_random_records_equal_brute_force(spark)


def test_pieces_that_most_names_share_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(linkage, "HOT", 20)
    names = [(f"customer#{i * 7919 % 100000:06}",) for i in range(100)]
    papers = spark.createDataFrame(names, "names string").withColumn("authors", F.array("names"))
    found = linkage._author_names(papers, papers)
    assert found.count() == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [gram" in plan and "LeftAnti" in plan


def test_copies_of_a_title_are_not_multiplied(spark, monkeypatch):
    """Papers of one title by different authors were all compared with all citations of it."""
    pairs = []

    def scored(met, cited, papers, score=linkage._scored):
        pairs.append(met.count())
        return score(met, cited, papers)

    monkeypatch.setattr(linkage, "_scored", scored)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) * 2 for k in range(3)) + "-author"
    papers = [(i, None, [name(i)], 2000 + i % 3, f"the one title of them all {i % 5}") for i in range(600)]
    citations = [(i, None, [name(i) if i % 6 else "nobody"], 2000 + i % 3, "the one title of them all") for i in range(600)]
    got = {r[0]: r[1] for r in run(spark, citations, papers)}
    assert all(got[i] == i for i in got if i % 6) and len(got) == 600
    assert sum(pairs) < 10 * 600


def test_one_author_and_year_hold_a_third_of_all(spark):
    """Equal records are compared once, so copies of one reference don't multiply with copies of one paper."""
    papers = [(i, None, ["Same"], 2001, "the one title of them all") for i in range(2000)] + [(9000, None, ["Same"], 2001, None)]
    citations = [(i, None, ["same"], 2001, "The one title of them all!") for i in range(2000)]
    assert {r[1:] for r in run(spark, citations, papers)} == {(0, "author", 1.0, 1.0)}


def test_recall_of_garbled_references(spark):
    """Of the references that keep an identifier, a title, or an author with the year, 0.97 at least find their paper or a paper of the same title."""
    sf = "/root/testdata/sf0.001"
    papers, cited = {r.paper_id: r for r in plan.papers(spark, sf).collect()}, plan.citations(spark, sf).collect()
    keeps = {r.citation_id for r in cited if r.identifier or r.title or (r.authors and r.year == papers[r.citation_id].year)}
    got = {r.citation_id: r.paper_id for r in plan.matched(spark, sf).collect()}
    right = sum(got.get(c) == c or (c in got and papers[got[c]].title == papers[c].title) for c in keeps)
    assert right >= 0.97 * len(keeps)
