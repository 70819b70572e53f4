"""Repeated passages against brute force over all windows."""

import hashlib
import random

import duckdb
import pytest

from evispark.llm import passages
from evispark.llm.passages import op11_repeated_passages, remove_repeats

LAST = passages.LAST


def brute(rows, size=20):
    """Result rows by the definition: windows in order of identifier; rows of one identifier are documents of their own."""
    words = [(t or "").encode().split() for _, t in rows]
    ids = [LAST if i is None else i for i, _ in rows]
    least = {}
    for own, w in zip(ids, words):
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            least[key] = min(least.get(key, own), own)
    out = []
    for (doc_id, _), own, w in zip(rows, ids, words):
        keep, seen = [True] * len(w), set()
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            if least[key] < own or key in seen:
                keep[j : j + size] = [False] * size
            seen.add(key)
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((doc_id, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in remove_repeats(docs, with_text=False, **more).collect()), key=str)


@pytest.fixture(scope="module")
def varied():
    """Texts of a few words that share passages, lines and whole copies, in one row and between rows."""
    draw = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(40)] + ["a", "b", "#", "ǆ"]
    passage = [" ".join(draw.choices(vocabulary, k=draw.choice([19, 20, 21, 30, 75]))) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [" ".join(draw.choices(vocabulary, k=draw.randrange(0, 30))) for _ in range(4)]
        for at in range(draw.randrange(0, 4)):
            parts.insert(draw.randrange(len(parts)), draw.choice(passage))
        rows.append((draw.choice([None, i, i, i, -i, i // 2]), "\n".join(parts)))
    rows += [(7, None), (8, ""), (9, " \t\n"), (10, "spam " * 500), (11, "spam " * 30), (12, "a b c " * 90), (None, rows[3][1]), rows[4], rows[4], (500, rows[5][1])]
    return rows


@pytest.mark.parametrize("shard_bytes", [1 << 24, 4000])
def test_equals_brute_force(spark, varied, shard_bytes):
    assert found(spark, varied, shard_bytes=shard_bytes) == brute(varied)


def test_cells_are_dealt(spark, varied, monkeypatch):
    monkeypatch.setattr(passages, "CELL_WORDS", 300)
    monkeypatch.setattr(passages, "REGION_WORDS", 200)
    assert found(spark, varied, shard_bytes=10_000) == brute(varied)


def test_op11_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = op11_repeated_passages(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = brute(duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and any(r[2] for r in want)


def test_kept_words_are_returned(spark):
    line = " ".join(f"x{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"one {line}", "p"), (2, f"{line} two\tthree", "q")], "doc_id long, text string, n_words string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs).collect()}
    assert got == {1: (26, 0, f"one {line}"), 2: (27, 25, "two three")}


def test_empty_table(spark):
    assert found(spark, []) == []


def test_windows_with_one_hash_in_common():
    """Two windows whose first hashes are equal keep their own holders."""
    import numpy as np

    holders = passages.Holders(np.array([5, 5, 9]), np.array([1, 2, 3]), np.array([10, 20, 30]))
    hit, holder = holders.find(np.array([5, 5, 5, 9, 1]), np.array([2, 1, 7, 3, 1]))
    assert hit.tolist() == [True, True, False, True, False] and holder[hit].tolist() == [20, 10, 30]


def test_hashes_alone_decide_nothing():
    """A region whose words differ from the passage isn't covered, whatever its hashes."""
    passage = " ".join(f"a{i}" for i in range(30)).encode()
    automaton = passages.PhraseAutomaton([(1, passage)])
    other = passage.replace(b"a15", b"zz")
    assert automaton.covered(1, passage).all() and not automaton.covered(2, passage).any() and not automaton.covered(1, other).any()


def test_word_hashes_are_those_of_the_words(monkeypatch):
    """Equal words have equal hashes wherever they stand, other words have others; the words are those of ``split``."""
    draw = random.Random(8)
    words = [w.encode() for w in ("a", "b", "ab", "ba", "é", "\x01", "a\x00", "\x00a", "long" * 30)]
    monkeypatch.setattr(passages, "CHUNK", 16)
    known = {}
    for _ in range(50):
        text = b"".join(draw.choice(words) + draw.choice([b" ", b"\t\n ", b"\x0b", b"\x0c\r"]) for _ in range(draw.randrange(12)))
        hashes = passages.word_hashes(text).tolist()
        assert len(hashes) == len(text.split())
        assert all(known.setdefault(w, h) == h for w, h in zip(text.split(), hashes))
    assert len(set(known.values())) == len(known) == len(words)


def test_chosen_phrases_cover_every_window():
    import numpy as np

    hashes = passages.word_hashes(" ".join(random.Random(2).choices("abc", k=300)).encode())
    phrases, least = passages.window_phrases(hashes)
    assert least.tolist() == [phrases[j : j + passages.WIDTH].min() for j in range(len(hashes) - passages.WINDOW + 1)]
    chosen = passages.chosen_phrases(hashes)
    assert set(least.tolist()) == set(chosen.tolist()) and len(passages.chosen_phrases(hashes[:19])) == 0
    spam = passages.word_hashes(b"spam " * 25)
    assert len(passages.chosen_phrases(spam)) == 18 and np.unique(passages.rolled(spam, 20, passages.FIRST)).size == 1
