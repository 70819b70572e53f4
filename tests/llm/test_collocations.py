"""Collocations against their SQL and brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from evispark.llm import collocations as module
from evispark.llm.collocations import OP12_SQL, collocations, op12_collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SF = "/root/testdata/sf0.01"


def brute(rows, least=10, top=2000, share=50):
    upper = {i: i + 32 for i in range(65, 91)}
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        longest = Counter()
        for phrase, a in f.items():
            if len(phrase) == 3 and a >= least:
                for part in (phrase[:2], phrase[1:]):
                    longest[part] = max(longest[part], a)
        kept = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least or (len(phrase) == 2 and longest[phrase] and 100 * longest[phrase] >= share * a):
                continue
            score, _, left, right = min((1000000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
            kept.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def hard():
    draw = random.Random(3)
    words = ["New", "york", "a\x01", "a", "É", "ée", "\U0001f600", "the", "of", "x", "\x00", "é\xa0b", "Zz"]
    rows = [(draw.choice(["en", "fr", "und", None]), "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", "!"]) for _ in range(draw.randrange(0, 120)))) for _ in range(150)]
    return rows + [("en", None), ("de", "   "), ("de", ""), ("en", "of the x " * 40), *[("en", "Ice Cream Van, ice cream")] * 12]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000, "partition_rows": 500}])
def test_equals_brute_force(spark, hard, sizes):
    docs = spark.createDataFrame(hard, "lang string, text string")
    for least, top in ((10, 2000), (2, 7)):
        found = collocations(docs, least=least, top=top, **sizes)
        assert found.columns == COLUMNS
        assert sorted(map(tuple, found.collect())) == brute(hard, least, top)


def test_op12_equals_its_sql_and_brute_force(spark):
    got = sorted(map(tuple, op12_collocations(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall())
    assert got == brute(con.execute("SELECT lang, text FROM documents").fetchall()) and len(got) > 1000


def test_sql_on_hard_rows(hard):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", hard)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall()) == brute(hard)


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("en", "one two")], "lang string, text string")).count() == 0


def test_packed_keys_keep_numbers_and_order():
    draw = np.random.default_rng(1)
    ids = draw.integers(0, 1 << module.BITS, size=(3, 4000)).astype(np.uint64)
    ids[0, :2000] = ids[0, 0]
    ids[1, :1000] = ids[1, 0]
    packed = module.pack(*ids)
    assert all((a == b).all() for a, b in zip(ids, module.unpack(*packed))) and packed[0].max() < 1 << 63
    assert (module.radix_order(list(packed)) == np.lexsort(ids[::-1])).all()


def test_run_lengths():
    draw = np.random.default_rng(2)
    columns = [draw.integers(0, 5, 3000).astype(np.uint64) << np.uint64(40), draw.integers(0, 70000, 3000).astype(np.uint64) % np.uint64(9)]
    weight = draw.integers(1, 9, 3000)
    got, n = module.run_lengths(columns, weight)
    want = Counter()
    for a, b, w in zip(*(c.tolist() for c in columns), weight.tolist()):
        want[a, b] += w
    assert list(zip(*(c.tolist() for c in got), n.tolist())) == [(*k, v) for k, v in sorted(want.items())]


def test_scores_past_64_bits(spark):
    a, left, right = 3 * 10**14, 4 * 10**14, 10**15
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(module._score("a", "l", "r").alias("s")).first()
    assert row.s == 1000000 * a * a // (left * right)
