"""Each registered query on the small tables: its columns, folds and whole results, against brute force or the libraries."""

import hashlib
import re
import shutil
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evispark.llm import decontaminate, licenses, near_copies, secret_scan, sstable
from evispark.llm.registry import QUERIES
from tests.llm.test_llm_operators import brute_counts, brute_fingerprint

SF = "/root/testdata/sf0.001"
DOCS = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
FOLD = {i: zlib.crc32(str(i).encode()) for i in DOCS}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(sstable.VOCABULARY))


def result(spark, name, sf_dir=SF):
    rows = QUERIES[name](spark, sf_dir).collect()
    return {r.doc_id: r for r in rows}, rows


def changed_tables(spark, folder, name, change):
    """A copy of the tables in which one is changed."""
    for table in ("documents", "labels", "benchmark"):
        shutil.copy(f"{SF}/{table}.parquet", folder)
    path = f"{folder}/{name}.parquet"
    frame = duckdb.connect().execute(f"SELECT {change} FROM '{SF}/{name}.parquet'")
    (folder / f"{name}.parquet").unlink()
    import pyarrow.parquet as pq

    pq.write_table(frame.to_arrow_table(), path)
    return f"file://{folder}"


def test_op1(spark, tmp_path):
    got, rows = result(spark, "op1_quality_classifier")
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and got.keys() == DOCS.keys() and len(rows) == len(DOCS)
    assert all(r.held_out == (FOLD[i] % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held_out = ", ".join(str(i) for i in DOCS if FOLD[i] % 3 == 1)
    other = changed_tables(spark, tmp_path, "labels", f"* REPLACE (CASE WHEN doc_id IN ({held_out}) THEN 1 - quality ELSE quality END AS quality)")
    again, _ = result(spark, "op1_quality_classifier", other)
    assert all(again[i].score == r.score for i, r in got.items())  # labels held out change nothing
    label = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    tested = [i for i in label if got[i].held_out]
    assert np.mean([got[i].predicted == label[i] for i in tested]) > 0.9


def test_op2(spark, library):
    got, rows = result(spark, "op2_sstable")
    start = 0
    for i in sorted(DOCS):
        ids = [*library.encode(DOCS[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == len(DOCS)


def test_op3(spark, library):
    got, rows = result(spark, "op3_bpe")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text in DOCS.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert len(rows) == len(DOCS)


def test_op4(spark):
    scanner = licenses.LicenseScanner(licenses.TEMPLATES)
    want = sorted((i, x["license"], x["start"], x["end"], x["differing"]) for i, text in DOCS.items() for x in scanner.scan(text))
    _, rows = result(spark, "op4_license_scan")
    assert sorted((r.doc_id, r.license, r.start, r.end, r.differing) for r in rows) == want
    # every line that is a notice word for word is found
    plain = {n: " ".join(w for w, _, _ in licenses._words(t)) for n, t in licenses.TEMPLATES.items()}
    lines = {(i, n) for i, text in DOCS.items() for n, t in plain.items() if t in " ".join(w for w, _, _ in licenses._words(text or ""))}
    assert lines <= {(r.doc_id, r.license) for r in rows} and lines


def test_op5(spark):
    """Against the verification of every window that passes the exact gate."""
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    index, ids = decontaminate.LeakIndex(items, 0.2, 0), sorted(DOCS)
    want = {(i, x["item_id"]) for i, row in zip(ids, index.leaks([DOCS[i] for i in ids])) for x in row}
    _, rows = result(spark, "op5_decontaminate")
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want) > 0


def test_op6(spark):
    got, rows = result(spark, "op6_simhash")
    prints = {i: brute_fingerprint(text) for i, text in DOCS.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints and all(len(r.fingerprint) == 16 for r in rows)
    root = {i: i for i in DOCS}
    ids = sorted(DOCS)
    for a in ids:
        for b in ids:
            if a < b and root[a] != root[b] and bin(prints[a] ^ prints[b]).count("1") <= 3:
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    assert {i: r.component_id for i, r in got.items()} == root


def test_op7(spark):
    got, rows = result(spark, "op7_quality_rules")
    for i, text in DOCS.items():
        n, chars, symbols, dup, repeated = brute_counts(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup) and repeated in (None, r.n_repeat_words)
        assert r.base_failed == (n < 20 or 100 * r.n_repeat_words > 30 * n) and not (r.kept and r.base_failed)
    assert len(rows) == len(DOCS)


def test_op8(spark):
    kinds = {
        "assign": (re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8),
        "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 16),
        "hex": (re.compile(r"([0-9a-f]+)"), 32),
    }
    got, _ = result(spark, "op8_secret_scan")
    for i, text in DOCS.items():
        spans = [(m.start(), k, name, m.end()) for k, (name, (p, least)) in enumerate(kinds.items()) for m in p.finditer(text or "") if len(m[1]) >= least]
        joined = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(spans))
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == name for s in spans) for name in kinds]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {x for x in r.spans.split(",") if x and not x.startswith("markov")} == {x for x in joined.split(",") if x}


def test_op9(spark, tmp_path):
    got, rows = result(spark, "op9_language_id")
    lang = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    assert got.keys() == DOCS.keys() and all(r.held_out == (FOLD[i] % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    learned = {lang[i] for i in DOCS if FOLD[i] % 4 != 2 and lang[i]}
    assert all((r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in DOCS[i] or "")) and r.lang_pred in learned | {"und"} for i, r in got.items())
    assert np.mean([r.lang_pred == lang[i] for i, r in got.items() if r.held_out and lang[i]]) > 0.95
    held_out = ", ".join(str(i) for i in DOCS if FOLD[i] % 4 == 2)
    other = changed_tables(spark, tmp_path, "documents", f"* REPLACE (CASE WHEN doc_id IN ({held_out}) THEN 'xx' ELSE lang END AS lang, 'elsewhere' AS source)")
    again, _ = result(spark, "op9_language_id", other)
    assert {i: (r.lang_pred, r.score) for i, r in again.items()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_op10(spark):
    got, _ = result(spark, "op10_token_counts")
    for i, text in DOCS.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert got[i].n_pretokens == len(words) and len(words) <= got[i].n_tokens <= sum(len(w.encode()) + 3 for w in words)


# the pipeline


def jaccard_roots(texts):
    """Least identifier of each component of texts whose five-word shingle sets agree to 0.8 or more."""
    sets = {i: {tuple((t or "").lower().split()[a : a + 5]) for a in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for i, t in texts.items()}
    root = {i: i for i in texts}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    return root


def test_every_stage_of_the_pipeline(spark, library):
    pipeline = pytest.importorskip("corpus_pipeline")
    from evispark.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_dedup", "decontaminate", "secret_scan", "bpe"]

    first = stages["language_id"](spark, docs, SF)
    rejected = {r.doc_id for r in langid.identify(docs, langid.train(docs)).filter("rejected").collect()}
    kept = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == columns and kept.keys() == DOCS.keys() - rejected

    second = stages["simhash_dedup"](spark, docs, SF)
    root = jaccard_roots(DOCS)
    assert second.columns == columns and {r.doc_id for r in second.collect()} == set(root.values()) and len(set(root.values())) < len(root)

    third = stages["decontaminate"](spark, docs, SF)
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    ids = sorted(DOCS)
    leaking = {i for i, row in zip(ids, decontaminate.LeakIndex(items, 0.2, 0).leaks([DOCS[i] for i in ids])) if row}
    assert third.columns == columns and {r.doc_id for r in third.collect()} == DOCS.keys() - leaking and leaking

    planted = {10**6: "the token = q1w2e3r4t5y6 and more", 10**6 + 1: "see Zx8Qv1Lm0Pk7Wt3Yb6 there"}
    more = docs.unionByName(spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in planted.items()], docs.schema))
    texts = DOCS | planted
    fourth = stages["secret_scan"](spark, more, SF)
    ratio = secret_scan.train(secret_scan.labelled_tokens(more))
    threshold, redacted = secret_scan.calibrated(ratio), 0
    assert fourth.columns == columns
    for r in fourth.collect():
        marks = [False] * len(texts[r.doc_id] or "")
        spans = secret_scan.find_spans(texts[r.doc_id], ratio, threshold)[1]
        for a, _, b in spans:
            marks[a:b] = [True] * (b - a)
        plain = "".join(c for c, m in zip(texts[r.doc_id] or "", marks) if not m)
        assert r.text.replace("<SECRET>", "") == plain and r.n_chars == len(r.text) and ("<SECRET>" in r.text) == bool(spans)
        redacted += bool(spans)
    assert redacted >= 2

    fifth = stages["bpe"](spark, docs, SF).collect()
    assert len(fifth) == len(DOCS)
    for r in fifth:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_the_whole_pipeline_is_its_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    whole = pipeline.run(spark, SF)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, docs.collect()))


def test_the_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, and a table without rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the cat and the dog went to the river and saw the water of it"
    rows = [(1, text, "en", "a", 60), (1, text, "en", "a", 60), (2, None, None, None, None), (None, text + " again", "en", None, None), (3, "", "en", "b", 0), (4, "the and of " * 30000, None, "b", 1)]
    rows += [(10 + i, f"{text} number {i} of the list and more words here", "en", "c", 1) for i in range(40)]
    for name, data in (("odd", rows), ("none", [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "never seen words at all here today"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = pipeline.run(spark, folder).collect()
        assert (name == "none") == (not out)
        assert len({r.doc_id for r in out}) == len(out) and all(r.n_tokens == len(r.ids) for r in out)
        assert not out or {10, 1} & {r.doc_id for r in out}


def test_near_copies_of_hot_groups(spark):
    """One text copied over and over, and a large group of near copies dealt over small cells."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(500)]
    rows += [(1000 + i, " ".join([*base[:58], f"x{i}", *base[59:], f"y{i}"])) for i in range(120)]
    rows += [(5000 + i, f"a text of its own number {i} with other words {i * 7} and {i * 11}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert found == jaccard_roots(dict(rows))
