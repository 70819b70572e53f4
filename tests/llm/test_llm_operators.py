"""The ten operators against brute force, round trips and the edge cases that their docstrings define."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from evispark.llm import bpe, components, decontaminate, langid, quality_qda, quality_rules, secret_scan, simhash, sstable, token_counts
from evispark.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and thanedble anea eriner erent onha licht und nicht que pour les elle token".split()


def some_texts(n=60, seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 60))) for _ in range(n)]
    texts += [None, "", " \n\t ", "x", "x y", texts[0], texts[0], "Ünï çödé <|endoftext|> 123 ²³ 中文  !", "a" * 3000, "word " * 5000]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(some_texts())]
    return spark.createDataFrame([*rows, (None, "null id text", None, None, None), (5, "another row of id five", "en", "s", 1)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


# 1


def test_qda_scores_every_row_and_separates_classes(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choices(WORDS, k=40)) + ".") for i in range(80)]
    bad = [(100 + i, " ".join(w + "###" for w in rng.choices(WORDS, k=40))) for i in range(40)]
    docs = spark.createDataFrame([*good, *bad, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:50]] + [(i, 0) for i, _ in bad[:25]] + [(500, None)], "doc_id long, quality int")
    found = by_id(quality_qda.classify(docs, quality_qda.train(docs, labels)))
    assert len(found) == 122 and all(0 <= r.score <= 1 for rs in found.values() for r in rs)
    assert all(found[i][0].predicted == 1 for i, _ in good[50:]) and all(found[i][0].predicted == 0 for i, _ in bad[25:])


def test_qda_moments_match_numpy(spark):
    texts = [t or "" for t in some_texts(30)]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "quality int, text string").repartition(4)
    n, sums, products = quality_qda.moments(df, "quality")
    x = np.array([quality_qda.features(t) for t in texts])
    for k in (0, 1):
        own = x[k::2]
        assert n[k] == len(own)
        np.testing.assert_allclose(sums[k], own.sum(axis=0))
        np.testing.assert_allclose(products[k], own.T @ own)


def test_qda_without_labels(docs, empty, spark):
    model = quality_qda.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_qda.classify(docs, model).collect()} == {0.5}
    assert quality_qda.classify(empty, model).count() == 0


# 2


def test_sstable_round_trip(docs, spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    sstable.write_shards(docs, path, shard_bytes=4000)
    got = sstable.with_starts(sstable.read_shards(spark, path)).orderBy("start").collect()
    library = Tokenizer.from_file(public_tokenizers.path(sstable.VOCABULARY))
    want = {}
    for i, t in rows_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have, start = {}, 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    sstable.write_manifest(spark, path)
    for wanted in ([3, 5, 10**12, None], [], [10**12], [7]):
        found = sorted(((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in sstable.lookup(spark, path, wanted)), key=repr)
        assert found == sorted(((i, n, crc) for i in wanted for n, crc in want.get(i, [])), key=repr)


def test_sstable_lookup_reads_few_bytes(spark, tmp_path):
    rng = random.Random(2)
    text = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=300)) + str(rng.random())) for i in range(3000)], "doc_id long, text string")
    path = f"file://{tmp_path}/large"
    sstable.write_shards(text, path)
    sstable.write_manifest(spark, path)
    row = spark.read.parquet(f"{path}/_manifest").first()
    assert (row.docs, row.low, row.high, row.nulls) == (3000, 0, 2999, 0)
    with sstable.FileRange(spark, row.file) as data:
        assert len(sstable.Shard(data).get(sstable.key_of(1234))) == 1
        assert data.read < len(data) / 3


def test_rows_equal_in_identifier_and_text_are_dealt_over_shards(spark, tmp_path):
    path = f"file://{tmp_path}/equal"
    rows = spark.createDataFrame([(7, "the same text again and again")] * 4000 + [(8, "other")], "doc_id long, text string").repartition(4)
    sstable.write_shards(rows, path, shard_bytes=40_000)
    sstable.write_manifest(spark, path)
    assert spark.read.parquet(f"{path}/_manifest").filter("low = 7").count() > 3
    assert len(sstable.lookup(spark, path, [7])) == 4000 and len(sstable.lookup(spark, path, [8])) == 1
    starts = [r.start for r in sstable.with_starts(sstable.read_shards(spark, path)).collect()]
    assert len(set(starts)) == 4001 and min(starts) == 0


def test_sstable_of_an_empty_table(empty, spark, tmp_path):
    path = f"file://{tmp_path}/none"
    sstable.write_shards(empty, path)
    assert sstable.with_starts(sstable.read_shards(spark, path)).count() == 0


def test_sstable_parts():
    writer = sstable.ShardWriter(7, block_bytes=64)
    data = b"".join(p + b"\n" for i in range(-50, 50) for p in writer.add(sstable.key_of(i), np.array([i + 50, 70000], dtype=np.uint32)))
    data += b"".join(p + b"\n" for p in writer.close())
    shard = sstable.Shard(data)
    assert len(shard.blocks) > 3 and shard.docs == 100 and shard.ids == 200
    assert [sstable.identifier_of(k) for k, _ in shard.scan()] == list(range(-50, 50))
    assert shard.get(sstable.key_of(-3))[0].tolist() == [47, 70000] and shard.get(sstable.key_of(1000)) == []
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Shard(data[:9] + bytes([data[9] ^ 1]) + data[10:]).scan())


# 3


def test_bpe_equals_the_library(docs):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    got = by_id(bpe.digests(docs))
    for i, t in rows_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert want in {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[i]}


def test_bpe_pairs_and_random_texts():
    codec, words = bpe._codec(public_tokenizers.path(bpe.VOCABULARY))
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the", "in", "aaa", " ", "er", "<|endoftext|>", "  ", "\n\n", "'s", "!!", "é", "中", "7", "²", "\x1c"]) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x2FF), rng.randrange(0x300, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    assert [x.tolist() for x in words.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids = [[rng.randrange(50257) for _ in range(9)] for _ in range(500)]
    assert [codec.decode(i) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]
    a, b = (np.array([rng.choice(list(codec.by_bytes.values())) for _ in range(3000)]) for _ in range(2))
    want = [codec.merge(codec.tokens[x] + codec.tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert codec.compatible(a, b).tolist() == want


def test_bpe_long_words_and_round_trip(docs, empty):
    codec, _ = bpe._codec(public_tokenizers.path(bpe.VOCABULARY))
    for word in (b"ab" * 400, b"thing" * 100, bytes(range(256)) * 2, b"a" * 999):
        ids = [codec.byte_id[x] for x in word]
        slow = list(ids)
        while True:
            best = min(((codec.rank.get(p, bpe.NEVER), i) for i, p in enumerate(zip(slow, slow[1:]))), default=(bpe.NEVER, 0))
            if best[0] == bpe.NEVER:
                break
            slow[best[1] : best[1] + 2] = [codec.product[best[0]]]
        assert codec._merge_long(ids) == slow
    assert bpe.round_trip(docs, docs.columns).count() == docs.count()
    assert all(r.decoded == (r.text or "") for r in bpe.decode(bpe.encode(docs, ["doc_id", "text"])).collect())
    assert bpe.round_trip(empty, empty.columns).count() == 0


# 5


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
    return row[-1]


def brute_leaks(items, text, share=0.2):
    words, out = decontaminate.words_of(text), set()
    for i, t in items:
        own = decontaminate.words_of(t)
        k = int(len(own) * share + 1e-9)
        if own and any(edit_distance(own, words[a:b]) <= k for a in range(len(words)) for b in range(a + max(1, len(own) - k), min(len(words), a + len(own) + k) + 1)):
            out.add(i)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 18)))) for i in range(12)] + [(90, ""), (91, None)]
    texts = []
    for n in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 15))
        if n % 2:
            leak = rng.choice(items[:12])[1].split()
            for _ in range(rng.randint(0, int(len(leak) * 0.2) + 1)):
                leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            words += [w.upper() for w in leak] + rng.choices(vocabulary, k=rng.randint(0, 10))
        texts.append(", ".join(words))
    texts += [None, "", "!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items + items[:2], "item_id long, text string")
    for blocks in (100, 4):
        found = by_id(decontaminate.find_leaks(docs, table, block_items=blocks))
        got = {i: {x.item_id for x in rs[0].leaks} for i, rs in found.items()}
        want = {i: brute_leaks([x for x in items if x[1]], t) for i, t in enumerate(texts)}
        extra = {i: got[i] - want[i] for i in want if got[i] - want[i]}
        assert not extra
        assert sum(len(got[i]) for i in want) >= 0.97 * sum(map(len, want.values()))
    kept = {r.doc_id for r in decontaminate.decontaminate(docs, table).collect()}
    assert kept == {i for i in got if not got[i]}


def test_verify_finds_the_best_passage():
    rng = random.Random(4)
    index = decontaminate.LeakIndex([(1, "a b c d e f g h i j")], 0.2, 8)
    for _ in range(200):
        text = np.array([rng.randint(0, 10) for _ in range(rng.randint(1, 16))])
        edits, begin, end = (int(v[0]) for v in index.verify(np.array([0]), [text]))
        own = index.codes[0].tolist()
        assert edits == min(edit_distance(own, text[a:b].tolist()) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        assert edit_distance(own, text[begin:end].tolist()) == edits


# 6


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, empty):
    rows = rows_of(docs)
    got = by_id(simhash.near_duplicates(docs))
    prints = {t: brute_fingerprint(t) for _, t in rows}
    for i, t in rows:
        assert prints[t] in {r.fp & (2**64 - 1) for r in got[i]}
    label = {t: t for _, t in rows}
    keys = list(label)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in keys:
        for b in keys:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, t in rows:
        if i is not None:
            least[root(t)] = min(i, least.get(root(t), i))
    for i, t in rows:
        assert least.get(root(t)) in {r.component_id for r in got[i]}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(docs).collect()
    assert len(kept) == len({root(t) for _, t in rows}) and simhash.deduplicate(empty).count() == 0


def test_deduplicate_links_at_jaccard_of_five_word_shingles(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(40, 300))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            changed = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                changed[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(changed))
    own = [sets(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    kept = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(label)


def test_links_of_clusters_in_small_cells(spark):
    rng = random.Random(8)
    values = set()
    for _ in range(15):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = np.array(sorted(values), dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = components.connected_components(simhash.near_links(df, cell=8)).collect()
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
    label = simhash._least_labels(len(values), a, b)
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node)
    want = {}
    for v, k in zip(values.view(np.int64).tolist(), label.tolist()):
        want.setdefault(k, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202), (202, 200)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}


# 7


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(words) < 400 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, None if covered is None else len(covered)


def test_quality_counts_and_verdicts(docs, empty):
    got = by_id(quality_rules.apply_quality_rules(docs))
    rows = [*rows_of(docs)]
    for i, t in rows:
        n, chars, symbols, dup, repeated = brute_counts(t)
        match = [r for r in got[i] if (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup) and repeated in (None, r.n_repeat_words)]
        assert match
        r = match[0]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.kept or not r.base_failed)
    assert quality_rules.apply_quality_rules(empty).count() == 0
    lines = "\n".join(["a b", "c d", "a b", "", "a b", " "])
    assert quality_rules.text_counts(lines)[3] == 2
    assert quality_rules.text_counts("é ü")[1] == 2
    for seed in range(30):
        rng = random.Random(seed)
        t = " ".join(rng.choices("ab", k=rng.randint(0, 60)))
        assert quality_rules.text_counts(t)[4] == brute_counts(t)[4]


# 8


def test_secret_base_spans():
    text = 'x Password: "abcdefgh1" api-key=zz password=token:abcdefgh1 AKIAABCDEFGHIJKL AKIAAB ' + "0" * 32 + " " + "f" * 31 + " ſecret=abcdefghij é SECRET =  'q1w2e3r4t5'"
    found = [(secret_scan.KINDS[k], text[s:e]) for s, k, e in secret_scan.base_spans(text)]
    assert found == [("assign", 'Password: "abcdefgh1'), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0" * 32), ("assign", "SECRET =  'q1w2e3r4t5")]


def test_secret_scan_and_redaction(docs, empty, spark):
    ratio = secret_scan.train(secret_scan.labelled_tokens(docs))
    rng = random.Random(3)
    secrets = ["".join(rng.choices(secret_scan.ALPHABET[:62], k=40)) for _ in range(200)]
    threshold = secret_scan.calibrated(ratio)
    assert (secret_scan.mean_ratio(secrets, ratio) > threshold).mean() > 0.95
    plain = ["internationalization", "getElementsByClassName", "configuration-management", "averyveryverylongidentifiername"]
    assert (secret_scan.mean_ratio(plain, ratio) < threshold).all()
    text = f"see {secrets[0]} and token = {secrets[1]} here"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    r = by_id(secret_scan.scan(df, ratio))
    assert [x.kind for x in r[1][0].found] == ["markov", "assign"] and r[1][0].n_assign == 1 and r[2][0].spans == "" == r[3][0].spans
    clean = {x.doc_id: x.text for x in secret_scan.redact(df, ratio).collect()}
    assert clean == {1: "see <SECRET> and <SECRET> here", 2: None, 3: ""}
    assert secret_scan.scan(empty, ratio).count() == 0 and secret_scan.redact(docs, ratio).count() == docs.count()


# 9


def test_language_models_are_distributions():
    words = {"en": langid.words_of("the cat sat on the mat and the dog ran"), "de": langid.words_of("der hund und die katze sind nicht hier")}
    models = langid.fit_models({k: langid.gram_counts(w, 3) for k, w in words.items()}, 3)
    for order in models.orders:  # over the letters that follow a context, and what backs off, probabilities add up to one
        assert (order.probability >= 0).all() and (order.probability <= 1).all() and (order.backoff <= 1).all()
    first = models.orders[0]
    np.testing.assert_allclose(first.probability.sum(axis=0) + first.backoff[0] * models.floor, 1.0)
    bits = langid.bits_of_words(models, ["the", "der", "xyz", ""])
    en, de = models.languages.index("en"), models.languages.index("de")
    assert bits[0, en] < bits[0, de] and bits[1, de] < bits[1, en] and np.isfinite(bits).all()


def test_language_id(spark, docs, empty):
    rng = random.Random(0)
    make = lambda ws: " ".join(rng.choices(ws, k=30))
    own = {"en": "the of and that with this from have which their".split(), "de": "der die und nicht mit auch eine werden sich oder".split()}
    rows = [(i, make(own[lang]), lang) for i in range(200) for lang in own if (i % 2 == 0) == (lang == "en")]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "", None), (902, "123 !!", "de"), (903, make(own["en"]), None)], "doc_id long, text string, lang string")
    models = langid.train(df)
    got = by_id(langid.identify(df, models))
    assert all(got[i][0].lang_pred == lang and not got[i][0].rejected for i, _, lang in rows)
    assert [got[i][0].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    foreign = spark.createDataFrame([(1, "こんにちは世界 これはテストです " * 5), (2, make(own["en"]))], "doc_id long, text string")
    assert [r.doc_id for r in langid.keep_identified(foreign, models).collect()] == [2]
    assert langid.identify(empty, models).count() == 0 and langid.train(empty) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_unlearned_languages_are_rejected_in_spite_of_junk(spark):
    rng = random.Random(6)
    own = {
        "en": "the of and that with this from have which their government people school health children between national country before important would during".split(),
        "de": "der die und nicht mit auch eine werden sich oder regierung menschen schule gesundheit kinder zwischen land vor wichtig würde während jahr".split(),
    }
    letters = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))
    make = lambda ws: " ".join(rng.choices(ws, k=60))
    rows = [(i, letters(60) if i % 100 < 3 else make(own[lang]), lang) for i in range(1000) for lang in own if (i % 2 == 0) == (lang == "en")]
    foreign = [
        "il governo italiano ha annunciato una nuova legge che prevede importanti riforme nel settore della scuola e della sanità pubblica entro la fine dell anno " * 2,
        "hallitus ilmoitti tänään uudesta laista jonka tarkoituksena on uudistaa koulutusta ja terveydenhuoltoa koko maassa ennen vuoden loppua",
        "rząd ogłosił dzisiaj nową ustawę która przewiduje ważne reformy w szkolnictwie oraz w publicznej służbie zdrowia przed końcem roku",
        letters(40),
    ]
    schema = "doc_id long, text string, lang string"
    models = langid.train(spark.createDataFrame(rows, schema))
    mine = [(i, make(own[lang]), lang) for i, lang in enumerate(("en", "de") * 20)] + [(40, make(own["en"]) + " token = b64b244acde2e3b0aa8f051af1ec018ebaba3add", "en")]
    texts = spark.createDataFrame([*mine, *((100 + i, t, None) for i, t in enumerate(foreign))], schema)
    assert {r.doc_id for r in langid.keep_identified(texts, models).collect()} == {i for i, _, _ in mine}


# 10


def test_token_counts(docs, empty):
    scores = token_counts.piece_scores(public_tokenizers.path(token_counts.VOCABULARY))
    trie = token_counts.PieceTrie(scores)

    def brute(word):
        word = token_counts.SPACE + word
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            size = len(word[j - 1].encode())
            options = [(-(best[j - 1][0] + size * trie.byte_score), best[j - 1][1] + size)]
            options += [(-(best[i][0] + scores[word[i:j]]), best[i][1] + 1) for i in range(max(0, j - trie.longest), j) if word[i:j] in scores]
            s, t = min(options)
            best.append((-s, t))
        return best[-1][1]

    got = by_id(token_counts.count_tokens(docs))
    for i, t in rows_of(docs):
        words = token_counts.WORD.findall(t or "")
        assert (len(words), sum(map(brute, words))) in {(r.n_pretokens, r.n_tokens) for r in got[i]}
    small = token_counts.PieceTrie(scores, most_nodes=10)
    assert [small.count([t])[0] for t in ("the cat", "the cat sat", None)] == trie.count(["the cat", "the cat sat", None])
    assert token_counts.count_tokens(empty).count() == 0


# all


def test_extra_columns_with_the_names_of_results(spark):
    df = spark.createDataFrame([(1, "some text here", 1, "x", 2.0, 3)], "doc_id long, text string, ids int, fp string, score double, leaks int")
    items = spark.createDataFrame([(1, "never said words at all")], "item_id long, text string")
    ratio = secret_scan.train(secret_scan.labelled_tokens(df))
    assert simhash.near_duplicates(df).columns == ["fp", "doc_id", "component", "component_id"]
    assert decontaminate.decontaminate(df, items).columns == df.columns and simhash.deduplicate(df).columns == df.columns
    assert secret_scan.redact(df, ratio).columns == df.columns
    assert bpe.encode(df, ["doc_id", "ids"]).columns == ["doc_id", "ids"]
    assert decontaminate.find_leaks(df, items, ["doc_id", "leaks"]).columns == ["doc_id", "leaks"]


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))
