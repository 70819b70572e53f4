"""Learned models against brute force: discriminant scores, Kneser-Ney probabilities, likelihood ratios, and their defined cases."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

from evispark.llm import langid, quality_qda, secret_scan

# discriminant


def some_rows(n=200, seed=0):
    rng = np.random.default_rng(seed)
    label = (rng.random(n) < 0.7).astype(int)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) * (1 + label[:, None]) + 2 * label[:, None]
    return x, label


def test_discriminant_scores_equal_gaussian_densities():
    """Scores from densities written out with inverses and determinants of the shrunk covariances."""
    x, label = some_rows()
    n = np.array([(label == k).sum() for k in (0, 1)], dtype=float)
    sums = np.array([x[label == k].sum(axis=0) for k in (0, 1)])
    products = np.array([x[label == k].T @ x[label == k] for k in (0, 1)])
    model = quality_qda.fit(n, sums, products, 0.05, 0.01)
    own = [np.cov(x[label == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * m for c, m in zip(own, n)) / n.sum()
    density = []
    for k in (0, 1):
        shrunk = 0.95 * own[k] + 0.05 * pooled
        shrunk = 0.99 * shrunk + 0.01 * np.trace(shrunk) / 4 * np.eye(4) + 1e-6 * np.eye(4)
        d = x - x[label == k].mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", d, np.linalg.inv(shrunk), d)
        density.append(n[k] / n.sum() * np.exp(-distance / 2) / math.sqrt(np.linalg.det(shrunk)))
    np.testing.assert_allclose(model.score(x), density[1] / (density[0] + density[1]), rtol=1e-8)


def test_discriminant_cases(spark):
    docs = spark.createDataFrame([(1, "a b c", 9.0, 7), (1, "a b c", 9.0, 7), (2, None, 9.0, 7), (3, "", 9.0, 7), (None, "x " * 9000, 9.0, 7)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (9, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality_qda.train(docs, labels)
    rows = quality_qda.classify(docs, model, ["doc_id", "score"]).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    one_class = quality_qda.train(docs, labels.filter("quality = 1"))
    assert all(r.score > 0.99 for r in quality_qda.classify(docs, one_class).collect())


# language models


def brute_kneser_ney(words, order, alphabet_size):
    """p(letter | letters before) by the recursion, over counts in plain dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for word in words:
        marked = langid.START + word + langid.END
        for i in range(1, len(marked)):
            for n in range(1, order + 1):
                if n == order and i - n + 1 >= 0 or n < order and i - n + 1 == 0:
                    counts[n][marked[i - n + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):  # elsewhere: how many different letters stand before
        for gram in list(counts[n + 1]):
            counts[n][gram[1:]] += 1

    def discount(n):
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(letter, before):
        before = before[-(order - 1) :] if order > 1 else ""
        n = len(before) + 1
        below = p(letter, before[1:]) if before else 1 / alphabet_size
        row = [c for gram, c in counts[n].items() if gram[:-1] == before]
        if not row:
            return below
        d = discount(n)
        return (max(counts[n].get(before + letter, 0) - d, 0) + d * len(row) * below) / sum(row)

    return p


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_kneser_ney_equals_the_recursion(order):
    rng = random.Random(order)
    own = {lang: ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(80)] for lang, letters in (("aa", "abc"), ("bb", "bcd"))}
    models = langid.fit_models({lang: langid.gram_counts(words, order) for lang, words in own.items()}, order)
    size = len({c for words in own.values() for w in words for c in w} | {langid.END}) + 1
    tested = ["a", "abc", "dcb", "ccccc", "abxd", "bb"]
    bits = langid.bits_of_words(models, tested)
    for j, lang in enumerate(models.languages):
        p = brute_kneser_ney(own[lang], order, size)
        for i, word in enumerate(tested):
            marked = langid.START + word + langid.END
            want = -sum(math.log2(p(marked[k], marked[:k])) for k in range(1, len(marked)))
            assert abs(bits[i, j] - want) < 1e-6, (order, lang, word)


def test_kneser_ney_is_a_distribution():
    words = ["abab", "ba", "aab", "abba", "bab"]
    p = brute_kneser_ney(words, 3, 4)
    for before in (langid.START, langid.START + "a", "ab", "ba", "bb"):
        assert abs(sum(p(c, before) for c in ("a", "b", langid.END)) + p("?", before) - 1) < 1e-9


def test_letters_are_those_of_the_unicode_categories():
    """Against ``unicodedata``: number signs are no letters; marks stay with the letter before them."""
    signs = [chr(c) for c in range(0x30000) if chr(c).isalnum() and unicodedata.category(chr(c))[0] == "N"]
    assert "\u00bd" in signs and "\u2167" in signs and langid.words_of(" ".join(signs) + " _ \u0301") == []
    letters = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c))[0] == "L" and len(chr(c).lower()) == 1]
    assert langid.words_of(" ".join(letters)) == [c.lower() for c in letters]
    hindi = "\u0939\u093f\u0928\u094d\u0926\u0940"
    assert langid.words_of(f"{hindi} cafe\u0301, x\u00b2y") == [hindi, "cafe\u0301", "x", "y"]


def test_texts_of_number_signs_are_undetermined(spark):
    docs = spark.createDataFrame([(i, w * 20, "abcd"[i % 2]) for i, w in enumerate(["some words ", "andere worte "] * 10)], "doc_id long, text string, lang string")
    signs = spark.createDataFrame([(1, "\u00bd \u00b2 \u2167 12"), (2, "\u0301"), (3, None), (4, "words")], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(signs, langid.train(docs)).select("doc_id", "lang_pred", "score").collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] in ("a", "b")


def test_languages_without_labels_and_clashing_columns(spark):
    rows = [(i, "the cat and the dog of it" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", 1.0) for i in range(60)]
    schema = "doc_id long, text string, lang string, score double"
    docs = spark.createDataFrame(rows + [(1, rows[1][1], "en", 1.0), (None, None, None, None)], schema)
    unlabelled = docs.withColumn("lang", docs.lang.substr(9, 9)).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "score")
    assert langid.train(unlabelled) is None
    assert langid.keep_identified(unlabelled, langid.train(unlabelled)).count() == 62
    nameless = docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "score")
    models = langid.train(nameless)
    assert models is not None and models.languages == ["de", "en"]
    found = langid.identify(docs, models, ["doc_id", "lang", "score"]).collect()
    assert len(found) == 62 and all(r.lang_pred == r.lang for r in found if r.lang)
    assert [(r.lang_pred, r.score) for r in found if r.lang is None] == [("und", 0.0)]


# secrets


def test_likelihood_ratio_equals_the_models_written_out():
    rng = random.Random(2)
    samples = {1: ["".join(rng.choices("abXY01", k=12)) for _ in range(30)], 0: ["".join(rng.choices("abcd", k=9)) for _ in range(40)]}
    counts = {k: np.zeros(secret_scan.STATES**2) for k in samples}
    for k, tokens in samples.items():
        np.add.at(counts[k], secret_scan.transitions(tokens)[0], 1)
    ratio = secret_scan.fit_ratio(counts[1], counts[0])

    def log_p(tokens, token):
        pairs = Counter((a, b) for t in tokens for a, b in zip("^" + t, t))
        single, total = Counter(c for t in tokens for c in t), sum(map(len, tokens))
        n = len(secret_scan.ALPHABET)
        out = 0.0
        for a, b in zip("^" + token, token):
            own = (single[b] + 0.5) / (total + 0.5 * n)
            out += math.log((pairs[a, b] + 5 * own) / (sum(v for (x, _), v in pairs.items() if x == a) + 5))
        return out

    for token in ("abXY", "dcba", "zz9", "a", "Xa0d+"):
        want = (log_p(samples[1], token) - log_p(samples[0], token)) / len(token)
        assert abs(secret_scan.mean_ratio([token], ratio)[0] - want) < 1e-9


def test_threshold_parts_held_out_samples():
    ratio = None
    tokens = [(t, 1) for t in secret_scan.random_strings()] + [(t, 0) for t in secret_scan.ordinary_identifiers()]
    counts = [np.zeros(secret_scan.STATES**2) for _ in (0, 1)]
    for k in (0, 1):
        np.add.at(counts[k], secret_scan.transitions([t for t, label in tokens if label == k])[0], 1)
    ratio = secret_scan.fit_ratio(counts[1], counts[0])
    threshold = secret_scan.calibrated(ratio)
    drawn = [t[: secret_scan.LEAST] for t in secret_scan.random_strings(2000, seed=77)]
    plain = [t for t in secret_scan.ordinary_identifiers(9000, seed=77) if len(t) >= secret_scan.LEAST]
    assert (secret_scan.mean_ratio(drawn, ratio) > threshold).mean() > 0.98
    assert (secret_scan.mean_ratio(plain, ratio) > threshold).mean() < 0.002


def test_added_spans_of_a_text(spark):
    rng = random.Random(3)
    short, long_ = ("".join(rng.choices(secret_scan.ALPHABET[:62], k=n)) for n in (17, 30))
    text = f"plain words {short} 1234567890123456 getElementsByClassName {long_}"
    df = spark.createDataFrame([(1, text, "x", 3), (1, text, "x", 3), (2, None, "y", 4), (None, "", "z", 5)], "doc_id long, text string, spans string, n_hex int")
    ratio = secret_scan.train(secret_scan.labelled_tokens(df))
    rows = secret_scan.scan(df, ratio, ["doc_id", "spans"]).collect()
    want = ",".join(f"markov:{text.index(t)}:{text.index(t) + len(t)}" for t in (short, long_))
    assert sorted((r.doc_id or 0, r.spans) for r in rows) == [(0, ""), (1, want), (1, want), (2, "")]
    assert secret_scan.redact(df, ratio).columns == df.columns


def test_secret_models_leave_technical_tokens_and_find_random_ones(spark):
    """Precision and recall on words, kinds and lengths that were not trained on, with models learned from documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ratio = secret_scan.train(secret_scan.labelled_tokens(docs))
    threshold = secret_scan.calibrated(ratio)
    clean = (
        "/usr/local/share/applications/firefox v1/projects/my-project/zones/us-west1-b/instances ISO-8859-15_latin9-UTF8 0123456789abcdef0123 "
        "chr19-bp-20481-hg38-v2 kubernetes-dashboard-7b544877d5-xk2pq AAAAAAAAAAAAAAAAAAAAAAAA qwertyuiopasdfghjkl "
        "123e4567-e89b-12d3-a456-426614174000 2024-02-29T23-59-59Z-backup da39a3ee5e6b4b0d3255bfef95601890 linux-image-6_8_0-45-generic node_modules/lodash/fp/_baseConvert"
    ).split()
    base = {t: secret_scan.base_spans(t) for t in clean}
    assert not any(t for t in clean if secret_scan.find_spans(t, ratio, threshold)[1] != base[t])
    held_out = secret_scan.technical_tokens(500, 4321, "zebra quartz harbor lantern meadow orbit pigment saddle timber violet wander yonder".split())
    for kind, tokens in held_out.items():
        judged = [t for t in tokens if secret_scan.TOKEN.fullmatch(t) and secret_scan.LETTER.search(t)]
        marked = (secret_scan.mean_ratio(judged, ratio) > threshold).mean()
        assert marked < 0.02, (kind, marked)
    rng = random.Random(77)
    for letters in (secret_scan.ALPHABET[:62], secret_scan.ALPHABET[:64], secret_scan.ALPHABET[:26] + secret_scan.ALPHABET[52:62]):
        for length, least in ((16, 0.97), (24, 0.99), (40, 0.995)):
            secrets = ["".join(rng.choices(letters, k=length)) for _ in range(1000)]
            assert (secret_scan.mean_ratio(secrets, ratio) > threshold).mean() >= least, (len(letters), length)


def test_words_with_digits_are_ordinary_unless_a_pattern_holds_them(spark):
    text = "see src/main2/app_v3.py and token = Zk3Q9xW1pL7vR2tB8nMd or 12345678"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = {(r.token, r.label) for r in secret_scan.labelled_tokens(docs).collect()}
    assert ("src/main2/app_v3", 0) in found and ("Zk3Q9xW1pL7vR2tB8nMd", 1) in found and ("Zk3Q9xW1pL7vR2tB8nMd", 0) not in found
