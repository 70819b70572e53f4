"""Language identification by interpolated Kneser-Ney character models.

One model a language over the letters of lower-cased words, each word between a start
and an end mark. Grams of all languages share sorted arrays of 64-bit hashes, with a
column of probabilities for each language; contexts have arrays of back-off weights
alongside. A text goes to the language with the lowest cross-entropy a letter. A text
is rejected when that cross-entropy lies above the language's own range, which is
measured on labelled documents that took no part in the counts: it ends half-way between
their median and the median of the same documents with their letters shuffled, or, for
very short texts, where the spread of the documents ends. Both are medians or quantiles
that junk among the documents does not move.

The fit uses a bounded sample: at most ``per_language`` documents a language are
expected, chosen by hash. Grams are counted by Spark over that sample and their types,
bounded by it, come to the driver as arrays. Scoring is one pass over the texts; each
task scores a distinct word once and keeps a bounded cache.

Defined cases: null texts and texts without a letter get ``und``, score 0 and are
rejected; equal cross-entropies go to the first language in sorted order; repeated rows
are scored alike; with no labelled document every text gets ``und`` and nothing is
rejected, as nothing is known of any language; labelled rows without an identifier are
drawn by their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm.common import filter_text, fold, hash_share, map_text, read_table

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")  # letters by category, so no number signs, with the marks that belong to them
START, END = "\x02", "\x03"
UNDETERMINED = "und"
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 200_000
WORDS_AT_ONCE = 8192


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def gram_counts(words: list[str], order: int) -> Counter:
    """Grams that end at each letter and at the end mark, as long as the order and the word's start allow."""
    found: Counter = Counter()
    for word, n in Counter(words).items():
        marked = START + word + END
        for i in range(1, len(marked)):
            found[marked[max(0, i - order + 1) : i + 1]] += n
    return found


def _mix(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def hash_grams(grams: list[str]) -> np.ndarray:
    """64-bit hashes of short strings: the same polynomial that scoring rolls along a word."""
    out = np.zeros(len(grams), dtype=np.uint64)
    lengths = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, n)
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            h = h * BASE + _mix(codes[:, k])
        out[at] = h
    return out


@dataclass
class Order:
    """Sorted hashes of one length: grams with probabilities, contexts with back-off weights, by language."""

    grams: np.ndarray
    probability: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class LanguageModels:
    languages: list[str]
    orders: list[Order]
    floor: np.ndarray  # probability of a letter never seen, by language
    usual: np.ndarray | None = None  # calibration: bits a letter, how far above it documents lie, and half-way to shuffled letters
    reach: np.ndarray | None = None
    halfway: np.ndarray | None = None


def _continuations(raw: Counter, order: int) -> list[dict[str, int]]:
    """Counts by gram length: raw at full length and at a word's start, else the number of distinct left letters."""
    levels: list[dict[str, int]] = [{} for _ in range(order + 1)]
    for gram, n in raw.items():
        levels[len(gram)][gram] = levels[len(gram)].get(gram, 0) + n
    for k in range(order, 1, -1):
        below = Counter(gram[1:] for gram in levels[k])
        for gram, n in below.items():
            levels[k - 1][gram] = levels[k - 1].get(gram, 0) + n
    return levels


def fit_models(counts: dict[str, Counter], order: int) -> LanguageModels:
    """Interpolated Kneser-Ney with one discount a length, from gram counts by language."""
    languages = sorted(counts)
    by_language = {lang: _continuations(counts[lang], order) for lang in languages}
    alphabet = {g for lang in languages for g in by_language[lang][1]}
    floor = np.full(len(languages), 1.0 / (len(alphabet) + 1))
    lower: dict[str, np.ndarray] = {}
    orders = []
    for k in range(1, order + 1):
        grams = sorted({g for lang in languages for g in by_language[lang][k]})
        p = np.zeros((len(grams), len(languages)))
        contexts = sorted({g[:-1] for g in grams})
        place = {c: i for i, c in enumerate(contexts)}
        gamma = np.ones((len(contexts), len(languages)))
        rows = np.fromiter((place[g[:-1]] for g in grams), dtype=np.int64, count=len(grams))
        for j, lang in enumerate(languages):
            level = by_language[lang][k]
            n = np.fromiter((level.get(g, 0) for g in grams), dtype=float, count=len(grams))
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = np.bincount(rows, weights=n, minlength=len(contexts))
            kinds = np.bincount(rows, weights=n > 0, minlength=len(contexts))
            seen = total > 0
            gamma[seen, j] = discount * kinds[seen] / total[seen]
            p[:, j] = np.maximum(n - discount, 0) / np.where(seen, total, 1)[rows]
        below = np.array([lower[g[1:]] for g in grams]).reshape(len(grams), len(languages)) if k > 1 else np.tile(floor, (len(grams), 1))
        p += gamma[rows] * below
        lower = dict(zip(grams, p))
        gram_hash, context_hash = hash_grams(grams), hash_grams(contexts)
        a, b = np.argsort(gram_hash), np.argsort(context_hash)
        orders.append(Order(gram_hash[a], p[a], context_hash[b], gamma[b]))
    return LanguageModels(languages, orders, floor)


def bits_of_words(models: LanguageModels, words: list[str]) -> np.ndarray:
    """Bits that each language's model needs for each word and its end mark."""
    if not words:
        return np.zeros((0, len(models.languages)))
    joined = "".join(START + w + END for w in words)
    codes = _mix(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(len(codes)) - np.repeat(starts, lengths)  # letters before each within its word
    p = np.tile(models.floor, (len(codes), 1))
    context = np.zeros(len(codes), dtype=np.uint64)  # hash of the k-1 letters before
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for k, order in enumerate(models.orders, start=1):
        context = np.concatenate([np.zeros(1, dtype=np.uint64), rolled[:-1]]) if k > 1 else context
        rolled = context * BASE + codes
        live = np.flatnonzero(inside >= k - 1)
        at = np.minimum(np.searchsorted(order.contexts, context[live]), len(order.contexts) - 1)
        known = order.contexts[at] == context[live]
        p[live[known]] *= order.backoff[at[known]]
        at = np.minimum(np.searchsorted(order.grams, rolled[live]), len(order.grams) - 1)
        known = order.grams[at] == rolled[live]
        p[live[known]] = order.probability[at[known]]
    bits = -np.log2(np.maximum(p, 1e-30))
    bits[inside == 0] = 0.0  # the start mark is given
    return np.add.reduceat(bits, starts, axis=0)


class Scorer:
    """Cross-entropies of texts; scores of distinct words are kept, up to a bound."""

    def __init__(self, models: LanguageModels):
        self.models, self.place, self.bits = models, {}, np.zeros((0, len(models.languages)))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter by language (end marks count as letters), and the number of letters."""
        if len(self.place) > CACHE_WORDS:
            self.place, self.bits = {}, self.bits[:0]
        lists = [words_of(t) for t in texts]
        new = list({w for words in lists for w in words if w not in self.place})
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        parts = [bits_of_words(self.models, new[a : a + WORDS_AT_ONCE]) for a in range(0, len(new), WORDS_AT_ONCE)]
        self.bits = np.concatenate([self.bits, *parts])
        out, letters = np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts), dtype=np.int64)
        for i, words in enumerate(lists):
            if words:
                letters[i] = sum(map(len, words)) + len(words)
                out[i] = self.bits[[self.place[w] for w in words]].sum(axis=0) / letters[i]
        return out, letters


def labelled_sample(docs: DataFrame, per_language: int, text_col: str, lang_col: str, id_col: str) -> DataFrame:
    """About ``per_language`` rows of each language, chosen by a hash of the identifier, so that copies are not chosen together."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row a language
    if not sizes:
        return labelled.limit(0).select(lang_col, text_col, F.lit(False).alias("held_back"))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))])
    keyed = labelled.withColumn("__key", F.coalesce(F.col(id_col).cast("string"), F.col(text_col)))
    drawn = keyed.filter(hash_share("__key", "sample") < F.element_at(share, F.col(lang_col)))
    return drawn.select(lang_col, text_col, (hash_share("__key", "held back") < 0.2).alias("held_back"))


def train(docs: DataFrame, order: int = 5, per_language: int = 1500, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModels | None:
    """Models and calibration from labelled rows; None where there is no labelled text."""
    sample = labelled_sample(docs, per_language, text_col, lang_col, id_col).withColumnsRenamed({lang_col: "lang_label", text_col: "text"}).persist()

    def grams(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pydict()
            found: dict[str, Counter] = {}
            for lang, text in zip(rows["lang_label"], rows["text"]):
                found.setdefault(lang, Counter()).update(gram_counts(words_of(text), order))
            flat = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
            lang, gram, n = zip(*flat) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    fit = sample.filter(~F.col("held_back")).select("lang_label", "text")
    table = fit.mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {}
    for lang, gram, n in zip(*(table.column(c).to_pylist() for c in ("lang", "gram", "n"))):
        counts.setdefault(lang, Counter())[gram] += n
    if not counts:
        sample.unpersist()
        return None
    models = fit_models(counts, order)
    _calibrate(models, sample, docs.sparkSession)
    sample.unpersist()
    return models


def shuffled_letters(text: str | None, seed: int = 9) -> str:
    """The text's words with all their letters in another order."""
    words = words_of(text)
    letters = [c for w in words for c in w]
    random.Random(seed).shuffle(letters)
    rest = iter(letters)
    return " ".join("".join(next(rest) for _ in w) for w in words)


def _root_of_length(letters: np.ndarray) -> np.ndarray:
    """What an excess is multiplied by in calibration and divided by in verdicts."""
    return np.sqrt(np.clip(letters, 1, 100))


def _calibrate(models: LanguageModels, sample: DataFrame, spark) -> None:
    """Median bits a letter of each language's held-back documents, how far above it most of them reach, and half the way to their shuffled letters."""
    shared = spark.sparkContext.broadcast(models)

    def make():
        scorer = Scorer(shared.value)

        def run(texts):
            bits, letters = scorer.entropies(texts)
            garbled, _ = scorer.entropies([shuffled_letters(t) for t in texts])
            return {"bits": list(bits), "garbled": list(garbled), "root": _root_of_length(letters), "letters": letters}

        return run

    bits_type = T.ArrayType(T.DoubleType())
    fields = [T.StructField("bits", bits_type), T.StructField("garbled", bits_type), T.StructField("root", T.DoubleType()), T.StructField("letters", T.LongType())]
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(models.languages) for x in (lang, i + 1)])
    mine = F.element_at(place, F.col("lang_label"))
    own = (
        map_text(sample.filter("held_back"), make, fields, ["lang_label"])
        .filter("letters > 0")
        .select("lang_label", "root", F.element_at("bits", mine).alias("own"), F.element_at("garbled", mine).alias("garbled"))
        .filter(F.col("own").isNotNull())
    )
    usual = own.groupBy("lang_label").agg(F.percentile_approx("own", F.lit(0.5)).alias("usual"), F.percentile_approx("garbled", F.lit(0.5)).alias("garbled_usual"))
    reach = own.join(F.broadcast(usual), "lang_label").groupBy("lang_label", "usual", "garbled_usual").agg(
        F.percentile_approx((F.col("own") - F.col("usual")) * F.col("root"), F.lit(0.95)).alias("reach"),
    )
    n = len(models.languages)
    models.usual, models.reach, models.halfway = np.full(n, np.inf), np.zeros(n), np.zeros(n)
    for r in reach.collect():
        i = models.languages.index(r["lang_label"])
        models.usual[i], models.reach[i], models.halfway[i] = r["usual"], max(r["reach"], 1.0), max(0.0, (r["garbled_usual"] - r["usual"]) / 2)


def verdicts(models: LanguageModels, scorer: Scorer, texts: list[str | None], slack: float):
    """Best language's place, posterior-like score, its bits a letter, whether the text has letters, and whether it is rejected."""
    bits, letters = scorer.entropies(texts)
    best = bits.argmin(axis=1)
    lowest = bits[np.arange(len(texts)), best]
    weight = np.exp2(-(bits - lowest[:, None]) * np.minimum(letters, 40)[:, None] / 4)
    limit = models.usual[best] + np.maximum(slack * models.reach[best] / _root_of_length(letters), models.halfway[best])
    some = letters > 0
    return best, np.where(some, 1 / weight.sum(axis=1), 0.0), lowest, some, ~some | (lowest > limit)


def identify(docs: DataFrame, models: LanguageModels | None, keep: list[str] | None = None, text_col: str = "text", slack: float = 1.5) -> DataFrame:
    """The kept columns, ``lang_pred``, ``score`` (0 to 1), ``bits`` (cross-entropy a letter) and ``rejected``.

    A text is rejected where its bits exceed the calibrated median by more than half the
    way to shuffled letters and by more than ``slack`` times the reach seen in
    calibration, divided by the root of its length in letters (100 at most).
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        models = shared.value
        scorer = Scorer(models) if models else None

        def run(texts):
            n = len(texts)
            if scorer is None:
                return {"lang_pred": [UNDETERMINED] * n, "score": [0.0] * n, "bits": [None] * n, "rejected": [False] * n}
            best, score, lowest, some, rejected = verdicts(models, scorer, texts, slack)
            return {
                "lang_pred": [models.languages[b] if s else UNDETERMINED for b, s in zip(best, some)],
                "score": score,
                "bits": [float(x) if s else None for x, s in zip(lowest, some)],
                "rejected": rejected,
            }

        return run

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return map_text(docs, make, fields, keep, text_col)


def keep_identified(docs: DataFrame, models: LanguageModels | None, slack: float = 1.5, text_col: str = "text") -> DataFrame:
    """The rows, with their columns, whose text is not rejected; all rows where there is no model."""
    if models is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        models = shared.value
        scorer = Scorer(models)
        return lambda texts: ~verdicts(models, scorer, texts, slack)[4]

    return filter_text(docs, make, text_col)


def op9_language_id(spark, sf_dir) -> DataFrame:
    """The predicted language of every document, learned from the three folds of four that may be learned from."""
    docs = read_table(spark, sf_dir, "documents")
    models = train(docs.filter(fold("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), models)
    return found.withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "bits", "rejected")
