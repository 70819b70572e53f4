"""Quality rules by weak supervision.

Each rule looks at one statistic of a whole text and votes good (1), bad (0) or
abstains (2). Expectation-maximisation over the counts of vote patterns estimates the
share of good documents and two accuracies of each rule: how often its votes on good
documents are good, and how often its votes on bad ones are bad. A document is kept when
the posterior probability that it is good reaches one half and the base rule does not
fail it, so a rule that often errs is outvoted, and one bad vote suffices only where the
rule proves reliable. Abstentions say nothing of the class.

Accuracies are learned from the documents: the prior that says that rules are better
than chance weighs as much as ``PRIOR_DOCS`` votes. Different rules see the same defect
from different sides (symbols, plain words, function words), which is what the estimate
lives on; no rule is a combination of others.

The pass over the texts runs once and leaves a few numbers a document. What the
estimation sees is one row for each vote pattern (3 to the number of rules at most),
whatever the size of the corpus.

Defined cases: a null text counts as no words (base_failed); an empty text likewise;
repeated rows are scored one by one and count as often as they occur in the estimate;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm.common import map_text, stored

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
ABSTAIN = 2
PLAIN = re.compile(rb"(?<![^\x20\x09-\x0d])[A-Za-z\x80-\xff]+[.,;:!?]?(?![^\x20\x09-\x0d])")
# Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that for it was with as on be by at der die und das den von zu mit sich des auf ist im nicht "
        "le la les et que dans une est pour qui par el los las del en por con una para y de un se"
    ).split()
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_adjacent", "n_plain", "n_stop")

_not_symbols = bytes(b for b in range(256) if b not in SYMBOLS)
_not_upper = bytes(b for b in range(256) if not 65 <= b <= 90)
_not_letters = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_continuation = bytes(range(128, 192))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    if len(index) > n + WINDOW - 2:
        return 0
    # Ranks of windows of 2, 4 and 8 words by doubling: equal rank means equal words.
    width = 1
    while width < WINDOW:
        codes = np.unique(codes[:-width] * (codes.max() + 1) + codes[width:], return_inverse=True)[1]
        width *= 2
    twice = np.bincount(codes)[codes] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = WORD.findall(data)
    joined = b"".join(words)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(joined.translate(None, _continuation)),
        len(data.translate(None, _not_symbols)),
        dup,
        repeated_words(words),
        lines,
        len(data.translate(None, _not_upper)),
        len(data.translate(None, _not_letters)),
        sum(a == b for a, b in zip(words, words[1:])),
        len(PLAIN.findall(data)),
        sum(map(STOP_WORDS.__contains__, words)),
    )


def count_texts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    def make():
        def run(texts):
            rows = [text_counts(t) for t in texts]
            return dict(zip(COUNTS, zip(*rows)))

        return run

    return map_text(docs, make, [T.StructField(c, T.LongType()) for c in COUNTS], keep, text_col)


def _vote(bad, good):
    return F.when(bad, 0).when(good, 1).otherwise(ABSTAIN)


def rule_votes() -> dict[str, F.Column]:
    """The rules: name and vote (0 bad, 1 good, 2 abstains) over the columns in COUNTS, each of one statistic."""
    n = F.col("n_words")
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    symbols, lines, repeats, adjacent = share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_adjacent", "n_words")
    length, upper, plain, stop = share("word_chars", "n_words"), share("n_upper", "n_letters"), share("n_plain", "n_words"), share("n_stop", "n_words")
    return {
        "length": _vote(n < 20, n >= 60),
        "symbols": _vote(symbols > 0.1, (n > 0) & (symbols <= 0.02)),
        "dup_lines": _vote((F.col("n_lines") >= 4) & (lines > 0.3), (F.col("n_lines") >= 4) & (lines <= 0.1)),
        "repeats": _vote(repeats > 0.2, (n >= 40) & (repeats <= 0.05)),
        "adjacent": _vote(adjacent > 0.1, (n >= 20) & (adjacent <= 0.05)),
        "word_length": _vote((n > 0) & ((length < 3) | (length > 7)), length.between(3.5, 6.5)),
        "capitals": _vote(upper > 0.3, (n > 0) & (upper <= 0.1)),
        "plain_words": _vote((n >= 10) & (plain < 0.7), (n >= 10) & (plain >= 0.85)),
        "stop_words": _vote((n >= 40) & (stop < 0.05), (n >= 40) & (stop >= 0.1)),
    }


#: What rules are believed to do before any document is seen: the share of right votes on bad and on good documents.
PRIOR_RIGHT, PRIOR_DOCS = (0.6, 0.9), 20.0


def estimate(patterns: np.ndarray, counts: np.ndarray, prior_docs: float = PRIOR_DOCS, rounds: int = 500, tol: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns.

    Returns the share of good documents, right[rule, class]: the estimated share of right
    votes among a rule's votes on bad (0) and good (1) documents, and the posterior of
    good for each pattern.
    """
    good, bad = (patterns == 1).astype(float), (patterns == 0).astype(float)
    prior = np.tile(PRIOR_RIGHT, (patterns.shape[1], 1))
    right, share, posterior = prior.copy(), 0.8, np.full(len(patterns), 0.8)
    for _ in range(rounds):
        as_good = np.log(share) + good @ np.log(right[:, 1]) + bad @ np.log(1 - right[:, 1])
        as_bad = np.log(1 - share) + bad @ np.log(right[:, 0]) + good @ np.log(1 - right[:, 0])
        new = 1 / (1 + np.exp(np.clip(as_bad - as_good, -700, 700)))
        moved, posterior = np.abs(new - posterior).max(initial=0.0), new
        if moved < tol:
            break
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        votes, hits = weight @ (good + bad), np.stack([weight[0] @ bad, weight[1] @ good])
        right = (hits.T + prior_docs * prior) / (votes.T + prior_docs)
        right = np.clip(right, 1e-9, 1 - 1e-9)
    return share, right, posterior


def apply_quality_rules(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The kept columns, COUNTS, ``votes`` (pattern), ``p_good``, ``base_failed`` and ``kept``."""
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    rules = rule_votes()
    pattern = F.concat(*(v.cast("string") for v in rules.values()))
    counted = stored(count_texts(docs, keep, text_col).withColumn("votes", pattern), "quality-counts")
    seen = sorted(counted.groupBy("votes").count().collect())  # a row for each pattern, 3 ** rules at most
    patterns = np.array([[int(x) for x in r["votes"]] for r in seen], dtype=np.int64).reshape(-1, len(rules))
    _, _, posterior = estimate(patterns, np.array([r["count"] for r in seen], dtype=float))
    rows = [(r["votes"], float(p)) for r, p in zip(seen, posterior)]
    verdicts = spark.createDataFrame(rows, "votes string, p_good double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        counted.join(F.broadcast(verdicts), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= threshold))
    )


def op7_quality_rules(spark, sf_dir) -> DataFrame:
    """Counts, base rule and verdict for every document."""
    from evispark.llm.common import read_table

    found = apply_quality_rules(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
