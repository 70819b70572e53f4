"""Secret scans: fixed patterns, and Markov models of characters for what they miss.

Base spans come from three patterns (assignments, access keys, hexadecimal runs). The
method adds tokens that look random: a first-order Markov model of characters
is trained on random strings and another on ordinary identifiers, and a token is
a secret when the mean log-likelihood ratio a character passes a threshold. Tokens of
``LEAST`` characters or more with a letter are judged; shorter ones are too close to
ordinary names, and digits alone are numbers.

The models learn from labelled samples, a table of (token, label). ``labelled_tokens``
makes one from a corpus: values of base spans and seeded random strings are label 1;
words clear of base spans, seeded identifiers and seeded technical tokens (paths,
versions, dates, UUIDs, host names, names with numbers, repeats, runs of the alphabet or
of a keyboard) are label 0, from at most ``max_docs`` documents by hash. Transition
counts are summed by Spark; the models are two square tables. The threshold lies half-way
between the scores of ordinary tokens (their 99.9th percentile) and of random strings
(their first percentile), made of words and by seeds that took no part in the counts.
Random strings of hexadecimal digits shorter than 32 look like UUIDs and the numbers of
commits, and are left.

Defined cases: null and empty texts have no spans; overlapping spans of different kinds
all stay, but a token that overlaps a base span is not added; repeated rows give equal
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm.common import hash_share, map_text, read_table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A maximal run is what the base pattern matches; runs that are too short are dropped by it anyway.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 16  # characters of a token that the models judge
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
LETTER = re.compile(r"[A-Za-z]")
WORDS = re.compile(r"[A-Za-z0-9+/_=-]{4,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PLACE = np.full(128, 0, dtype=np.int64)
PLACE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
STATES = len(ALPHABET) + 1  # 0 is the start


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted. Places are code points; the end is exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def uncovered_tokens(text: str, spans: list[tuple[int, int, int]], pattern: re.Pattern = TOKEN) -> list[tuple[int, int]]:
    """Tokens with a letter, clear of base spans; unless told otherwise those long enough for the models to judge."""
    starts, ends, reach = [s for s, _, _ in spans], [], 0
    for _, _, e in spans:
        reach = max(reach, e)
        ends.append(reach)
    found = []
    for m in pattern.finditer(text):
        i = bisect_left(starts, m.end())  # spans that start before the token's end
        if (not i or ends[i - 1] <= m.start()) and LETTER.search(m[0]):
            found.append(m.span())
    return found


def transitions(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat transition numbers of the tokens' characters, and the token each belongs to."""
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    codes = PLACE[np.frombuffer("".join(tokens).encode("ascii"), dtype=np.uint8)]
    before = np.concatenate([[0], codes[:-1]]) if len(codes) else codes
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    return before * STATES + codes, np.repeat(np.arange(len(tokens)), lengths)


def fit_ratio(random_counts: np.ndarray, ordinary_counts: np.ndarray, soft: float = 0.5, weight: float = 5.0) -> np.ndarray:
    """Log-likelihood ratio of each transition: random strings over ordinary identifiers.

    A transition's probability is interpolated with the character's own, which counts as
    ``weight`` observations, so contexts that a label never showed fall back on it.
    """

    def log_model(flat):
        table = flat.reshape(STATES, STATES)[:, 1:].astype(float)
        own = table.sum(axis=0) + soft
        own /= own.sum()
        return np.log((table + weight * own) / (table.sum(axis=1, keepdims=True) + weight))

    ratio = np.zeros((STATES, STATES))
    ratio[:, 1:] = log_model(random_counts) - log_model(ordinary_counts)
    return ratio.ravel()


def mean_ratio(tokens: list[str], ratio: np.ndarray) -> np.ndarray:
    """Mean log-likelihood ratio a character of each token."""
    if not tokens:
        return np.zeros(0)
    flat, owner = transitions(tokens)
    return np.bincount(owner, weights=ratio[flat], minlength=len(tokens)) / np.maximum(np.bincount(owner, minlength=len(tokens)), 1)


def random_strings(n: int = 2000, seed: int = 7) -> list[str]:
    """Seeded strings over letters and digits, hexadecimal, and base-64 letters, 20 to 64 long."""
    rng = random.Random(seed)
    sets = (ALPHABET[:62], "0123456789abcdef", ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62])
    return ["".join(rng.choices(sets[i % 4], k=rng.randint(20, 64))) for i in range(n)]


# Words that identifiers are made of.
IDENTIFIER_WORDS = (
    "get set add remove find make build read write load store parse format check test run start stop open close send receive update delete create "
    "user name file path list item index count value key type class element document table column row table query result config option default "
    "internal external global national configuration management average long identifier very support server client request response message error"
).split()


def ordinary_identifiers(n: int = 4000, seed: int = 7) -> list[str]:
    """Seeded identifiers of one to five words in camel, snake, kebab and upper case."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(IDENTIFIER_WORDS, k=rng.randint(1, 5))
        styles = (words[0] + "".join(w.title() for w in words[1:]), "_".join(words), "-".join(words), "_".join(words).upper(), "".join(words))
        out.append(styles[i % 5])
    return out


# Words of technical tokens, for training and, others, for the threshold.
HELD_OUT_WORDS = (
    "alpha kernel socket thread buffer device module driver packet router gateway cluster replica schema vector matrix invoice ledger payment account "
    "applications share project zones instances dashboard firefox widget branch commit sensor camera orders shipping"
).split()
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
DIGITS_LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"


def technical_tokens(n: int = 400, seed: int = 7, words: tuple | list = IDENTIFIER_WORDS) -> dict[str, list[str]]:
    """Seeded tokens of each ordinary kind that has digits, slashes, capitals or repeats: ``n`` of each."""
    rng = random.Random(seed)
    word = lambda: rng.choice(words)
    number = lambda most: str(rng.randint(0, most))
    hexadecimal = lambda k: "".join(rng.choices(DIGITS_LETTERS[:16], k=k))
    several = lambda sep, make, a, b: sep.join(make() for _ in range(rng.randint(a, b)))
    kinds = {
        "path": lambda: rng.choice(("", "/", "/usr/local/", "v1/", "src/")) + several("/", lambda: word() + rng.choice(("", number(99), "_" + word(), "-" + word())), 3, 6),
        "version": lambda: word() + rng.choice("-_") + rng.choice(("v", "", "r")) + several(rng.choice("-_"), lambda: number(40), 2, 4) + rng.choice(("", "-" + word(), "-rc" + number(9))),
        "date": lambda: f"{word()}-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" + rng.choice(("", f"T{rng.randint(0, 23):02}-{rng.randint(0, 59):02}-{rng.randint(0, 59):02}Z")),
        "uuid": lambda: "-".join(hexadecimal(k) for k in (8, 4, 4, 4, 12)),
        "host": lambda: f"{word()}-{word()}-{rng.choice(('eu', 'us', 'asia'))}-{rng.choice(('west', 'east', 'north'))}{number(9)}-{rng.choice('abc')}-{rng.randint(1, 99):02}",
        "numbered": lambda: rng.choice("_-").join((word(), number(10 ** rng.randint(2, 8)), word() + number(99))),
        "instance": lambda: "-".join((word(), word(), hexadecimal(rng.choice((8, 10))), "".join(rng.choices(DIGITS_LETTERS, k=5)))),
        "code": lambda: several(rng.choice("-_"), lambda: rng.choice((word().upper(), word().upper() + number(99), number(9999), word() + number(64))), 3, 5),
        "repeat": lambda: rng.choice("AaxX0_=-") * rng.randint(16, 40) + rng.choice(("", "A", "x")),
        "sequence": lambda: (rng.choice((DIGITS_LETTERS, DIGITS_LETTERS[:16])) * 5)[rng.randrange(16) :][: rng.randint(16, 40)],
        "keyboard": lambda: "".join(rng.sample(KEY_ROWS, 3))[: rng.randint(16, 26)],
        "camel": lambda: word() + several("", lambda: word().title() + rng.choice(("", number(99))), 2, 5),
    }
    return {kind: [make() for _ in range(n)] for kind, make in kinds.items()}


def labelled_tokens(docs: DataFrame, max_docs: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, label) from about ``max_docs`` documents at most, chosen by hash of the identifier, and the seeded samples."""
    total = docs.count()
    drawn = docs if total <= max_docs else docs.filter(hash_share(id_col, "secrets") < max_docs / total)

    def make():
        def run(texts):
            out = []
            for text in texts:
                text = text or ""
                spans = base_spans(text)
                values = [ASSIGN.match(text, s)[2] if k == 0 else text[s:e] for s, k, e in spans]
                words = [text[a:b] for a, b in uncovered_tokens(text, spans, WORDS)]
                out.append([{"token": re.sub(r"[^A-Za-z0-9+/_=-]", "", v), "label": 1} for v in values] + [{"token": w, "label": 0} for w in words])
            return {"found": out}

        return run

    kind = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("label", T.IntegerType())]))
    found = map_text(drawn, make, [T.StructField("found", kind)], [id_col], text_col).select(F.explode("found").alias("x")).select("x.token", "x.label").distinct()
    technical = [t for tokens in technical_tokens().values() for t in tokens]
    seeded = docs.sparkSession.createDataFrame([(t, 1) for t in random_strings(4000)] + [(t, 0) for t in ordinary_identifiers() + technical], "token string, label int")
    return found.filter("length(token) > 0").unionByName(seeded)


def train(labelled: DataFrame) -> np.ndarray:
    """The ratio table from (token, label): transition counts are added up by Spark, one row a transition and label."""

    def count(batches):
        for batch in batches:
            rows = batch.to_pydict()
            for label in (0, 1):
                flat, _ = transitions([t for t, k in zip(rows["token"], rows["label"]) if k == label])
                ids, n = np.unique(flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), label, np.int32)), pa.array(ids), pa.array(n)], names=["label", "move", "n"])

    clean = labelled.select(F.regexp_replace("token", r"[^A-Za-z0-9+/_=\-]", "").alias("token"), F.col("label").cast("int").alias("label"))
    added = clean.filter("length(token) > 0").mapInArrow(count, "label int, move long, n long").groupBy("label", "move").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, STATES * STATES))
    for r in added:
        counts[r["label"], r["move"]] = r["n"]
    return fit_ratio(counts[1], counts[0])


def calibrated(ratio: np.ndarray, seed: int = 8) -> float:
    """The threshold between ordinary tokens and random strings of ``LEAST`` characters, none of which was trained on.

    The ordinary ones are identifiers and technical tokens of other words; the random
    ones are those of letters and digits of any kind. Hexadecimal digits alone aren't
    judged by the models' threshold: up to 31 of them are an identifier, more a base span.
    """
    technical = [t for tokens in technical_tokens(2000, seed, HELD_OUT_WORDS).values() for t in tokens]
    ordinary = mean_ratio([t for t in ordinary_identifiers(8000, seed) + technical if TOKEN.fullmatch(t) and LETTER.search(t)], ratio)
    drawn = mean_ratio([t[:LEAST] for i, t in enumerate(random_strings(4000, seed)) if i % 4 != 1], ratio)
    return float((np.quantile(ordinary, 0.999) + np.quantile(drawn, 0.01)) / 2)


def find_spans(text: str | None, ratio: np.ndarray, threshold: float) -> tuple[list, list]:
    """Base spans, and all spans: base and those that the models add."""
    if not text:
        return [], []
    base = base_spans(text)
    places = uncovered_tokens(text, base)
    scores = mean_ratio([text[a:b] for a, b in places], ratio)
    return base, sorted(base + [(a, 3, b) for (a, b), s in zip(places, scores) if s > threshold])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ratio: np.ndarray, keep: list[str] | None = None, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns and ``found``: (kind, start, end) of every span, and the base digest columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    threshold = calibrated(ratio) if threshold is None else threshold
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def make():
        def run(texts):
            both = [find_spans(t, shared.value, threshold) for t in texts]
            counts = {f"n_{name}": [sum(s[1] == k for s in base) for base, _ in both] for k, name in enumerate(KINDS[:3])}
            return counts | {
                "base_sha256": [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both],
                "spans": [_joined(spans) for _, spans in both],
                "found": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for _, spans in both],
            }

        return run

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("found", kind)]
    return map_text(docs, make, fields, keep, text_col)


def redact(docs: DataFrame, ratio: np.ndarray, threshold: float | None = None, mark: str = "<SECRET>", text_col: str = "text") -> DataFrame:
    """The same rows and columns with each run of overlapping spans replaced by ``mark``; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    threshold = calibrated(ratio) if threshold is None else threshold

    def clean(text):
        spans = find_spans(text, shared.value, threshold)[1]
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:] if spans else text

    def make():
        return lambda texts: {"__clean": [clean(t) for t in texts]}

    order = docs.columns
    found = map_text(docs, make, [T.StructField("__clean", T.StringType())], [c for c in order if c != text_col], text_col)
    return found.withColumnRenamed("__clean", text_col).select(*order)


def op8_secret_scan(spark, sf_dir) -> DataFrame:
    """Base counts, base digest and all spans of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(labelled_tokens(docs))).drop("found")
