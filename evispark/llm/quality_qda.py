"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed counts (logarithms of lengths and of
smoothed shares). Training gathers, by class, the number of rows, the sums and the sums
of products of these vectors, merged by Spark; the driver gets those sums only. Class
covariances are shrunk toward the pooled covariance and that toward its mean variance.
The score is the logistic of the difference of log densities and log priors, with
Mahalanobis distances through Cholesky factors computed once and shipped with the model.

Defined cases: null and empty texts have the vector of no words and get a score like any
other; rows without a label are not learned from; equal label rows count once, however
often they occur, which bounds the sample; if a class has no row, all texts get the share
of class 1 (one half without any label); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm.common import fold, hash_share, map_text, read_table

FEATURES = (
    "words", "word_length", "longest_word", "distinct_words", "adjacent_repeats", "capitals",
    "digits", "symbols", "other_punctuation", "sentence_marks", "lines", "repeated_lines", "non_ascii",
)

_keep = lambda chars: bytes(b for b in range(256) if b not in chars)
_UPPER = _keep(bytes(range(65, 91)))
_DIGITS = _keep(bytes(range(48, 58)))
_SYMBOLS = _keep(b"#*$%&|<>")
_OTHER = _keep(b"!\"'()+/:;=?@[\\]^_`{}~-")
_MARKS = _keep(b".,")
_HIGH = _keep(bytes(range(128, 256)))


def features(text: str | None) -> list[float]:
    """The vector of one text, in the order of FEATURES."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = len(words), len(data)
    chars = sum(map(len, words))
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    share = lambda part, whole, soft=0.5: float(np.log((part + soft) / (whole + 2 * soft)))
    return [
        float(np.log1p(n)),
        float(np.log1p(chars / max(n, 1))),
        float(np.log1p(max(map(len, words), default=0))),
        share(len(set(words)), n),
        share(sum(map(eq, words, words[1:])), n),
        share(len(data.translate(None, _UPPER)), size, 1.0),
        share(len(data.translate(None, _DIGITS)), size, 1.0),
        share(len(data.translate(None, _SYMBOLS)), size, 1.0),
        share(len(data.translate(None, _OTHER)), size, 1.0),
        share(len(data.translate(None, _MARKS)), size, 1.0),
        share(len(lines), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(len(data.translate(None, _HIGH)), size, 1.0),
    ]


@dataclass
class Discriminant:
    """Means, Cholesky factors and log densities' constants of the two classes."""

    means: np.ndarray
    factors: np.ndarray  # inverse of each lower Cholesky factor
    constants: np.ndarray  # log prior minus half the log determinant
    constant_score: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant_score is not None or not len(x):
            return np.full(len(x), self.constant_score if self.constant_score is not None else 0.5)
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            logs.append(self.constants[k] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, toward_pooled: float, toward_mean: float) -> Discriminant:
    """The discriminant from each class's number of rows, sums and sums of products."""
    if n.min() < 1:
        return Discriminant(sums, products, n, float((n[1] + 1e-9) / (n.sum() + 2e-9)))
    d = sums.shape[1]
    means = sums / n[:, None]
    scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    factors, constants = [], []
    for k in (0, 1):
        own = scatter[k] / n[k]
        shrunk = (1 - toward_pooled) * own + toward_pooled * pooled
        shrunk = (1 - toward_mean) * shrunk + toward_mean * np.trace(shrunk) / d * np.eye(d) + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def moments(labelled: DataFrame, label_col: str, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By class: rows, sums, and sums of products. Tasks send one row a class and batch, which Spark adds up."""
    d = len(FEATURES)

    def partial(batches):
        for batch in batches:
            rows = batch.to_pydict()
            label = np.array(rows["label"], dtype=np.int64)
            x = np.array([features(t) for t in rows["text"]]).reshape(-1, d)
            for k in (0, 1):
                own = x[label == k]
                flat = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["label", "part"])

    narrow = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"))
    parts = narrow.mapInArrow(partial, "label int, part array<double>")
    added = parts.select("label", F.posexplode("part")).groupBy("label", "pos").agg(F.sum("col").alias("value")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in added:
        flat[r["label"], r["pos"]] = r["value"]
    return flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_rows: int = 20_000, toward_pooled: float = 0.05, toward_mean: float = 0.01) -> Discriminant:
    """Fit on a sample, chosen by hash of the identifier, of about ``max_rows`` labelled rows at most."""
    labelled = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, label_col).distinct()
    total = labelled.count()
    if total > max_rows:
        labelled = labelled.filter(hash_share(id_col, "quality") < max_rows / total)
    sample = docs.select(id_col, "text").join(F.broadcast(labelled), id_col)  # the sample's size is bounded by max_rows
    return fit(*moments(sample, label_col), toward_pooled, toward_mean)


def classify(docs: DataFrame, model: Discriminant, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns, ``score`` (0 to 1) and ``predicted`` (1 from one half)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def run(texts):
            score = model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))
            return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return run

    return map_text(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep, text_col)


def op1_quality_classifier(spark, sf_dir) -> DataFrame:
    """The quality score of every document, learned from the labels of two folds of three."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold("doc_id", 3) != 1))
    scored = classify(docs, model)
    return scored.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False))).select("doc_id", "held_out", "score", "predicted")
