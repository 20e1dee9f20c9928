"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile.

A document's score is a linear function of its features. For a pair in which the first
document is preferred, the model's probability is the logistic function of the difference
of their scores; the weights minimise the logistic loss on feature differences. The cut is
the score quantile at the share of rows in the training labels that are not preferred.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, in_arrow, table

#: Labelled rows learned from, at most, and preference pairs drawn from them.
TRAIN_ROWS, PAIRS = 20_000, 200_000
#: predicted is 1 from this score on; the quantile cut is mapped to it.
ACCEPT = 0.3
#: Texts of few words tell little: their standardised features shrink by n / (n + SHRINK).
SHRINK = 4
FEATURES = (
    "log_words", "letters", "upper", "digits", "symbols", "markup", "repeats", "repeated_lines", "distinct", "distinct_scaled",
    "top3", "word_length", "upper_words", "exclamations", "distinct_pairs", "stops", "short_words",
)
MARKUP = "|%$#&*{}<>=_~^\\"


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 upper-case letter, 3 digit, 4 blank."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = 2 if ch.isupper() else 1
        elif ch.isdigit():
            out[c] = 3
        elif ch.isspace():
            out[c] = 4
    return out


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; null and empty texts have zeros."""
    text = text or ""
    w = text.split()
    if not w:
        return [0.0] * len(FEATURES)
    n = len(w)
    kinds = np.zeros(5, np.int64)
    for at in range(0, len(text), 1 << 20):
        kinds += np.bincount(_kinds()[np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=5)
    size, letters = len(text), int(kinds[1] + kinds[2])
    low = text.lower().split()
    count = Counter(low)
    lines = text.split("\n")
    return [
        log(1 + n), letters / size, kinds[2] / max(letters, 1), kinds[3] / size, kinds[0] / size, sum(map(text.count, MARKUP)) / n, sum(map(eq, w, w[1:])) / n,
        1 - len(set(lines)) / len(lines), len(count) / n, len(count) / n**0.7, sum(sorted(count.values())[-3:]) / n, (size - kinds[4]) / n, sum(map(str.isupper, w)) / n,
        text.count("!") / n, len(set(zip(low, low[1:], strict=False))) / n, (text.count(".") + text.count(",")) / n, sum(c for x, c in count.items() if len(x) <= 3) / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        n = np.expm1(x[:, 0])
        return (x - self.mean) / self.scale * (n / (n + SHRINK))[:, None] @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; at the cut it is ACCEPT."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + log(ACCEPT / (1 - ACCEPT)), -500, 500)))


def learn(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 60, l2: float = 1e-3) -> Model:
    """Weights by Newton steps on `pairs` pairs of a preferred (y = 1) and another (y = 0) row.

    Without rows of both kinds nothing can be preferred: weights are 0, and every score is ACCEPT.
    """
    d = len(FEATURES)
    m = Model(x.mean(axis=0) if len(x) else np.zeros(d), np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(d), np.zeros(d), 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return m
    n = np.expm1(x[:, 0])
    z = (x - m.mean) / m.scale * (n / (n + SHRINK))[:, None]
    rnd = np.random.default_rng(7)
    diff = z[rnd.choice(good, pairs)] - z[rnd.choice(bad, pairs)]
    w = m.weights
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + l2 * np.eye(d), diff.T @ p / pairs - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    m.weights = w
    m.cut = float(np.quantile(m.raw(x), len(bad) / (len(good) + len(bad))))
    return m


def fit(docs: DataFrame, labels: DataFrame, train: Column, most: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows that `train` selects; at most about `most`, chosen by hash, are read.

    Rows of null doc_id or quality teach nothing.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(train)
    n = rows.count()
    rows = rows.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(max(n, 1))) < most).dropDuplicates()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # about `most` rows
    got = sorted(_featured(texts.select("doc_id", "quality", "text")).collect())
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), len(FEATURES))
    return learn(x, np.array([r["quality"] for r in got], np.int64))


def _featured(x: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    return in_arrow(x, run, "doc_id long, quality int, x array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (score >= ACCEPT) of every row's whole text.

    Null, empty and blank texts have the features' mean and get its score; repeated rows each
    give a row; null ids stay null; other columns are ignored; empty docs give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(np.array([features(t.as_py()) for t in b.column(1)]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
