"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is the weighted sum of its hashed features, with one weight vector shared by all
grades; ordered thresholds cut the scores into grades: P(grade <= k) = sigmoid(threshold_k - score).
It gives the expected grade and the tail probabilities P(grade >= k) to select by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, ref, sole_cache, table

BITS = 18
SAMPLE = 10_000  # labelled rows fitted on, at most
GRADES = 3  # 0: poor, 1: sound but toxic, 2: sound
STEPS, RATE, PENALTY = 150, 0.5, 1e-5
KNOWN_TOKENS = 200_000
_known: dict[str, int] = {}


def _shape(token: str) -> str:
    """Runs of upper-case, lower-case and digit characters as A, a and 9; other runs by one of their characters."""
    out = []
    for c in token:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: its lower-cased tokens and their shapes, by the roots of their shares."""
    import xxhash

    sole_cache("quality", _known.clear)
    counts = Counter(text.split())
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0)
    for t in [t for t in counts if t not in _known]:
        _known[t] = (xxhash.xxh32_intdigest("w" + t.lower()) >> 32 - BITS) << BITS | xxhash.xxh32_intdigest("s" + _shape(t)) >> 32 - BITS
    both = np.fromiter(map(_known.__getitem__, counts), np.int64, len(counts))
    ids = np.concatenate([both >> BITS, both & (1 << BITS) - 1])
    n = np.fromiter(counts.values(), np.float64, len(counts))
    if len(_known) > KNOWN_TOKENS:
        _known.clear()
    at, inverse = np.unique(ids, return_inverse=True)
    return at, np.sqrt(np.bincount(inverse, np.concatenate([n, n])) / n.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 - _sigmoid(self.thresholds[None, :] - score[:, None])

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Ordinal:
        """Maximum likelihood with a small ridge, by full-batch adaptive gradient steps."""
        lengths = [len(r[0]) for r in rows]
        used, columns = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        values, owner, n = np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows)), lengths), len(rows)
        # the first threshold is free and the others are gaps above it, so they stay in order
        start = np.clip(np.array([(grades < k).mean() for k in range(1, GRADES)]), 0.01, 0.99)
        cut = np.log(start / (1 - start))
        p = np.concatenate([np.zeros(len(used)), cut[:1], np.log(np.maximum(np.diff(cut), 0.1))])
        first, second = np.zeros_like(p), np.zeros_like(p)
        low, high = np.maximum(grades - 1, 0), np.minimum(grades, GRADES - 2)
        for step in range(1, STEPS + 1):
            w, theta = p[: len(used)], np.cumsum(np.concatenate([p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :])]))
            score = np.bincount(owner, values * w[columns], minlength=n)
            upper = np.where(grades < GRADES - 1, _sigmoid(theta[high] - score), 1.0)
            lower = np.where(grades > 0, _sigmoid(theta[low] - score), 0.0)
            mass = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass  # of the log likelihood, by the two thresholds
            d_theta = np.bincount(high, np.where(grades < GRADES - 1, du, 0), minlength=GRADES - 1) - np.bincount(low, np.where(grades > 0, dl, 0), minlength=GRADES - 1)
            d_cut = np.concatenate([[d_theta.sum()], np.exp(p[len(used) + 1 :]) * np.cumsum(d_theta[::-1])[::-1][1:]])
            d_w = -np.bincount(columns, values * (du - dl)[owner], minlength=len(used))
            g = -np.concatenate([d_w / n - PENALTY * w, d_cut / n])
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            p = p - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
        weights = np.zeros(1 << BITS)
        weights[used] = p[: len(used)]
        return cls(weights, np.cumsum(np.concatenate([p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :])])))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """The model from the labels of at most ``sample`` documents, chosen by a hash of their ids; None without labels.

    ``labels``: doc_id, quality (0 or 1) and toxic (0 or 1; null counts as 0). Rows without a quality don't
    count; of several labels of an id the lowest grade does, of several documents the one whose text has
    the smallest hash.
    """
    grade = F.when(F.col("quality") > 0, GRADES - 1 - F.when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(0)).otherwise(0)
    rated = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    # at most `sample` rows of two numbers: that is what the broadcast holds
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(ref(id_col).alias("doc_id"), ref(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), b.column("hash"), pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary())], names=["doc_id", "grade", "hash", "at", "value"])

    every = map_arrow(texts.withColumn("hash", F.xxhash64("text")), run, "doc_id long, grade int, hash long, at binary, value binary")
    # one row a document, so `sample` rows at most, come to the driver
    rows = every.groupBy("doc_id").agg(F.min_by(F.struct("grade", "at", "value"), F.struct("hash", "at")).alias("r")).select("doc_id", "r.*").toArrow().to_pydict()
    if not rows["grade"]:
        return None
    order = sorted(range(len(rows["grade"])), key=lambda i: rows["doc_id"][i])
    return Ordinal.fit([(np.frombuffer(rows["at"][i], "<i4").astype(np.int64), np.frombuffer(rows["value"][i], "<f4").astype(float)) for i in order], np.array([rows["grade"][i] for i in order]))


def _grader(spark: SparkSession, model: Ordinal | None):
    sent = spark.sparkContext.broadcast(model)  # 2 ** BITS weights

    def grade(texts: list[str | None]) -> np.ndarray:
        m = sent.value
        if m is None:
            return np.ones((len(texts), GRADES - 1))
        score = np.zeros(len(texts))
        for i, t in enumerate(texts):
            at, value = features(t or "")
            score[i] = m.weights[at] @ value
        return m.tails(score)

    return grade


def grades(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, p_at_least_2 and accepted of every row.

    A document is accepted if P(grade >= 1) is a half or more. Null and empty texts have no features and
    get the grade that the thresholds alone give. Without a model all are of the top grade.
    """
    grade = _grader(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = grade(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 0] >= 0.5)], names=["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", "accepted"])

    rows = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, expected_grade double, p_at_least_1 double, p_at_least_2 double, accepted boolean")


def accepted(docs: DataFrame, model: Ordinal | None, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` that are accepted; see ``grades``."""
    grade, at = _grader(docs.sparkSession, model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(grade(b.column(at).to_pylist())[:, 0] >= 0.5))

    return map_arrow(docs, run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grades of all ``documents`` by a model of ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return grades(docs, fit(docs, table(spark, sf_dir, "labels")))
