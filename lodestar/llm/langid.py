"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of two, three and four bytes slide over windows of fixed length, the
largest response of each filter in a window goes through a rectifier into a softmax over languages. A
text's probabilities are the means over its windows, weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, ref, stored, table

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBEDDING = 8
PAD = 256
STEP = WINDOW - max(WIDTHS) + 1  # windows overlap, so that no filter misses a place
SAMPLE, LEAST = 1000, 5  # documents learned from, in all; of each language at least, about, but always one
WINDOWS = 64  # of a document that are learned from, at most
EPOCHS, BATCH, RATE = 8, 64, 0.01
_LETTER = re.compile(r"[^\W\d_]")


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, one row each, and how many bytes each adds."""
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // STEP))
    padded = np.full((n - 1) * STEP + WINDOW, PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
    return rows, np.minimum(STEP, np.maximum(1, len(data) - STEP * np.arange(n)))


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray  # 257 x EMBEDDING; the row of PAD is zero
    filters: np.ndarray  # (4 * EMBEDDING) x filters; narrower ones are zero behind their width
    bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    @staticmethod
    def _columns(x: np.ndarray) -> np.ndarray:
        """(windows, places, 4 * EMBEDDING) of embedded windows."""
        b, n, e = x.shape
        w = max(WIDTHS)
        return np.lib.stride_tricks.as_strided(x, (b, n - w + 1, w * e), x.strides)

    def _pool(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = self._columns(self.embedding[rows])
        b, n, e = columns.shape
        z = (columns.reshape(b * n, e) @ self.filters).reshape(b, n, -1)
        return columns, z, z.max(1) + self.bias

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(rows), BATCH):
            pooled = np.maximum(self._pool(rows[i : i + BATCH])[2], 0)
            out.append(_softmax(pooled @ self.output + self.output_bias))
        return np.concatenate(out)

    @classmethod
    def train(cls, rows: np.ndarray, labels: np.ndarray, languages: list[str]) -> ByteNetwork:
        random = np.random.RandomState(7)
        total, w = FILTERS * len(WIDTHS), max(WIDTHS)
        mask = np.concatenate([np.tile((np.arange(w * EMBEDDING) < k * EMBEDDING)[:, None], FILTERS) for k in WIDTHS], 1).astype(np.float32)
        net = cls(languages, *(a.astype(np.float32) for a in (
            random.randn(PAD + 1, EMBEDDING) * 0.5, random.randn(w * EMBEDDING, total) * 0.3 * mask, np.zeros(total),
            random.randn(total, len(languages)) * 0.1, np.zeros(len(languages)),
        )))
        net.embedding[PAD] = 0
        weights = [net.embedding, net.filters, net.bias, net.output, net.output_bias]
        first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
        # each language weighs the same
        share = np.bincount(labels, minlength=len(languages))
        weight = (len(labels) / np.maximum(share, 1) / len(languages)).astype(np.float32)
        step, steps = 0, EPOCHS * -(-len(rows) // BATCH)
        for _ in range(EPOCHS):
            order = random.permutation(len(rows))
            for i in range(0, len(rows), BATCH):
                x, y = rows[order[i : i + BATCH]], labels[order[i : i + BATCH]]
                columns, z, raw = net._pool(x)
                pooled = np.maximum(raw, 0)
                d = _softmax(pooled @ net.output + net.output_bias)
                d[np.arange(len(y)), y] -= 1
                d *= weight[y, None] / len(y)
                back = d @ net.output.T * (raw > 0)
                place = z.argmax(1)  # of each filter's largest response
                picked = columns[np.arange(len(x))[:, None], place]  # windows x filters x (4 * EMBEDDING)
                g_filters = np.einsum("bfe,bf->ef", picked, back) * mask
                g_picked = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDING)
                at = x[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(w)].ravel()
                g_embedding = np.stack([np.bincount(at, g_picked[:, e], minlength=PAD + 1) for e in range(EMBEDDING)], 1)
                g_embedding[PAD] = 0
                step += 1
                for j, g in enumerate((g_embedding, g_filters, back.sum(0), pooled.T @ d, d.sum(0))):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    rate = RATE * (1 - step / (steps + 1))
                    weights[j] -= (rate * first[j] / (1 - 0.9**step) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return net


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ByteNetwork | None:
    """A network from about ``sample`` documents, as many of each language, chosen by a hash of their ids; None without any.

    Every language with a letter in some text is learned: from one document always, and from about
    ``LEAST`` or more, so very many languages bring more than ``sample``. Of a chosen document all
    windows count, or ``WINDOWS`` at even distances over its whole text, so what comes to the driver is
    at most ``2 * WINDOW * WINDOWS`` bytes a document. Rows without a language or text don't count.
    """
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"), ref(lang_col).alias("lang")).where("lang is not null and text is not null")
    # stored, so that its size is known: where it's small no text has to meet its language in a task
    counts = stored(rows.groupBy("lang").count(), "language-counts")
    each = max(LEAST, sample / max(1, counts.count()))
    share = F.least(F.lit(1.0), F.lit(float(each)) / F.col("count"))
    # uniform in [0, 1) by the id's hash
    uniform = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.withColumn("u", uniform).join(counts, "lang").where(F.col("u") < share).select("text", "lang")
    # the share may miss a language: the document of the smallest hash is learned from too
    first = F.min_by("text", F.struct(~F.col("text").rlike(r"\p{L}"), F.xxhash64("id", "text")))
    chosen = chosen.unionAll(rows.groupBy("lang").agg(first.alias("text")).select("text", "lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, data = [], []
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if _LETTER.search(t):
                    w, _ = windows(_bytes(t))
                    if len(w) > WINDOWS:
                        w = w[np.arange(WINDOWS) * len(w) // WINDOWS]
                    langs += [lang] * len(w)
                    data += [x.astype("<i2").tobytes() for x in w]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], names=["lang", "window"])

    got = map_arrow(chosen, run, "lang string, window binary").toArrow()
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("window").to_pylist()))
    if not pairs:
        return None
    languages = sorted({p[0] for p in pairs})
    rows_ = np.stack([np.frombuffer(p[1], "<i2") for p in pairs])
    return ByteNetwork.train(rows_, np.array([languages.index(p[0]) for p in pairs]), languages)


def identify(texts: list[str | None], net: ByteNetwork | None) -> tuple[list[str], list[float]]:
    """(language, probability) of each text; ("und", 0) for null, without a letter, or without a network. Ties go to the first language by name."""
    out, score = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return out, score
    group: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if group:
            p = net.probabilities(np.concatenate([g[1] for g in group]))
            start = 0
            for i, rows, weight in group:
                mean = weight @ p[start : start + len(rows)] / weight.sum()
                start += len(rows)
                out[i], score[i] = net.languages[int(mean.argmax())], float(min(1, mean.max()))
            group.clear()

    pending = 0
    for i, t in enumerate(texts):
        if t and _LETTER.search(t):
            rows, weight = windows(_bytes(t))
            group.append((i, rows, weight))
            pending += len(rows)
            if pending > 1024:
                flush()
                pending = 0
    flush()
    return out, score


def predict(docs: DataFrame, net: ByteNetwork | None, text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """The columns ``keep`` (name: column), lang_pred and score of every row; see ``identify``."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(*(c.alias(n) for n, c in (keep or {}).items()), ref(text_col).alias("text"))
    names = list(keep or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = identify(b.column("text").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    types = dict(rows.dtypes)
    return map_arrow(rows, run, ", ".join([*(f"{n} {types[n]}" for n in names), "lang_pred string", "score double"]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all ``documents``; learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict(docs, train(docs.where(~held & F.col("doc_id").isNotNull())), keep={"doc_id": F.col("doc_id"), "held_out": held})
