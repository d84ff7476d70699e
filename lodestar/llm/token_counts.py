"""Token counts without ids: pieces are counted once for each distinct pre-token.

1. Every text is cut into pre-tokens wherever no piece of the model can cross: before a space, and
   between characters that stand side by side in no piece, directly or through others. The distinct
   ones of the corpus, with their frequencies, are a table; the model splits each of them once and
   keeps how many pieces it gives.
2. Every document becomes the frequencies of its own pre-tokens. They are joined with that table, and
   frequency times pieces is summed.

Words that hold a large part of all rows never shuffle: the ``HOT`` most frequent pre-tokens (of at
most ``HOT_BYTES`` bytes, 8 MB in all) are sent to all tasks, where their share of a
document's sum is made in place. Only the frequencies of the others are joined by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, ref, stored, table
from .tokens import vocabulary

PIECES = "piece_bpe_32k.model"
HOT, HOT_BYTES = 262_144, 32
HELD = 500_000  # distinct pre-tokens that a task adds up before it hands them on
LIMIT = 4096
MARK = "▁"  # how the model writes a space


def cut_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Matches pre-tokens: marks, then a run of characters that pieces connect, or one character that they don't."""
    parent: dict[str, str] = {}

    def find(c: str) -> str:
        while (p := parent.setdefault(c, c)) != c:
            parent[c] = c = parent[p]
        return c

    beside = {pair for p in pieces for pair in zip(p.lstrip(MARK), p.lstrip(MARK)[1:])}
    for x, y in beside:
        parent[find(x)] = find(y)
    groups: dict[str, str] = {}
    for c in sorted(parent):
        groups[find(c)] = groups.get(find(c), "") + c
    runs = [f"[{re.escape(g)}]+" for g in sorted(groups.values(), key=lambda g: (-len(g), g))]
    return re.compile(f"{MARK}*(?:{'|'.join([*runs, f'[^{MARK}]'])})|{MARK}+")


class PieceCounter:
    """How many pieces a sentencepiece BPE model gives for a pre-token.

    Cutting is exact if the model changes no character, puts a mark before the text, and has marks only
    at the start of pieces, so that no merge crosses a cut; another model is refused with a ValueError.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n, t = model.normalizer_spec, model.trainer_spec
        crossing = any(MARK in p.piece.lstrip(MARK) or p.type == p.USER_DEFINED for p in model.pieces)
        if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix or t.model_type != t.BPE or crossing:
            raise ValueError("pieces of this model may cross a space")
        self.pattern = cut_pattern(p.piece for p in model.pieces if p.type == p.NORMAL)
        n.add_dummy_prefix = False  # pre-tokens bring their own mark
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text. The model puts a mark before every text that isn't empty and reads a space as one."""
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if text else []

    def counts(self, parts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(parts, num_threads=1)]


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One a worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _texts(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def distinct_parts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(part, freq) of every distinct pre-token of all texts."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["part", "freq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, cut = Counter(), counter(path).cut
        for b in batches:
            for t in _texts(b.column(0)):
                seen.update(cut(t))
            if len(seen) > HELD:
                yield rows(seen)
                seen.clear()
        yield rows(seen)

    return map_arrow(docs.select(ref(text_col).alias("text")), run, "part string, freq long").groupBy("part").agg(F.sum("freq").alias("freq"))


def piece_table(parts: DataFrame, path: str) -> DataFrame:
    """(part, freq, pieces): the model is asked once for each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = counter(path).counts(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["part", "freq", "pieces"])

    return map_arrow(parts, run, "part string, freq long, pieces long")


def frequencies(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, parts, freqs): the pre-tokens of every document with their frequencies; none for an empty text."""
    rows = docs.select(ref(id_col).alias("doc_id"), F.coalesce(F.octet_length(ref(text_col)), F.lit(0)).cast("long").alias("n_bytes"), ref(text_col).alias("text"))
    strings, numbers = pa.list_(pa.string()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = counter(path).cut
        for b in batches:
            each = [Counter(cut(t)) for t in _texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(c) for c in each], strings), pa.array([list(c.values()) for c in each], numbers)], names=["doc_id", "n_bytes", "parts", "freqs"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, parts array<string>, freqs array<long>")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    Counts are those of the sentencepiece library without begin and end; strings of special tokens
    inside a text are text, as the library reads them. A null text counts as empty: no bytes, no
    tokens. Rows with null or equal ids and repeated rows stay rows of their own; other columns are
    ignored. An empty table gives no rows. A text without spaces is one pre-token, however long.
    """
    counter(path)  # a model that can't be cut is refused here
    pieces = stored(piece_table(distinct_parts(docs, path, text_col), path), "pieces")
    common = pieces.where(F.octet_length("part") <= HOT_BYTES).orderBy(F.desc("freq"), "part").limit(hot)
    common = stored(common.select("part", "pieces"), "hot-pieces")
    # a row of each document for all its hot pre-tokens, and one for each other that it holds
    each = frequencies(docs, path, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    each = each.select("uid", "doc_id", "n_bytes", F.explode_outer(F.arrays_zip("parts", "freqs")).alias("x")).select("uid", "doc_id", "n_bytes", F.col("x.parts").alias("part"), F.col("x.freqs").alias("freq"))
    each = each.join(F.broadcast(common), "part", "left")  # at most ``hot`` rows of ``HOT_BYTES``
    rest = F.when(F.col("pieces").isNull(), F.col("part"))
    parts = each.groupBy("uid", "doc_id", "n_bytes", rest.alias("part")).agg(F.sum("freq").alias("freq"), F.sum(F.col("freq") * F.col("pieces")).alias("n"))
    parts = stored(parts, "document-parts")
    rare = parts.where("part is not null").join(pieces.select("part", "pieces"), "part").select("uid", "doc_id", "n_bytes", (F.col("freq") * F.col("pieces")).alias("n"))
    sums = parts.where("part is null").select("uid", "doc_id", "n_bytes", "n").unionAll(rare).groupBy("uid", "doc_id", "n_bytes").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, by the sentencepiece model of 32,000 pieces."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(PIECES))
