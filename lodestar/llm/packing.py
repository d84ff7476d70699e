"""Best-fit packing of documents into fixed-length sequences, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to partitions of a bounded
number of rows; each packs its own by best-fit decreasing and compares its bins with the best lower
bound that dual feasible functions give. Partitions at their bound are final. The others exchange:
their full bins stay, the pieces of all other bins are pooled, dealt anew and packed again, for as
long as that saves sequences.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, ref, stored, table
from .tokens import BYTE_BPE, encoder, vocabulary

CAPACITY = 2048
PART_ROWS = 50_000  # pieces packed together by one task
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long, bins long, bound long, full boolean"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first have the full length."""
    first = (total - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with the checksum of their ids; null texts count as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, "<u2"), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), ["" if t is None else t for t in batch.column(1).to_pylist()]
            rows = []
            for doc, data in zip(ids, enc.encode_all(texts)):
                data = np.frombuffer(data, "<u2").astype("<u4").tobytes() + end
                for i, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    rows.append((doc, i, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            yield _batch(list(zip(*rows)) or [[]] * 5)

    return map_arrow(docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text")), make, PIECE)


def _batch(columns: list) -> pa.RecordBatch:
    types = dict(zip("doc_id piece start length ids_crc32".split(), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins. Longest first, each into the fullest bin it fits."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: there's a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            b, room, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - room
        if room > length:
            rooms |= 1 << room - length
            with_room[room - length].append(b)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    Threshold functions count lengths over capacity - k as whole bins and ignore those under k;
    rounding functions take x to floor((k + 1) x / capacity) / k where (k + 1) x isn't a multiple of
    the capacity. The largest bound counts.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * x)
    best = -(-int(total[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):
        middle = total[capacity - k] - total[k - 1]
        best = max(best, int(n[-1] - n[capacity - k]) + -(-int(middle) // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * x
        # in units of 1 / (k * capacity)
        f = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    return best


def _pack_round(open_rows: DataFrame, rows: int, turn: int, capacity: int) -> DataFrame:
    parts = max(1, -(-rows // PART_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).combine_chunks()
        lengths = t.column("length").to_numpy().astype(np.int64)
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=count)
        base = (turn << 52) + (TaskContext.get().partitionId() << 26)
        bound = lower_bound(lengths, capacity)
        for name, c in (("sequence_id", base + bins), ("offset", offsets), ("bins", np.full(len(bins), count)), ("bound", np.full(len(bins), bound)), ("full", (fill[bins] == capacity) | (count == bound))):
            t = t.append_column(name, pa.array(c))
        yield from t.to_batches(max_chunksize=10_000)

    # dealt in turn, so that equal rows and ids don't meet in one task
    return map_arrow(open_rows.repartition(parts), pack, PACKED)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (columns PIECE) with sequence_id and offset. ``rows`` should be stored: it is read several times.

    Pieces of the full length are a sequence each. Equal rows are packed as separate pieces.
    """
    whole = rows.where(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = rows.where(F.col("length") < capacity)
    out = [whole]
    n = todo.count()
    packed = stored(_pack_round(todo, n, 1, capacity), "packed")
    for turn in itertools.count(2):  # until all are certified or an exchange saves nothing
        left = packed.where(~F.col("full"))
        before_parts = -(-n // PART_ROWS)
        n, before = left.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if not n or before_parts <= 1:  # all certified, or packed by one task already
            break
        again = stored(_pack_round(left.select(*rows.columns), n, turn, capacity), "packed")
        if again.agg(F.count_distinct("sequence_id")).first()[0] >= before:
            break  # the exchange saved nothing: the packing before it stands
        out.append(packed.where("full"))
        packed = again
    keep = [*rows.columns, "sequence_id", "offset"]
    result = packed.select(keep)
    for part in out:
        result = result.unionAll(part.select(keep))
    return result


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece of the end id alone; an empty table gives no rows; documents with
    equal or null ids are packed like any other.
    """
    return pack(stored(pieces(docs, path or vocabulary(BYTE_BPE), end_id, capacity), "pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens of all documents, a row per piece."""
    return best_fit_packing(table(spark, sf_dir, "documents"))
