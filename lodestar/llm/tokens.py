"""Token ids of whole texts, and flat binary files of them.

``ChunkEncoder`` encodes with the tokenizers library and remembers the ids of words. A text is cut
only at single spaces and single line feeds between characters that aren't white space: there the
byte-level pattern always breaks, so the ids of the parts are the ids of the text.

File format, one set of files a partition, all little-endian:

* ``ids-PPPPP.bin``: the ids as flat uint16 (vocabularies up to 65,536) or uint32,
* ``offsets-PPPPP.bin``: uint64, documents + 1 starts within that file,
* ``docs-PPPPP.bin``: int64 document ids, then one byte each that is 0 where the id is null,
* ``manifest.json``: for each partition its first document's global start (the prefix sum of the
  tokens of all partitions before it), documents and tokens.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, ref, shared_path, sole_cache, table

BYTE_BPE = "byte_bpe_50k.json"
CACHED_CHUNKS = 400_000  # words remembered by one Python worker
GROUP_CHARS = 1_000_000  # characters encoded at a time
ROWS_A_FILE = 20_000  # documents of one set of files, about


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks_of(text: str) -> list[str] | None:
    """Parts of ``text`` between which every pretokenizer match ends, or None if there's no safe cut.

    It's safe if every white-space character is a space or a line feed that stands alone between others.
    """
    words, cuts = text.split(), text.count(" ") + text.count("\n")
    # no white space but these, as the words are that much shorter; and each between two words
    if len(words) != cuts + 1 or sum(map(len, words)) + cuts != len(text) or "\0" in text:
        return None
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


class ChunkCache:
    """Maps texts to their ids as bytes; ``encode_new`` gives the ids of chunks not seen before, ``encode_whole`` those of texts.

    Texts that hold one of ``whole`` aren't cut. At most about ``most`` chunks are remembered.
    """

    most = CACHED_CHUNKS

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], encode_whole: Callable[[list[str]], list[bytes]], whole: tuple[str, ...] = ()):
        self.encode_new, self.encode_whole, self.known, self.whole = encode_new, encode_whole, {}, whole

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if any(w in t for w in self.whole) else chunks_of(t) if t else [] for t in texts]
        uncut = [i for i, c in enumerate(cut) if c is None]
        new = list(set().union(*(c for c in cut if c)).difference(self.known))
        self.known.update(zip(new, self.encode_new(new)))
        out = [b"".join(map(self.known.__getitem__, c or ())) for c in cut]
        for i, ids in zip(uncut, self.encode_whole([texts[i] for i in uncut])):
            out[i] = ids
        if len(self.known) > self.most:
            self.known = {}
        return out

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """As ``encode``, a bounded number of characters at a time."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > GROUP_CHARS:
                yield from self.encode(group)
                group, size = [], 0
        if group:
            yield from self.encode(group)


class _Made(dict):
    """Makes what it lacks."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class ChunkEncoder(ChunkCache):
    """Byte-level BPE by the tokenizers library as it is; a special token's own text is that token."""

    def __init__(self, path: str, dtype: str = "<u2"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.code = Tokenizer.from_file(path), {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.merge = self.tokenizer.model.tokenize
        super().__init__(None, self._whole, tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.known = _Made(self._chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        # one look-up a chunk, made or remembered
        get, out = self.known.__getitem__, []
        for t in texts:
            cut = None if any(w in t for w in self.whole) else chunks_of(t) if t else []
            out.append(self._whole([t])[0] if cut is None else b"".join(map(get, cut)))
            if len(self.known) > self.most:
                self.known.clear()
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, piece: str) -> bytes:
        """The ids of a text that the pattern matches as a whole: only the merges are left to do."""
        written = piece.replace(" ", _SPACE) if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array(self.code, [t.id for t in self.merge(written)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        # letters, with a space before them or not, and the punctuation behind them are two matches
        word = chunk.rstrip(_PUNCTUATION)
        if not (word.isalpha() or word[:1] == " " and word[1:].isalpha()):
            return self._whole([chunk])[0]
        if len(word) == len(chunk):
            return self._merged(chunk)
        tail = chunk[len(word) :]
        if (end := self.known.get(tail)) is None:
            end = self.known[tail] = self._merged(tail)
        return self.known[word] + end


#: Visible ASCII punctuation but the apostrophe.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_chars() -> dict[int, int]:
    """How byte-level vocabularies write bytes: visible ones as they are, the others by code points from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in seen)}


_BYTE_CHARS = _byte_chars()
_SPACE = chr(_BYTE_CHARS[0x20])
_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, dtype: str) -> ChunkEncoder:
    """One encoder a worker process, so that its words outlive a task."""
    sole_cache("tokens", _ENCODERS.clear)
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = ChunkEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def _names(part: int) -> tuple[str, str, str]:
    return f"ids-{part:05d}.bin", f"offsets-{part:05d}.bin", f"docs-{part:05d}.bin"


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> list[dict]:
    """Write the ids of all texts in ascending id order and return the manifest.

    Null ids come first; rows with equal ids follow in the order of the table.

    Null texts count as empty; ``end_id`` follows each document. Every attempt of a task writes files
    of its own and renames them when complete, so a task that runs again just replaces equal files.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_A_FILE))
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path, dtype), TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        final = [f"{root}/{n}" for n in _names(part)]
        temp = [f"{f}.{attempt}" for f in final]
        ids, lengths = [], []
        with fs.open_output_stream(temp[0]) as out:
            for batch in batches:
                ids.append(batch.column(0).cast(pa.int64()))
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                for data in enc.encode_all(texts):
                    out.write(data + end)
                    lengths.append((len(data) + len(end)) // width)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        with fs.open_output_stream(temp[1]) as out:
            out.write(starts.tobytes())
        ids = pa.chunked_array(ids, pa.int64())
        with fs.open_output_stream(temp[2]) as out:
            out.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
            out.write(ids.is_valid().to_numpy().astype("u1").tobytes())
        for a, b in zip(temp, final):
            fs.move(a, b)
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(lengths)], "tokens": [int(starts[-1])]})

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    rows = docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))
    ordered = rows.repartitionByRange(parts, "id", "uid").sortWithinPartitions("id", "uid").drop("uid")
    # one row a partition comes to the driver
    done = sorted(map_arrow(ordered, write, "part long, docs long, tokens long").collect())
    bases = np.concatenate([[0], np.cumsum([r.tokens for r in done])])
    manifest = [{"part": r.part, "base": int(b), "docs": r.docs, "tokens": r.tokens} for r, b in zip(done, bases)]
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "parts": manifest}).encode())
    return manifest


def _flat(fs: pafs.FileSystem, name: str, dtype: str) -> Callable[[int, int], np.ndarray]:
    """Gives the numbers from one place of the file to another: memory-mapped where it is local, else by reading just those."""
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(name, dtype, "r") if os.path.getsize(name) else np.zeros(0, dtype)
        return lambda a, b: whole[a:b]
    f, width = fs.open_input_file(name), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), dtype)


def read_token_files(spark: SparkSession, folder: str, rows: int = 4096) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as uint32)."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]
    parts = [(p["part"], p["base"], p["docs"]) for p in manifest["parts"] if p["docs"]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, base, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids, offsets, docs = (_flat(fs, f"{root}/{name}", d) for name, d in zip(_names(part), (dtype, "<u8", "u1")))
                for i in range(0, n, rows):
                    j = min(n, i + rows)
                    at = offsets(i, j + 1).astype("i8")
                    some = ids(int(at[0]), int(at[-1]))
                    crc = [zlib.crc32(some[a:b].astype("<u4").tobytes()) for a, b in zip(at - at[0], at[1:] - at[0])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(docs(8 * i, 8 * j).view("<i8"), mask=docs(8 * n + i, 8 * n + j) == 0),
                        "start": base + at[:-1], "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    todo = spark.createDataFrame(parts, "part long, base long, docs long")
    if len(parts) > 1:
        todo = todo.repartition(len(parts))
    return map_arrow(todo, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    An empty table writes empty files and returns no rows; a null or empty text is the end id alone.
    """
    folder = shared_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary(BYTE_BPE), end_id=2)
    return read_token_files(spark, folder)
