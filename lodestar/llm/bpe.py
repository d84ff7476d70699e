"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of its encoding: the token t
for which the encoding of the shorter prefix, followed by t, stays as it is when merged as a whole.
``PrefixTable`` stores that token for each prefix. The encoding is read off backwards, more bytes are
appended without touching what is there, and after an edit only the entries near it change.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import map_arrow, ref, sole_cache, table
from .tokens import ChunkCache, vocabulary

MULTI_BPE = "byte_bpe_multi_50k.tiktoken"
REMEMBERED_PAIRS = 2_000_000
CACHED_MATCHES = 700_000  # chunks, and matches of the pattern, remembered by one Python worker
NEVER = 1 << 62


class Vocabulary:
    """Token bytes and ranks, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        # all ends of tokens: their rank if they're tokens that merges make, else -1
        self.ends = {b[i:]: -1 for b in ranks for i in range(len(b))}
        self.ends.update((b, r) for b, r in ranks.items() if len(b) == 1 or self.halves(r))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte or one that no merge makes."""
        if token not in self._halves:
            parts = [self.ranks.get(bytes([b]), -1) for b in self.bytes[token]]
            while len(parts) > 2:
                merges = [self.ranks.get(self.bytes[a] + self.bytes[b], NEVER) for a, b in zip(parts, parts[1:])]
                i = merges.index(min(merges))
                if merges[i] >= token:
                    break
                parts[i : i + 2] = [merges[i]]
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The tokens that are at one end of ``token`` while it's built, each with the rank of the merge that ends it."""
        key = (token, right)
        if key not in self._spines:
            out, until = [], NEVER
            at: int | None = token
            while at is not None:
                out.append((self.bytes[at], until))
                until, parts = at, self.halves(at)
                at = parts[right] if parts else None
            self._spines[key] = out
        return self._spines[key]

    def stable(self, a: int, b: int) -> bool:
        """True if merging the bytes of ``a`` and ``b`` together gives just these two tokens again.

        It doesn't if, at some time, the token at a's right end and the one at b's left end both exist
        and merge before either goes on to merge within its own half. Of equal ranks the left goes first.
        """
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stable(a, b)
        return known

    def _stable(self, a: int, b: int) -> bool:
        get, ends = self.ranks.get, self._spine(b, False)
        for x, x_until in self._spine(a, True):
            for y, y_until in ends:
                m = get(x + y)
                if m is not None and m < x_until and m <= y_until:
                    return False
        return True


class PrefixTable:
    """The last token of the encoding of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _fill(self, until: int) -> None:
        """The last tokens of the prefixes up to ``until`` bytes, each from the entries of shorter ones."""
        data, last, get, pairs, stable = self.data, self.last, self.v.ends.get, self.v.pairs.get, self.v.stable
        for end in range(len(last) + 1, until + 1):
            start, starts, tokens = end - 1, [], []
            while start >= 0 and (token := get(data[start:end])) is not None:
                if token >= 0:
                    starts.append(start)
                    tokens.append(token)
                start -= 1
            # the longest first
            while starts:
                start, token = starts.pop(), tokens.pop()
                if not start:
                    break
                before = last[start - 1]
                known = pairs(before << 32 | token)
                if known or known is None and stable(before, token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            last.append(token)

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def become(self, data: bytes) -> None:
        """The table of ``data``; what it shares with the present string from the start on stays."""
        same = 0
        for x, y in zip(self.data, data):
            if x != y:
                break
            same += 1
        del self.last[same:]
        self.data = data
        self._fill(len(data))

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace ``removed`` bytes at ``at``; returns how many entries were computed anew.

        Entries before the edit stay. Behind it, as soon as as many entries in a row as the longest
        token has bytes come out as before, all later ones are as before too.
        """
        old, tail = self.last, len(self.data) - at - removed
        self.data = self.data[:at] + inserted + self.data[at + removed :]
        self.last = old[:at]
        same, computed, shift = 0, 0, len(inserted) - removed
        while len(self.last) < len(self.data):
            end = len(self.last) + 1
            self._fill(end)
            token = self.last[-1]
            computed += 1
            behind = end > len(self.data) - tail  # this prefix ends behind the edit
            same = same + 1 if behind and old[end - 1 - shift] == token else 0
            if same >= self.v.longest:
                self.last.extend(old[end - shift :])
        return computed

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes[out[-1]])
        return out[::-1]


class PrefixEncoder(ChunkCache):
    """Ids of texts whose pretokenizer matches are each encoded by prefix dynamic programming."""

    most = CACHED_MATCHES

    def __init__(self, path: str, pattern: str):
        import regex

        self.v = Vocabulary.load(path)
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        super().__init__(self._new, self._new)

    def _encode_pieces(self, texts: set[str]) -> None:
        """Remember the ids of matches of the pattern. In their order each shares the longest prefix with the one before it."""
        table, ranks = PrefixTable(self.v), self.v.ranks
        for data, text in sorted((t.encode(), t) for t in texts):
            whole = ranks.get(data)
            if whole is None:
                table.become(data)
            self.pieces[text] = array("I", [whole] if whole is not None else table.ids()).tobytes()

    def _new(self, chunks: list[str]) -> list[bytes]:
        cut = [self.find(c) for c in chunks]
        self._encode_pieces(set().union(*cut).difference(self.pieces))
        out = [b"".join(map(self.pieces.__getitem__, c)) for c in cut]
        if len(self.pieces) > self.most:
            self.pieces = {}
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def prefix_encoder(path: str, pattern: str) -> PrefixEncoder:
    sole_cache("bpe", _ENCODERS.clear)
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = PrefixEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary, from the ids). Null and empty texts have no ids."""
    return _encode(docs, path, pattern, id_col, text_col, "doc_id long, ids array<int>, decoded binary", lambda ids, data: (ids.astype("i4"), data))


def _encode(docs, path, pattern, id_col, text_col, schema, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = prefix_encoder(path, pattern)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            out = []
            for data in enc.encode_all(texts):
                ids = np.frombuffer(data, "<u4")
                out.append(row(ids, enc.decode(ids.tolist())))
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*out))], names=names)

    rows = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text_col).alias("text"))
    return map_arrow(rows, run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    import public_tokenizers

    sha = lambda data: hashlib.sha256(data).hexdigest()
    return _encode(
        table(spark, sf_dir, "documents"), vocabulary(MULTI_BPE), public_tokenizers.PATTERN, "doc_id", "text",
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, data: (len(ids), sha(ids.tobytes()), sha(data)),
    )
