"""N-gram Jaccard join with Bayesian candidate pruning.

1. Every text becomes its set of hashed five-word shingles and a MinHash signature. Texts with equal
   sets are one class of copies from here on.
2. Bands of the signatures name candidate buckets. Buckets with the same members count once. Within
   a bucket, pairs are compared in square tiles of ``BLOCK`` classes, ``STEP`` MinHash values at a
   time: a pair is dropped as soon as the posterior probability that its similarity reaches the
   threshold (uniform prior, binomial matches) is below ``TOLERANCE``. A tile returns a spanning
   forest of its surviving pairs, not the pairs.
3. Within each component of those forests, again in tiles, surviving pairs are verified on the
   shingle sets themselves. Tiles return link counts and a forest of the verified links, whose
   components are the groups.

No row stands for a pair: a tile's output is a row for each of its classes at most.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, map_arrow, ref, rows_among, sole_cache, stored, table, with_uid
from .components import components

WORDS = 5
#: Similarity as a fraction, so that the test is exact.
THRESHOLD = (4, 5)
ROWS, BANDS = 4, 32  # a pair at the threshold shares no bucket with probability 5e-8
HASHES = ROWS * BANDS
STEP = 32
TOLERANCE = 1e-6
BLOCK = 256
KNOWN_WORDS = 200_000
DENSE_PAIRS = 2_000  # a tile with more pairs to verify counts intersections by matrix products

_RANDOM = np.random.RandomState(20240229)
_FACTORS = _RANDOM.randint(1, 1 << 62, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.randint(1, 1 << 62, HASHES).astype(np.uint64)
_PLACES = _RANDOM.randint(1, 1 << 62, WORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile(r"\w+")
_known: dict[str, int] = {}


def shingles(text: str) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles: runs of five lower-cased words, or all words of a shorter text."""
    import xxhash

    sole_cache("near_dup", _known.clear)
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    n = max(1, len(h) - WORDS + 1)
    s = np.full(n, min(len(h), WORDS), np.uint64)
    for j in range(min(len(h), WORDS)):
        s += h[j : j + n] * _PLACES[j]
    s ^= s >> np.uint64(30)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(27)
    s *= np.uint64(0x94D049BB133111EB)
    s ^= s >> np.uint64(31)
    return np.unique(s)


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        out = np.minimum(out, (s[i : i + 1024, None] * _FACTORS + _ADDENDS).min(0))
    return (out >> np.uint64(32)).astype("<u4")


def least_matches(n: int, threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> int:
    """The fewest matches among ``n`` MinHash values with which a pair isn't dropped.

    After m matches the similarity is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    t, tail = threshold, 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


_LEAST = [least_matches(n) for n in range(STEP, HASHES + 1, STEP)]


def surviving(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the rows of two signature blocks that no step drops; i < j if they are the same block."""
    count = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        count += a[:, k, None] == b[None, :, k]
    keep = count >= _LEAST[0]
    i, j = np.nonzero(np.triu(keep, 1) if same else keep)
    count = count[i, j]
    for turn, least in enumerate(_LEAST[1:], 1):
        at = slice(turn * STEP, (turn + 1) * STEP)
        count = count + (a[i, at] == b[j, at]).sum(1)
        ok = count >= least
        i, j, count = i[ok], j[ok], count[ok]
    return i, j


def verified(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sets of each index pair reach the threshold, exactly."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    if len(i) < DENSE_PAIRS:
        common = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    else:
        rows_a, rows_b = np.repeat(np.arange(len(sets_a)), size_a), np.repeat(np.arange(len(sets_b)), size_b)
        flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
        shared = np.intersect1d(flat_a, flat_b)
        total = np.zeros((len(sets_a), len(sets_b)), np.float64)
        for k in range(0, len(shared), 4096):
            some = shared[k : k + 4096]
            m = []
            for flat, rows, n in ((flat_a, rows_a, len(sets_a)), (flat_b, rows_b, len(sets_b))):
                at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
                hit = some[at] == flat
                one = np.zeros((n, len(some)), np.float32)
                one[rows[hit], at[hit]] = 1
                m.append(one)
            total += m[0] @ m[1].T
        common = total[i, j].astype(np.int64)
    p, q = THRESHOLD
    return (p + q) * common >= p * (size_a[i] + size_b[j])


def forest(ids_a: np.ndarray, ids_b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest node) that connect what the pairs connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    for x, y in zip(ids_a.tolist(), ids_b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in parent if find(x) != x]


def _signatures(rows: DataFrame, uid: str, id_col: str, text: str) -> DataFrame:
    """(uid, doc_id, key, sig) of every row; key is null for texts without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sigs = [], []
            for t in batch.column(2).to_pylist():
                s = shingles(t or "")
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sigs.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["uid", "doc_id", "key", "sig"])

    rows = rows.select(F.col(uid).alias("uid"), ref(id_col).alias("doc_id"), ref(text).alias("text"))
    return map_arrow(rows, run, f"uid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, sig binary")


def _tiles(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Each row once for every tile of its group that it takes part in: columns x and y of the tile, and its side."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("tid"), blocks).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("blocks", "other", size)


def _sides(t: pa.Table) -> tuple[list[int], list[int], bool]:
    mine, x, y = t.column("mine").to_numpy(), t.column("x")[0].as_py(), t.column("y")[0].as_py()
    return np.nonzero(mine == x)[0], np.nonzero(mine == y)[0], x == y


def _sigs(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, HASHES)


def _candidates(t: pa.Table) -> pa.Table:
    a, b, same = _sides(t)
    sig, tid = _sigs(t), t.column("tid").to_numpy()
    i, j = surviving(sig[a], sig[b], same)
    edges = forest(tid[a[i]], tid[b[j]])
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _links(t: pa.Table) -> pa.Table:
    a, b, same = _sides(t)
    sig, tid = _sigs(t), t.column("tid").to_numpy()
    sets = [np.frombuffer(s, "<u8") for s in t.column("items").to_pylist()]
    i, j = surviving(sig[a], sig[b], same)
    if len(i):
        ok = verified([sets[k] for k in a], [sets[k] for k in b], i, j)
        i, j = i[ok], j[ok]
    counts = np.bincount(a[i], minlength=len(tid)) + np.bincount(b[j], minlength=len(tid))
    root = dict(forest(tid[a[i]], tid[b[j]]))
    some = np.nonzero(counts)[0]
    ids = tid[some].tolist()
    return pa.table({"tid": pa.array(ids, pa.int64()), "links": pa.array(counts[some], pa.int64()), "root": pa.array([root.get(k, k) for k in ids], pa.int64())})


def _sets(rows: DataFrame) -> DataFrame:
    """(uid, items): the shingle sets of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or "").astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["uid", "items"])

    return map_arrow(rows.select("uid", "text"), run, "uid long, items binary")


def _classes(docs: DataFrame, uid: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored (uid, doc_id, key) of all rows, and (key, root, links) of all classes of copies; root is the group."""
    hashed = stored(_signatures(docs, uid, id_col, text_col), "signatures")
    reps = hashed.where(F.col("key").isNotNull()).dropDuplicates(["key"])
    reps = stored(reps.select(F.monotonically_increasing_id().alias("tid"), "uid", "key", "sig"), "classes")
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)))
    buckets = reps.select("tid", F.explode(bands).alias("bucket"))
    # buckets with the same members count once: (size, sum of hashed members) names a member set
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("tid").cast("decimal(20,0)")).alias("members")).where("size > 1")
    full = stored(full.groupBy("size", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "buckets")
    inside = stored(buckets.join(full, "bucket"), "bucket-members")
    tiles = _tiles(inside.join(reps.select("tid", "sig"), "tid"), "bucket", "size")
    edges = tiles.groupBy("bucket", "x", "y").applyInArrow(_candidates, "a long, b long")
    groups = components(stored(edges, "candidate-edges"))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = groups.join(sizes, "root").join(reps.select(F.col("tid").alias("node"), "uid", "sig"), "node")
    members = stored(members.select(F.col("node").alias("tid"), "root", "size", "uid", "sig"), "members")
    # only sets of members move, not texts
    texts = rows_among(docs.select(F.col(uid).alias("uid"), ref(text_col).alias("text")), "uid", members.select("uid"))
    sets = stored(_sets(texts), "sets").join(members, "uid").drop("uid")
    found = _tiles(sets, "root", "size").groupBy("root", "x", "y").applyInArrow(_links, "tid long, links long, root long")
    found = stored(found, "links")
    linked = components(found.select(F.col("tid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy(F.col("tid").alias("node")).agg(F.sum("links").alias("links"))
    info = reps.select(F.col("tid").alias("node"), "key").join(linked, "node", "left").join(counts, "node", "left")
    info = info.select("key", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return hashed.select("uid", "doc_id", "key"), stored(info, "class-info")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, class_id, n_links, n_copies, kept of every row of ``docs``.

    ``class_id`` is the smallest id of the row's group: the component of texts linked by a Jaccard
    similarity of 0.8 or more, with all their copies. ``n_links``: linked texts with another shingle
    set. ``n_copies``: rows with this very shingle set. ``kept``: one row of each group, the smallest
    id (null last, then by ``uid``). ``uid`` is the row's number by ``with_uid``. A text without a word
    (null, empty) is a group of its own with 0 links; its class id is its own id. Shorter texts than
    five words are one shingle. Other columns are ignored; an empty table gives no rows.
    """
    (uid,) = fresh(docs, "uid")
    return _near_duplicates(with_uid(docs, uid), uid, id_col, text_col)


def _near_duplicates(rows: DataFrame, uid: str, id_col: str, text_col: str) -> DataFrame:
    ids, info = _classes(rows, uid, id_col, text_col)
    copies = ids.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")).alias("first"))
    each = info.join(copies, "key")
    roots = each.groupBy("root").agg(F.min("first").alias("first"))
    # stored, so that the join below may split a class that holds a large part of all rows
    each = stored(each.select("key", "root", "links", "n_copies").join(roots, "root"), "copies")
    out = ids.join(each, "key", "left")
    alone = F.col("root").isNull()
    return out.select(
        "uid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        (alone | (F.col("first.uid") == F.col("uid"))).alias("kept"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` but those of a group that aren't its first; see ``near_duplicates``."""
    (uid,) = fresh(docs, "uid")
    rows = with_uid(docs, uid)
    gone = _near_duplicates(rows, uid, id_col, text_col).where("not kept").select("uid")
    return rows_among(rows, uid, gone, inside=False).drop(uid)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("uid")
