"""Nearest neighbours by cosine: multiprobe p-stable hashing, exact reranking.

1. Equal vectors are one class, which keeps its ``k + 1`` smallest ids: no more of them can be among
   the nearest of anything. Classes are what is indexed and compared.
2. Each of ``TABLES`` hash tables cuts Gaussian projections of the unit vectors into slots of
   ``WIDTH``; their number grows with the logarithm of the classes, so that buckets keep their size.
   Rows shuffle by (table, bucket); buckets of more than ``PART`` classes, or visited by more than
   ``BLOCK`` queries, are dealt to several tasks.
3. A query visits, besides its own bucket, the buckets a slot or two away in some projections, in
   the order of their estimated success: the sum of squared distances from the query to the slot
   borders crossed. How many it visits is fitted: the neighbours of ``FIT_QUERIES`` queries are found
   among all rows, and as many buckets a table are probed as find the share ``RECALL`` of them.
4. A bucket's task compares in single precision and returns the best for each query that visits it,
   rounding included; after the queries' own buckets, only what may beat the best found in those. The
   candidates of all tables are merged and reranked by exact cosines.

A query whose buckets hold fewer rows than it may return is compared with all rows, in blocks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ._common import map_arrow, ref, stored, table

TABLES, WIDTH = 6, 1.5
BUCKET = 500  # classes that a bucket holds on average, for vectors without structure
PART, BLOCK = 16_384, 4_096  # classes and queries of a bucket that meet in one task, about
MOST_PROJECTIONS = 8
FIT_QUERIES, RECALL = 64, 0.96
SEED = 20240229
PAIRS = "q long, c long, rough float, slack float"


def projections_for(rows: int) -> int:
    """A projection of unit vectors has about e slots of ``WIDTH``."""
    return max(1, min(MOST_PROJECTIONS, round(math.log(max(1, rows / BUCKET)))))


def margin(dim: int) -> float:
    """More than single precision can be off in a product of two unit vectors."""
    return 2e-7 * (dim + 50)


class Tables:
    """The hash tables of vectors of one length; every worker makes the same ones."""

    def __init__(self, dim: int, projections: int, tables: int = TABLES, width: float = WIDTH):
        random = np.random.RandomState([SEED, dim, projections])
        self.a, self.b, self.width = random.randn(tables, dim, projections), random.rand(tables, projections) * width, width
        reach = (0, -1, 1, -2, 2) if projections <= 4 else (0, -1, 1)
        self.moves = np.array(list(itertools.product(reach, repeat=projections)), np.int64)

    def _places(self, unit: np.ndarray) -> np.ndarray:
        return (np.einsum("nd,tdk->ntk", unit, self.a, optimize=True) + self.b) / self.width

    def _keys(self, slots: np.ndarray) -> np.ndarray:
        """Bucket numbers of (..., tables, ..., projections) slots, without the table; 7 bits a slot."""
        return ((slots & 127) << (7 * np.arange(slots.shape[-1]))).sum(-1)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each row, with its table in the lowest digits."""
        return self._keys(np.floor(self._places(unit)).astype(np.int64)) * len(self.a) + np.arange(len(self.a))

    def probes(self, unit: np.ndarray, count: int) -> np.ndarray:
        """(rows, tables, count): the buckets to visit, in the order of their estimated success."""
        count = min(count, len(self.moves))
        out = np.empty((len(unit), len(self.a), count), np.int64)
        for i in range(0, len(unit), 64):
            at = self._places(unit[i : i + 64])
            slots = np.floor(at).astype(np.int64)
            below = at - slots
            cost = np.zeros((*at.shape[:2], len(self.moves)))
            for k in range(at.shape[2]):
                for step in np.unique(self.moves[:, k]):
                    away = below[..., k] - step - 1 if step < 0 else step - below[..., k]
                    if step:
                        cost[:, :, self.moves[:, k] == step] += (away * away)[..., None]
            order = np.argsort(cost, axis=2, kind="stable")[:, :, :count]
            out[i : i + 64] = self._keys(slots[:, :, None, :] + self.moves[order]) * len(self.a) + np.arange(len(self.a))[:, None]
        return out


@lru_cache(8)
def tables_of(dim: int, projections: int) -> Tables:
    return Tables(dim, projections)


def probes_needed(queries: list[np.ndarray], neighbours: list[np.ndarray], projections: int, share: float = RECALL) -> tuple[int, float]:
    """Buckets a table to visit so that ``share`` of the neighbours are found, and the share found.

    ``neighbours``: for each unit query the unit vectors that it should find.
    """
    ranks = []
    for q, near in zip(queries, neighbours):
        t = tables_of(len(q), projections)
        if len(near):
            there, visits = t.buckets(near), t.probes(q[None], len(t.moves))[0]
            hit = there[:, :, None] == visits[None]
            ranks.append(np.where(hit.any(2), hit.argmax(2) + 1, len(t.moves) + 1).min(1))
    if not ranks:
        return 1, 1.0
    every, most = np.sort(np.concatenate(ranks)), max(len(tables_of(len(q), projections).moves) for q in queries)
    need = int(min(every[math.ceil(share * len(every)) - 1], most))
    return need, float((every <= need).mean())


def _floats(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _unit_rows(batch: pa.RecordBatch) -> np.ndarray:
    v = np.array(batch.column("vector").flatten(), np.float64).reshape(batch.num_rows, -1)
    v = v / np.abs(v).max(1)[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None]


def _same_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims):
            yield b if (dims == d).all() else b.filter(pa.array(dims == d))


def _hashed(classes: DataFrame, projections: int) -> DataFrame:
    """Adds the single-precision unit vector and the buckets of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _same_length(batches):
            unit = _unit_rows(b)
            keys = tables_of(unit.shape[1], projections).buckets(unit)
            yield pa.RecordBatch.from_arrays(
                [b.column("c"), b.column("dim"), pa.array([u.tobytes() for u in unit.astype(np.float32)], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))],
                names=["c", "dim", "unit", "keys"],
            )

    return map_arrow(classes.select("c", "dim", "vector"), run, "c long, dim int, unit binary, keys array<long>")


def _best(units: np.ndarray, ids: np.ndarray, asked: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``asked``, id, product) of the ``k`` best of each query that reach its floor, and all that rounding might put among them."""
    rows, cols, scores = [], [], []
    for i in range(0, len(asked), 512):
        s = asked[i : i + 512] @ units.T
        least = floor[i : i + 512]
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        r, c = np.nonzero(s >= least[:, None] - 2 * margin(units.shape[1]))
        rows.append(r + i)
        cols.append(ids[c])
        scores.append(s[r, c])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _compare(k: int):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "rough": pa.array([], pa.float32()), "slack": pa.array([], pa.float32())})
        units = _floats(left.column("unit"))
        r, c, s = _best(units, left.column("c").to_numpy(), _floats(right.column("asked")), right.column("floor").to_numpy(), k)
        return pa.table({"q": right.column("q").to_numpy()[r], "c": c, "rough": s.astype(np.float32), "slack": np.full(len(r), 2 * margin(units.shape[1]), np.float32)})

    return task


def _bucket_sizes(hashed: DataFrame) -> DataFrame:
    """Stored: (dim, key, parts): into how many tasks each bucket is dealt."""
    keys = hashed.select("dim", F.explode("keys").alias("key"))
    return stored(keys.groupBy("dim", "key").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "buckets")


def _probed(hashed: DataFrame, sizes: DataFrame, asked: DataFrame, projections: int, probes: range, k: int) -> DataFrame:
    """Stored PAIRS of the queries ``asked`` and the best classes in the buckets that they visit in these turns."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _same_length(batches):
            unit = _unit_rows(b)
            for i in range(0, len(unit), 64):
                all_keys = tables_of(unit.shape[1], projections).probes(unit[i : i + 64], probes.stop)[:, :, probes.start :]
                keys = [np.unique(x) for x in all_keys]
                q, dim = (np.repeat(b.column(x).to_numpy()[i : i + 64], list(map(len, keys))) for x in ("c", "dim"))
                yield pa.RecordBatch.from_pydict({"q": q, "dim": dim, "key": np.concatenate(keys)})

    wanted = stored(map_arrow(asked.select("c", "dim", "vector"), visits, "q long, dim int, key long"), "visits")
    visitors = wanted.groupBy("dim", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = stored(sizes.join(visitors, ["dim", "key"]), "dealt")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    wanted = wanted.join(dealt, ["dim", "key"]).withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int"))
    wanted = wanted.withColumn("part", every(F.col("parts"))).drop("parts", "blocks")
    units = hashed.select("c", F.col("unit").alias("asked")).join(asked.select("c", "floor"), "c").withColumnRenamed("c", "q")
    wanted = wanted.join(units, "q")
    large = dealt.where("parts > 1 or blocks > 1")
    rows = hashed.select("c", "dim", "unit", F.explode("keys").alias("key")).join(large, ["dim", "key"], "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1))).cast("int"))
    rows = rows.withColumn("block", every(F.coalesce("blocks", F.lit(1)))).drop("parts", "blocks")
    key = ["dim", "key", "part", "block"]
    return stored(rows.groupBy(key).cogroup(wanted.groupBy(key)).applyInArrow(_compare(k), PAIRS), "pairs")


def _whole(hashed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """PAIRS of the queries ``asked`` and the best of all classes, compared in blocks."""
    n, m = hashed.count(), asked.count()
    shards, blocks = max(1, -(-n // PART)), max(1, -(-m // BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = hashed.select("c", "dim", "unit", deal("c", shards).alias("shard"), every(blocks).alias("block"))
    right = hashed.join(asked.select("c"), "c", "left_semi").select(F.col("c").alias("q"), F.col("dim").alias("dim"), F.col("unit").alias("asked"), F.lit(-9.0).cast("float").alias("floor"), deal("c", blocks).alias("block"), every(shards).alias("shard"))
    key = ["dim", "shard", "block"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(_compare(k), PAIRS)


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _leading(pairs: DataFrame, k: int) -> DataFrame:
    """(q, c, least) of the pairs that may be among the ``k`` best of their query; least: the k-th best less what rounding may hide."""
    # dealt by query once: copies of a pair are dropped and the k-th best is found where they lie
    pairs = pairs.repartition("q").groupBy("q", "c").agg(F.max("rough").alias("rough"), F.max("slack").alias("slack"))
    whole = Window.partitionBy("q").orderBy(F.desc("rough")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = pairs.withColumn("least", F.coalesce(F.nth_value("rough", k).over(whole), F.lit(-9.0)) - F.col("slack"))
    return pairs.where(F.col("rough") >= F.col("least")).select("q", "c", "least")


def _reranked(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(q, found): the ``k`` best rows of each query by exact cosine, ties to smaller ids."""
    pairs = _leading(pairs, k).drop("least").join(classes.select("c", "vector", "members"), "c")
    pairs = pairs.join(classes.select(F.col("c").alias("q"), F.col("vector").alias("asked")), "q")
    each = pairs.select("q", _cosine(F.col("vector"), F.col("asked")).alias("score"), F.explode("members").alias("m")).select("q", "score", "m.*")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    each = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "score", "id", "uid"))).alias("found"))  # k at most


def _neighbours_of(sample: list[np.ndarray], classes: DataFrame, k: int) -> list[np.ndarray]:
    """For each unit vector of the sample, the unit vectors of the ``k`` best other classes, found among all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in sample]
        for b in _same_length(batches):
            unit = _unit_rows(b)
            for i, q in enumerate(sample):
                if len(q) == unit.shape[1]:
                    s = unit @ q
                    s[s > 1 - 1e-12] = -9  # itself
                    top = np.argpartition(-s, min(k, len(s)) - 1)[:k]
                    best[i] = sorted(best[i] + [(float(s[j]), unit[j].tolist()) for j in top if s[j] > -9], reverse=True)[:k]
        rows = [(i, s, u) for i, found in enumerate(best) for s, u in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["i", "s", "u"])

    found = map_arrow(classes.select("dim", "vector"), run, "i int, s double, u array<double>")
    order = Window.partitionBy("i").orderBy(F.desc("s"))
    rows = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect()  # FIT_QUERIES * k rows at most
    return [np.array([r.u for r in rows if r.i == i]).reshape(-1, len(q)) for i, q in enumerate(sample)]


def fitted(classes: DataFrame, asked: DataFrame, rows: int, k: int) -> tuple[int, int, float]:
    """(projections, probes a table, recall measured) for these rows and queries."""
    sample = [np.array(r.vector) for r in asked.orderBy(F.xxhash64("c"), "c").limit(FIT_QUERIES).collect()]
    sample = [v / np.abs(v).max() for v in sample]
    sample = [v / np.sqrt((v * v).sum()) for v in sample]
    near = _neighbours_of(sample, classes, k)
    for projections in range(projections_for(rows), 0, -1):
        probes, found = probes_needed(sample, near, projections)
        if found >= RECALL:
            break
    return projections, probes, found


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found nearest to each row where ``is_query`` holds.

    Rows whose vector is null, empty, zero or holds nulls or non-finite numbers take no part; vectors
    are only compared with others of their length. A row is never its own neighbour, but a repeated row
    is that of its twin. Ties go to the smaller id; null ids come last and are no queries. Vectors
    with numbers beyond 1e150, or none beyond 1e-150, are scaled by their largest number before their
    cosines are taken, so that nothing overflows. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = ref(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound).select(ref(id_col).cast("long").alias("id"), v.alias("vector"), F.coalesce(is_query & ref(id_col).isNotNull(), F.lit(False)).alias("asks"))
    most = F.array_max(F.transform("vector", F.abs))
    scaled = F.when((most > 1e150) | (most < 1e-150), F.transform("vector", lambda x: x / most)).otherwise(F.col("vector"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id", scaled.alias("vector"), "asks"), "vectors")
    copies = Window.partitionBy("vector").orderBy(F.asc_nulls_last("id"), "uid")
    firsts = rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    classes = firsts.groupBy("vector").agg(F.collect_list(F.struct("id", "uid")).alias("members"))  # k + 1 at most
    classes = stored(classes.select(F.monotonically_increasing_id().alias("c"), "vector", "members", F.size("vector").alias("dim")), "classes")
    queries = stored(rows.where("asks").join(classes.select("vector", "c"), "vector").select("uid", "id", "c"), "queries")
    asked = stored(classes.join(queries.select("c").distinct(), "c", "left_semi").select("c", "vector", "dim"), "asked")
    projections, probes, _ = fitted(classes, asked, classes.count(), k)
    hashed = stored(_hashed(classes, projections), "hashed")
    sizes, anything = _bucket_sizes(hashed), F.lit(-9.0).cast("float")
    own = _probed(hashed, sizes, asked.withColumn("floor", anything), projections, range(1), k + 1)
    floors = _leading(own, k + 1).groupBy(F.col("q").alias("c")).agg(F.max("least").cast("float").alias("floor"))
    floored = stored(asked.join(floors, "c", "left").withColumn("floor", F.coalesce("floor", anything)), "floors")
    pairs = own.unionByName(_probed(hashed, sizes, floored, projections, range(1, probes), k + 1)) if probes > 1 else own
    found = stored(_reranked(pairs, classes, k + 1), "found")
    # queries with too few found, where there are more rows of their length
    there = classes.groupBy("dim").agg(F.sum(F.size("members")).alias("there"))
    short = asked.join(found.select(F.col("q").alias("c"), F.size("found").alias("n")), "c", "left").join(there, "dim")
    short = stored(short.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k + 1), F.col("there"))).select("c"), "short")
    if short.count():
        rest = _reranked(_whole(hashed, short, k + 1), classes, k + 1)
        found = found.join(short.select(F.col("c").alias("q")), "q", "left_anti").unionByName(rest)
    others = F.filter("found", lambda x: x["uid"] != F.col("uid"))
    result = queries.join(found.withColumnRenamed("q", "c"), "c").select("id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return result.select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows of ``embeddings`` found nearest to each row whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
