"""k-means with ns-bounds: exact Lloyd rounds on integer vectors that rescan few rows.

A component x becomes the integer floor(SCALE * x). Every vector keeps an upper bound of the distance to its own centroid
and a lower bound for every centroid, each with the round in which it was an exact distance. The history of all centroids is
retained, so a bound is loosened by the norm of its centroid's *total* displacement since that round, which is never more
than the sum of the moves in between. Where upper < lower for every other centroid, the row keeps its centroid
without a distance; else the distance to its own centroid is taken anew, and rows that still fail are rescanned exactly
against all centroids. Distances are 64-bit integers and bounds are rounded away from a wrong decision, so the
result is that of full scans, ties included (the smaller number).

Layout. Vectors are packed into blocks of one Arrow batch and stored once as a table bucketed by block number. The
state of a round (centroid, bounds and their rounds: 5 * k + 6 bytes a vector) is another table bucketed alike, so vectors meet
their state without a shuffle. The number of buckets grows with the vectors, so a task holds ``PER_BUCKET`` of them or about
that. A round is one pass: it writes the new state and, for each block, by how much the sums and counts of the
centroids change; only these go on, summed in the tasks first. The driver holds k * dim numbers of each round. A lost
executor costs its tasks of one round.

Defined results: a vector with another number of components, or a null or non-finite one, is left out; a null id counts as the
empty text in the hash; repeated rows are vectors of their own (of equal hashes the smaller components start first); with
fewer than k vectors there are fewer centroids; an empty table gives an empty result; other columns are ignored. A component beyond
2**26 after scaling ends the job with an error that says so, as distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.llm.common import map_arrow
from areascope.session import ensure_checkpoint_dir, materialize

#: Components, clusters, rounds, integer scale, salt of the hash that picks the first centroids.
DIM, K, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
#: Largest scaled component; vectors of a bucket.
LIMIT, PER_BUCKET = 1 << 26, 200_000


@dataclass
class Clustering:
    """``rows``: (id, cluster, distance); ``history``: the centroids of each round, the last ones final;
    ``rescanned``: rows scanned against all centroids in each round after the first."""

    rows: DataFrame
    history: np.ndarray
    rescanned: list[int]


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, x): the sound vectors as arrays of ``dim`` integers."""
    x = F.col(vector).cast("array<double>")
    sound = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.when(F.abs(v * float(scale)) <= LIMIT, F.floor(v * float(scale))).otherwise(
        F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling: distances would not fit 64 bits")).cast("bigint")))
    return df.where(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).alias("id"), scaled.alias("x"))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids)."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _up(v: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(v.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _down(v: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(v.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


class Bounds:
    """The state of n vectors: centroid, upper bound and its round, lower bounds and their rounds."""

    def __init__(self, n: int, k: int, state: bytes | None = None):
        parts = [(np.uint8, (n,)), (np.float32, (n,)), (np.uint8, (n,)), (np.float32, (n, k)), (np.uint8, (n, k))]
        arrays, at = [], 0
        for kind, shape in parts:
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            arrays.append(np.zeros(shape, kind) if state is None else np.frombuffer(state, kind, int(np.prod(shape)), at).reshape(shape).copy())
            at += size
        self.own, self.upper, self.upper_at, self.lower, self.lower_at = arrays

    def dump(self) -> bytes:
        return b"".join(a.tobytes() for a in (self.own, self.upper, self.upper_at, self.lower, self.lower_at))

    def scan(self, rows: np.ndarray, x: np.ndarray, history: np.ndarray) -> None:
        """Exact distances of some rows to all centroids of the last round."""
        d, now = distances(x[rows], history[-1]), len(history) - 1
        own = d.argmin(axis=1)
        self.own[rows], self.upper_at[rows], self.lower_at[rows] = own, now, now
        self.upper[rows], self.lower[rows] = _up(d[np.arange(len(rows)), own]), _down(d)

    def assign(self, x: np.ndarray, history: np.ndarray) -> int:
        """Move every row to its nearest centroid of the last round; returns the number of rows scanned."""
        now, every = len(history) - 1, np.arange(len(x))
        # the norm of each centroid's total displacement since each round
        drift = np.sqrt(((history[-1] - history) ** 2).sum(axis=2).astype(np.float64)) * (1 + 1e-9)
        upper = self.upper + drift[self.upper_at, self.own]
        lower = self.lower - drift[self.lower_at, np.arange(self.lower.shape[1])]
        lower[every, self.own] = np.inf
        nearest = lower.min(axis=1)
        fail = np.flatnonzero(~(nearest > upper))
        exact = _up(((x[fail] - history[-1][self.own[fail]]) ** 2).sum(axis=1))
        self.upper[fail], self.upper_at[fail] = exact, now
        fail = fail[~(nearest[fail] > exact)]
        self.scan(fail, x, history)
        return len(fail)


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Sums and counts of each centroid's rows (k x (dim + 1))."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    for j in range(k):
        mine = x[own == j]
        out[j, :-1], out[j, -1] = mine.sum(axis=0), len(mine)
    return out


def _pack(vectors: DataFrame, dim: int) -> DataFrame:
    """(block, ids, vectors): one row for each Arrow batch."""
    kind = vectors.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([x.tobytes()])], ["block", "ids", "vectors"])
                block += 1

    return map_arrow(vectors, run, T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
                                                 T.StructField("vectors", T.BinaryType())]))


class _Store:
    """Bucketed tables under the shared folder; ``close`` takes their names out of the catalog."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/areascope"

    def put(self, df: DataFrame) -> DataFrame:
        name = f"areascope_ns_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "block").option("path", f"{self.root}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _rows(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[tuple]:
    """(block, ids, x, bounds) of each block; bounds are None without a state."""
    for batch in batches:
        stateful = batch.num_columns > 3
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(2)[i].as_py(), np.int32).reshape(-1, dim).astype(np.int64)
            yield batch.column(0)[i].as_py(), batch.column(1)[i].values, x, Bounds(len(x), k, batch.column(3)[i].as_py()) if stateful else None


def _round(blocks: DataFrame, history: np.ndarray, dim: int) -> DataFrame:
    """(block, state, moved): the state after a round, and the changes of sums and counts, with the rows scanned last."""
    k = history.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, x, bounds in _rows(batches, dim, k):
            if bounds is None:
                bounds, scanned = Bounds(len(x), k), len(x)
                bounds.scan(np.arange(len(x)), x, history)
                moved = _sums(x, bounds.own, k)
            else:
                before = bounds.own.copy()
                scanned = bounds.assign(x, history)
                at = np.flatnonzero(before != bounds.own)
                moved = _sums(x[at], bounds.own[at], k) - _sums(x[at], before[at], k)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bounds.dump()]), pa.array([[*moved.ravel().tolist(), scanned]])],
                                             ["block", "state", "moved"])

    return map_arrow(blocks, run, "block bigint, state binary, moved array<bigint>")


def _last(blocks: DataFrame, history: np.ndarray, dim: int) -> DataFrame:
    """(id, cluster, distance) by the final centroids."""
    k = history.shape[1]
    kind = blocks.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x, bounds in _rows(batches, dim, k):
            if bounds is None:
                bounds = Bounds(len(x), k)
                bounds.scan(np.arange(len(x)), x, history)
            else:
                bounds.assign(x, history)
            d = ((x - history[-1][bounds.own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(bounds.own.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    return map_arrow(blocks, run, T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()),
                                                T.StructField("distance", T.LongType())]))


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS,
            scale: int = SCALE, salt: str = SALT) -> Clustering:
    """k-means of the sound vectors: ``rounds`` rounds from the k vectors with the smallest salted hashes, then one assignment."""
    spark = df.sparkSession
    vectors = integer_vectors(df, vec_id, vector, dim, scale)
    if not (0 < k < 256 and 0 <= rounds < 255):
        raise ValueError("numbers of clusters and rounds are kept in one byte")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()     # k rows
    history = np.array([r["x"] for r in start], np.int64).reshape(1, len(start), dim)
    if not start:
        empty = spark.createDataFrame([], T.StructType([vectors.schema["id"], T.StructField("cluster", T.IntegerType()),
                                                        T.StructField("distance", T.LongType())]))
        return Clustering(empty, history, [])
    k, n = len(start), vectors.count()
    store = _Store(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PER_BUCKET)))
    packed = store.put(_pack(vectors, dim).repartition(store.buckets, "block"))
    sums, rescanned, blocks = np.zeros((k, dim + 1), np.int64), [], packed
    for _ in range(rounds):
        state = store.put(_round(blocks, history, dim))
        change = state.select(F.posexplode("moved").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).collect()  # k * (dim + 1) + 1
        change = np.array([r["v"] for r in sorted(change)], np.int64)
        sums, now = sums + change[:-1].reshape(k, dim + 1), history[-1].copy()
        rescanned.append(int(change[-1]))
        filled = sums[:, -1] > 0
        now[filled] = sums[filled, :-1] // sums[filled, -1:]
        history = np.concatenate((history, now[None]))
        blocks = packed.join(state.select("block", "state").hint("merge"), "block")
    rows = materialize(_last(blocks, history, dim), "clusters")
    store.close()
    return Clustering(rows, history, rescanned[1:])


def digest(result: Clustering) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = result.rows.sparkSession
    per = {r["cluster"]: r["d"] for r in result.rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}      # k rows
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in result.history[-1]] if len(result.history) else []
    small = spark.createDataFrame([(j, d, sum(per.values()), names[j]) for j, d in sorted(per.items())],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return result.rows.join(F.broadcast(small), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
