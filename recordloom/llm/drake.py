"""Centroid clustering with Drake's adaptive bounds: every assignment is exact, most distances are never computed.

Each vector keeps the centroid that it is in, lower bounds for its ``b`` next nearest centroids in their order, and one
lower bound for all the others. After the centroids have moved, each bound gives way by the distance its centroid moved,
the last one by the longest such distance. The exact distance to the own centroid then certifies an order: if it is below
the least of the bounds from the z-th on, only the first z - 1 listed centroids can be nearer and are measured; if nothing
certifies it, all centroids are. ``b`` starts at a quarter of the centroids and shrinks to the most that any vector
needed, but not below an eighth.

Components become integers, so distances and sums are exact; bounds are doubles rounded against themselves, and a vector
within the rounding is measured again, so ties are never decided by a bound.

A round reads the table of the last one and writes the next; a task adds up the components of the vectors that changed
their cluster, so only differences of sums travel, one row for each task and cluster. The driver holds the centroids and
their sums, ``k`` rows; ``k`` times the components is bounded by ``max_numbers``. No vector is shuffled, so it does not
matter how many are equal or in one cluster.

Defined results. Vectors that are null, of another length, or hold null or non-finite components are left out, as is all
if none is left. A null id is kept, and such vectors are the last to be starting centroids. Rows that share an id are
clustered each by its own vector; of equal hashes the vector with the lesser bytes starts first. Fewer vectors than ``k``
give as many centroids. Equal centroids are told apart by their number. A component above 2**27 after scaling is refused
with an error, as its squares would not fit a long. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_path, table, written

#: Bounds are kept this much (relatively) on the safe side; doubles are far finer.
MARGIN = 1e-12
LARGEST = 1 << 27
_FIELDS = "vec binary, own int, distance bigint, near binary, low binary, rest double, cluster int, n bigint, sums array<bigint>, used int"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows (n, d) and (m, d), as integers. Doubles are exact while below 2**53."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if a.shape[1] * 4 * float(most) ** 2 < 2**53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


def squared_to(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to the rows beside them."""
    d = a - b
    return (d * d).sum(-1)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - MARGIN)


class Bounds:
    """The bounds of the vectors of a batch: ``own``, ``near`` and ``low`` (n, b), ``rest`` (n)."""

    def __init__(self, vectors: np.ndarray, centroids: np.ndarray, b: int):
        n = len(vectors)
        self.vectors, self.centroids, self.b = vectors, centroids, min(b, len(centroids) - 1)
        self.own, self.distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.near, self.low, self.rest = np.zeros((n, self.b), np.int64), np.zeros((n, self.b)), np.zeros(n)

    def scan(self, rows: np.ndarray) -> None:
        """Measure all centroids."""
        k, step = len(self.centroids), max(1, (1 << 22) // len(self.centroids))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            d2 = squared(self.vectors[part], self.centroids)
            order = np.argsort(d2, axis=1, kind="stable")[:, : self.b + 2]  # stable: of equal ones the smaller number
            found = np.take_along_axis(d2, order, axis=1)
            self.own[part], self.distance[part] = order[:, 0], found[:, 0]
            self.near[part], self.low[part] = order[:, 1 : self.b + 1], _below(found[:, 1 : self.b + 1])
            self.rest[part] = _below(found[:, self.b + 1]) if k > self.b + 1 else np.inf

    def some(self, rows: np.ndarray, z: int) -> None:
        """Measure the own and the first ``z`` listed centroids, which hold the nearest."""
        step = max(1, (1 << 20) // ((z + 1) * self.vectors.shape[1]))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            some = np.sort(np.concatenate([self.own[part, None], self.near[part, :z]], axis=1), axis=1)
            d2 = squared_to(self.vectors[part, None, :], self.centroids[some])
            order = np.argsort(d2, axis=1, kind="stable")
            some, d2 = np.take_along_axis(some, order, axis=1), np.take_along_axis(d2, order, axis=1)
            self.own[part], self.distance[part] = some[:, 0], d2[:, 0]
            self.near[part, :z], self.low[part, :z] = some[:, 1:], _below(d2[:, 1:])

    def moved(self, own: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray, moves: np.ndarray) -> int:
        """Take over the bounds of the last round, in which the centroids moved by ``moves``; the most bounds needed."""
        dropped = low[:, self.b :] - moves[near[:, self.b :]]
        self.own, self.near = own.copy(), near[:, : self.b].copy()
        self.low = (low[:, : self.b] - moves[self.near]) * 1.0
        self.rest = np.minimum(rest - moves.max(initial=0), dropped.min(axis=1, initial=np.inf))
        self.low -= np.abs(self.low) * MARGIN
        self.rest = np.where(np.isinf(self.rest), self.rest, self.rest - np.abs(np.where(np.isinf(self.rest), 0, self.rest)) * MARGIN)
        self.distance = squared_to(self.vectors, self.centroids[self.own])
        above = np.sqrt(self.distance.astype(np.float64)) * (1 + MARGIN)
        least = np.minimum.accumulate(np.concatenate([self.low, self.rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        open_ = (least <= above[:, None]).sum(axis=1)  # leading ones, as ``least`` never falls
        for z in np.unique(open_):
            if 0 < z <= self.b:
                self.some(np.flatnonzero(open_ == z), int(z))
        self.scan(np.flatnonzero(open_ > self.b))
        return int(np.minimum(open_, self.b).max(initial=0))


def _packed(dim: int, scale: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            values = np.floor(scale * flat)
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError(f"a component above 2**27 / {scale} has no exact distance in a long")
            raw = values.astype("<i4").tobytes()
            size = 4 * dim
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[i * size : (i + 1) * size] for i in range(batch.num_rows)], pa.binary())], names=["id", "vec"])

    return run


def _numbers(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _rows(values: np.ndarray, kind: str) -> pa.Array:
    raw, size = np.ascontiguousarray(values.astype(kind)).tobytes(), values.shape[1] * np.dtype(kind).itemsize
    return pa.array([raw[i * size : (i + 1) * size] for i in range(len(values))], pa.binary())


def _assigned(centroids: np.ndarray, moves: np.ndarray | None, b: int, arrow: pa.Schema):
    k, dim = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, used = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0

        def record(size: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(size, f.type) for f in arrow], schema=arrow)

        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                n = batch.num_rows
                vectors = _numbers(batch.column("vec"), "<i4", n).astype(np.int64)
                bounds = Bounds(vectors, centroids, b)
                if moves is None:
                    bounds.scan(np.arange(n))
                    changed = np.arange(n)
                else:
                    own = batch.column("own").to_numpy().astype(np.int64)
                    near, low = _numbers(batch.column("near"), "<i4", n).astype(np.int64), _numbers(batch.column("low"), "<f8", n)
                    used = max(used, bounds.moved(own, near, low, batch.column("rest").to_numpy(), moves))
                    changed = np.flatnonzero(own != bounds.own)
                    np.subtract.at(counts, own[changed], 1)
                    np.subtract.at(sums, own[changed], vectors[changed])
                np.add.at(counts, bounds.own[changed], 1)
                np.add.at(sums, bounds.own[changed], vectors[changed])
                yield record(
                    n, id=batch.column("id"), vec=batch.column("vec"), own=pa.array(bounds.own, pa.int32()), distance=pa.array(bounds.distance),
                    near=_rows(bounds.near, "<i4"), low=_rows(bounds.low, "<f8"), rest=pa.array(bounds.rest),
                )
        other = np.flatnonzero((counts != 0) | (sums != 0).any(axis=1))
        yield record(
            len(other) + 1, cluster=pa.array([*other.tolist(), None], pa.int32()), n=pa.array([*counts[other].tolist(), None], pa.int64()),
            sums=pa.array([*sums[other].tolist(), None], pa.list_(pa.int64())), used=pa.array([None] * len(other) + [used], pa.int32()),
        )

    return run


def starting_vectors(packed: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``seed:id``, in the order of their hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = packed.select(hashed.alias("h"), "vec").orderBy(F.asc_nulls_last("h"), "vec").limit(k).collect()
    return np.stack([np.frombuffer(r.vec, "<i4") for r in first]).astype(np.int64) if first else np.zeros((0, 0), np.int64)


def cluster_vectors(
    df: DataFrame, id_col: str, vec_col: str, k: int = 40, dim: int = 64, rounds: int = 5, scale: int = 256, seed: int = 2, max_numbers: int = 1 << 22
) -> tuple[DataFrame, np.ndarray]:
    """The assignment to ``k`` centroids after ``rounds`` rounds: (id, ``cluster``, ``distance``), and the centroids.

    The centroids are an integer array, one row for each. Distances are squared.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if k < 1 or rounds < 0 or k * dim > max_numbers:
        raise ValueError(f"centroids of more than {max_numbers} numbers, or none at all")
    spark, vec = df.sparkSession, F.col(f"`{vec_col}`")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # A conditional, as the components are looked at only if there are ``dim`` of them.
    kept = df.where(F.when(F.size(vec) == dim, finite).otherwise(False)).select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec"))
    kind, paths = kept.schema["id"].dataType.simpleString(), []
    state = written(kept.mapInArrow(_packed(dim, scale), f"id {kind}, vec binary"), "vectors", paths)
    centroids, moves = starting_vectors(state, k, seed), None
    if not len(centroids):
        return state.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).withColumnRenamed("id", id_col), centroids
    schema = f"id {kind}, {_FIELDS}"
    arrow, b = to_arrow_schema(_parse_datatype_string(schema)), max(1, len(centroids) // 4)
    sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
    for n in range(rounds + 1):
        state = written(state.where("vec is not null").mapInArrow(_assigned(centroids, moves, b, arrow), schema), "assigned", paths)
        remove_path(spark, paths.pop(0))
        if n == rounds:
            break
        shifts = state.where("cluster is not null").select("cluster", "n", "sums")
        for c, m in shifts.groupBy("cluster").agg(F.sum("n")).collect():
            counts[c] += m
        for c, i, s in shifts.select("cluster", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s")).collect():
            sums[c][i] += s
        after = np.array([[s // m for s in row] if m else old for row, m, old in zip(sums, counts, centroids.tolist())], dtype=np.int64)
        moves = np.sqrt(squared_to(after, centroids).astype(np.float64)) * (1 + MARGIN)
        used = state.agg(F.max("used")).first()[0]
        b = min(b, max(1, len(centroids) // 8, used)) if n else b
        centroids = after
    out = state.where("vec is not null").select(F.col("id").alias(id_col), F.col("own").alias("cluster"), "distance")
    return out, centroids


def cluster_digest(df: DataFrame, id_col: str, vec_col: str, **options) -> DataFrame:
    """``cluster_vectors`` with the sums of distances by cluster and over all, and a hash of each final centroid."""
    found, centroids = cluster_vectors(df, id_col, vec_col, **options)
    hashes = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    sums = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    rows = [(c, sums.get(c, 0), sum(sums.values()), h) for c, h in enumerate(hashes)]
    # One row for each centroid.
    named = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    """Forty clusters of all embeddings of 64 components after five rounds."""
    return cluster_digest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
