"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are rows of the table, picked from a bounded sample by the hash of their ids so that no two
of them are close to each other. Every vector is described by its ``nearest`` pivots, in their order. Inverted pivot
lists retrieve the vectors that share pivots; a pair is a candidate if it shares at least ``shared`` of them; the cosine
in double precision verifies it.

Equal vectors form a class that takes part once, with the number of its rows. A vector is listed under its
``nearest - shared + 1`` lowest-numbered pivots only, because the lowest pivot that a candidate pair shares is among
those, and a pair is looked at in the list of that pivot alone, so links are counted once. A list that is longer than a
block is split by the second lowest pivot that its candidates share, and what is still longer is dealt out as pairs of
blocks. A cell returns counts and a spanning forest of its links, never the pairs.

Fit: the number of pivots follows the number of vectors (``pivots_per_root`` times its square root), so lists grow with
its root only. The first ``spread`` pivots are far from each other; the others are rows as they come, so a group of close
vectors has pivots in proportion to its size and its lists do not grow with it. The sample is bounded by ``max_pivots``,
four times ``spread`` and, as vectors may be long, by ``sample_bytes``; beyond those bounds lists grow in proportion. Every
row is indexed.
The index may miss links: on the tables of the check tool it finds all, and a test asks for the recall. With
``max_pivots`` 1 all vectors share the one list, whose blocks are compared all with all: the exact way.

Defined results. Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null id,
have no links; a null id has a null component. Vectors of different lengths are not compared. Rows that share an id are
one component. Equal rows link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, left_join, table
from .components import connected_components, shared_id_edges


def _valid(values) -> np.ndarray | None:
    """The vector in double precision, scaled to length one; None if it can have no links."""
    if values is None or not len(values) or any(x is None for x in values):
        return None
    v = np.array(values, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    most = np.abs(v).max()
    if most == 0:
        return None
    v = v / most  # so that squares neither overflow nor vanish
    return v / np.sqrt(v @ v)


def _prepared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = [_valid(x) for x in batch.column(1).to_pylist()]
        raw = [None if v is None else v.tobytes() for v in vecs]
        keys = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "vec"]
        )


def pick_pivots(sample: list[np.ndarray], most: int, apart: float = 0.8, spread: int = 2048) -> np.ndarray:
    """``most`` vectors of the sample, or all of it: the first ``spread`` in its order that are no closer to each other than
    the cosine ``apart``, and then the first of the others.

    So large groups of close vectors get pivots of their own, and only ``spread`` pivots are compared with the sample.
    """
    width = max((len(v) for v in sample), default=0)
    rows = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        rows[i, : len(v)] = v
    chosen, taken, n = np.zeros((min(most, spread), width)), np.zeros(len(sample), bool), 0
    for at in range(0, len(rows), 1024):
        block = rows[at : at + 1024]
        near = (block @ chosen[:n].T).max(axis=1) if n else np.full(len(block), -1.0)
        before = n
        for i in np.flatnonzero(near < apart):
            if n == len(chosen):
                break
            if n == before or (chosen[before:n] @ block[i]).max() < apart:
                chosen[n], taken[at + i], n = block[i], True, n + 1
    return np.concatenate([chosen[:n], rows[~taken][: max(0, most - n)]])


def _described(pivots, nearest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.value
        for batch in batches:
            vecs = [np.frombuffer(x, np.float64) for x in batch.column("vec").to_pylist()]
            order = []
            for dim in {len(v) for v in vecs}:
                rows = [i for i, v in enumerate(vecs) if len(v) == dim]
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    sims = np.stack([vecs[i] for i in part])[:, : points.shape[1]] @ points[:, :dim].T
                    top = np.argsort(-sims, axis=1, kind="stable")[:, :nearest]
                    order += list(zip(part, top.tolist()))
            order = [o for _, o in sorted(order)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rows"), batch.column("vec"), pa.array(order, pa.list_(pa.int32()))],
                names=["id", "rows", "vec", "pivots"],
            )

    return run


def _cell(shared: int, cosine: float):
    def run(cell: pa.Table) -> pa.Table:
        ids, weight = cell.column("id").to_numpy(), cell.column("rows").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, weight = ids[by_id], weight[by_id]
        own = cell.column("own").to_numpy()[by_id]
        one, other, pivot = (cell.column(c)[0].as_py() for c in ("x", "y", "pivot"))
        raw = cell.column("vec").to_pylist()
        vecs = np.stack([np.frombuffer(raw[i], np.float64) for i in by_id])
        lists = cell.column("pivots").to_pylist()
        names, inv = np.unique(np.concatenate([lists[i] for i in by_id]), return_inverse=True)
        member = np.zeros((len(ids), len(names)), np.float32)
        member[np.repeat(np.arange(len(ids)), [len(lists[i]) for i in by_id]), inv] = 1
        # The cell's pivot is the least that a pair shares, and its second pivot, if it has one, the next.
        second = cell.column("second")[0].as_py()
        low = member[:, (names < pivot) | ((names > pivot) & (names < second))] if second >= 0 else member[:, names < pivot]
        left = np.flatnonzero(own == one)
        right = left if one == other else np.flatnonzero(own == other)
        links, root, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            found = (member[rows] @ member[right].T >= shared) & (low[rows] @ low[right].T == 0)
            # Verified by the cosine, for candidates only.
            found &= vecs[rows] @ vecs[right].T >= cosine
            if one == other:
                found[np.arange(len(rows)), at + np.arange(len(rows))] = False
            else:
                links[right] += weight[rows] @ found
            links[rows] += found @ weight[right]
            for r, hits in zip(rows, found):
                joined = right[hits]
                for j in joined[root[joined] != root[r]]:
                    a, b = root[r], root[j]
                    if a != b:
                        edges.append((int(ids[r]), int(ids[j]), 0))
                        root[root == b] = a
        some = np.flatnonzero(links)
        every = [(int(ids[i]), None, int(links[i])) for i in some] + edges
        cols = zip(*every) if every else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

    return run


def near_vectors(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    cosine: float = 0.95,
    nearest: int = 8,
    shared: int = 2,
    pivots_per_root: float = 4.0,
    max_pivots: int = 65_536,
    sample_bytes: int = 64 << 20,
    block_rows: int = 2_000,
    spread: int = 2_048,
) -> DataFrame:
    """Return for each row its id (long), ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` is the number of other rows with a cosine of at least ``cosine`` among the candidates.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    base = cut(rows.mapInArrow(_prepared, "id long, key binary, vec binary"))
    valid = base.where("key is not null and id is not null")
    classes = cut(valid.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.first("vec").alias("vec")))
    count, width = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(8))).first()
    most = max(1, min(max_pivots, math.ceil(pivots_per_root * math.sqrt(count)), sample_bytes // width))
    wanted = min(max(most, 4 * min(most, spread)), max(most, sample_bytes // width))
    sample = classes.orderBy(F.xxhash64("id", F.lit(7)), "key").limit(wanted).select("vec").collect()
    points = pick_pivots([np.frombuffer(r.vec, np.float64) for r in sample], most, spread=spread)
    pivots = spark.sparkContext.broadcast(points)

    described = cut(
        classes.select("id", "rows", "vec").mapInArrow(
            _described(pivots, nearest), "id long, rows long, vec binary, pivots array<int>"
        )
    )
    few = min(shared, len(points))
    listed = described.select(
        "*", F.explode(F.slice(F.array_sort("pivots"), F.lit(1), F.greatest(F.size("pivots") - few + 1, F.lit(1)))).alias("pivot"),
        F.octet_length("vec").alias("dim"),
    )
    # A list that is longer than a block is split by the next pivot that its vectors have, which candidates share as well.
    long = listed.groupBy("pivot", "dim").agg(F.count("*").alias("c")).where("c > 1")
    later = F.filter(F.array_sort("pivots"), lambda q: q > F.col("pivot"))
    seconds = F.when((F.col("c") > block_rows) & F.lit(few > 1), later).otherwise(F.array(F.lit(-1)))
    split = listed.join(long, ["pivot", "dim"]).select("pivot", "dim", "id", "rows", "vec", "pivots", F.explode(seconds).alias("second"))
    lengths = split.groupBy("pivot", "dim", "second").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.count("*").alias("c"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = (
        split.join(lengths.where("c > 1"), ["pivot", "dim", "second"])
        .select("pivot", "dim", "second", "id", "rows", "vec", "pivots", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("z"))
        .select("pivot", "dim", "second", "id", "rows", "vec", "pivots", "own", F.least("own", "z").alias("x"), F.greatest("own", "z").alias("y"))
    )
    found = cut(
        cells.groupBy("pivot", "dim", "second", "x", "y").applyInArrow(_cell(few, cosine), "a long, b long, links long")
    )
    labels = connected_components(found.where("b is not null").select("a", "b").unionAll(shared_id_edges(valid.select("id", "key"), classes.select("key", "id"))))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    # Only classes of several rows or with links differ from a row that stands alone.
    named = (
        classes.select("key", "id", "rows").join(labels, F.col("id") == F.col("node"), "left").join(links, F.col("id") == F.col("a"), "left")
        .where("rows > 1 or links is not null")
        .select("key", F.coalesce("component", "id").alias("component"), (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    )
    joined = left_join(base.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")), named, "key")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of the whole table at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
