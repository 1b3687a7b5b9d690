"""Connected components of an edge table by alternating large and small stars, without collecting anything.

The edges are first dealt by their lesser end, and each partition replaces them by the stars of its own union-find
forests, so that no more edges than nodes are left of it and most small components are done. Then large-star links every larger neighbour of a node to the least node around it, and small-star does so
for the smaller ones, until the edges are stars around the least node of each component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


class UnionFind:
    """Disjoint sets named by their least member."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _local_stars(batches: Iterable[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Stars of the forests of about ``most`` edges at a time, so the memory held is bounded."""

    def stars(sets: UnionFind) -> pa.RecordBatch:
        nodes = list(sets.parent)
        arrays = [pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
        if len(sets.parent) >= most:
            yield stars(sets)
            sets = UnionFind()
    yield stars(sets)


def shared_id_edges(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes (key, id) of rows (id, key) that share an id but not a key."""
    several = rows.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("id")
    held = rows.join(several, "id", "left_semi").distinct().join(classes.select("key", F.col("id").alias("b")), "key")
    return held.groupBy("id").agg(F.min("b").alias("a"), F.collect_set("b").alias("bs")).select("a", F.explode("bs").alias("b")).where("a <> b")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, after_round: Callable[[], None] = lambda: None) -> DataFrame:
    """``edges`` has two long columns of node ids. Returns ``node`` and ``component``, the least node reachable.

    Only nodes with an edge to another node are returned; edges with a null end and loops say nothing. ``after_round`` is
    called once the tables of a round before are no longer needed.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    stars = cut(edges.repartition(F.least("a", "b")).mapInArrow(_local_stars, "a long, b long").where("a <> b").distinct())
    before = _digest(stars)
    while True:
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Here a > b holds, so all neighbours of a are smaller.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        del both, least, large, small
        after_round()
        now = _digest(stars)
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
