"""Near-duplicate documents by bottom-k sketches from one hash function.

The path of a document: its set of word shingles is hashed by one function, and documents with equal sets form a class
that is represented by its least id. A class keeps a sketch, the ``k`` least hash values of its set.

1.  Inverted lists of retained values. Values are ordered by how many sketches hold them, the rarest first. Two sketches
    that share at least ``t`` values share one among the first ``m - t + 1`` values of either, so only those are listed,
    and a sketch that has fewer than ``t`` values in common with any other is dropped at once. Passages that many
    documents share come last in this order and make no lists.
2.  Sketches connected through lists form a group, which is compared inside tasks: in one cell if it is small, and
    otherwise in cells of two blocks each. In a cell, inverted lists give the overlap of every pair and the rank of the
    shared values in the union; that is the bottom-k sketch of the union, whose estimate drops pairs with fewer hits
    than a pair at the threshold has but with a probability of ``MISS``.
3.  Exact Jaccard similarity on the full sets decides. A pair that earlier links have already joined is skipped, so a
    cell returns a spanning forest of its links rather than all pairs.
4.  The forests' edges give connected components.

``t`` is the least number of shared values that a pair at the threshold can have: exact for sets that their sketch holds
whole, and otherwise the quantile of the binomial distribution for ``k`` values below which a pair at the threshold
falls with a probability of at most ``MISS``, one in a thousand million (the sketch is drawn without replacement, which
varies less). Pairs above the threshold are missed less often still.

Defined results. Null and empty texts have no shingles and link with nothing; texts shorter than a shingle are one
shingle; rows with a null id link with nothing and get a null component; rows that share an id are one document, whose
links are those of all its rows; equal rows share a class; an empty table gives an empty result; further columns are
not looked at. Texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, left_join, table
from .components import connected_components, shared_id_edges

MISS = 1e-9
GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(limit: int = 200_000) -> Memo:
    """Memo of word -> 64-bit hash."""
    return Memo(xxhash.xxh3_64_intdigest, limit)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values: multiply and shift, twice."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int, memo: Memo) -> np.ndarray:
    """Sorted distinct hash values (int64) of a text's shingles. Words are split at ASCII white space, A-Z lowered."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    h = np.array(list(map(memo.__getitem__, tokens)), dtype=np.uint64)
    size = min(words, len(h))
    n = len(h) - size + 1
    acc = np.full(n, size, np.uint64)
    for j in range(size):
        acc = _mix((acc * GOLD) ^ h[j : j + n])
    return np.unique(acc.view(np.int64))


def least_hits(percent: int, size: int) -> int:
    """The largest number of which a pair at the threshold has fewer hits among ``size`` values but with ``MISS``."""
    p, below, hits = percent / 100, 0.0, 0
    while hits < size:
        below += math.comb(size, hits) * p**hits * (1 - p) ** (size - hits)
        if below > MISS:
            break
        hits += 1
    return hits


def _sketches(id_type: str, words: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            keys, sizes, values, offsets = [], [], [], [0]
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words, memo)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                values.append(s[:k])
                offsets.append(offsets[-1] + len(values[-1]))
            flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                ],
                names=["id", "n", "key", "sketch"],
            )

    return run


def _full_sets(words: int):
    """(id, n, group, blocks, text) -> the same with the set's bytes in place of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, memo).tobytes() for t in batch.column("text")]
            cols = [batch.column(c) for c in ("id", "n", "grp", "blocks")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sets, pa.binary())], names=["id", "n", "grp", "blocks", "full"])

    return run


def _postings(lists: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Inverted lists of the values that at least two of ``lists`` hold.

    Returns for each value the start of its postings, for each list its (value numbers, ranks), and the postings' docs.
    """
    sizes = [len(x) for x in lists]
    flat = np.concatenate(lists)
    docs = np.repeat(np.arange(len(lists)), sizes)
    _, inv, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[inv]
    return number[inv[keep]], docs[keep], np.flatnonzero(keep) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)[keep]


class Cell:
    """Finds a spanning forest of the links among sets, or between two blocks of them."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], block: np.ndarray, k: int, percent: int):
        self.ids, self.sets, self.block, self.k, self.percent = ids, sets, block, k, percent

    def links(self) -> list[tuple[int, int]]:
        d, k = len(self.sets), self.k
        n = np.array([len(s) for s in self.sets])
        value, doc, rank = _postings([s[:k] for s in self.sets])
        if not len(value):
            return []
        order = np.lexsort((doc, value))
        post_doc, post_rank = doc[order], rank[order]
        start = np.searchsorted(value[order], np.arange(value.max() + 2))
        row = np.searchsorted(doc, np.arange(d + 1))
        m = np.minimum(n, k)
        two = self.block.min() != self.block.max()
        root = np.arange(d)
        exact = _Overlaps(self.sets)
        least = np.array([least_hits(self.percent, size) for size in range(k + 1)])
        out = []
        for i in range(d):
            if two and self.block[i] != 0:
                continue
            shared, inside = np.zeros(d, np.int32), np.zeros(d, np.int32)
            for v, r in zip(value[row[i] : row[i + 1]], rank[row[i] : row[i + 1]]):  # ascending values
                js = post_doc[start[v] : start[v + 1]]
                # The rank of v in the union: both ranks less the shared values below v.
                inside[js] += (post_rank[start[v] : start[v + 1]] + r - shared[js]) < k
                shared[js] += 1
            ok = (root != root[i]) & (shared > 0)
            ok &= (self.block == 1) if two else (np.arange(d) > i)
            ok &= 100 * np.minimum(n, n[i]) >= self.percent * np.maximum(n, n[i])
            js = np.flatnonzero(ok)
            if not len(js):
                continue
            size = np.minimum(k, m[i] + m[js] - shared[js])
            enough = inside[js] >= least[size]
            js = js[enough]
            js = js[np.argsort(-inside[js] / size[enough], kind="stable")]
            at = 0
            while at < len(js):
                part = js[at : at + 256]
                at += 256
                part = part[root[part] != root[i]]
                both = exact.count(i, part)
                for j in part[100 * both >= self.percent * (n[i] + n[part] - both)]:
                    a, b = root[i], root[j]
                    if a != b:
                        out.append((int(self.ids[i]), int(self.ids[j])))
                        root[root == b] = a
        return out


class _Overlaps:
    """Exact sizes of intersections: by bit rows over the values that two sets share, or set by set if those are many."""

    def __init__(self, sets: list[np.ndarray], most_bytes: int = 64 << 20):
        self.sets, self.bits = sets, None
        value, doc, _ = _postings(sets)
        width = -(-(int(value.max()) + 1 if len(value) else 0) // 8)
        width = -(-width // 8) * 8
        if 0 < width * len(sets) <= most_bytes:
            bits = np.zeros((len(sets), width), np.uint8)
            np.bitwise_or.at(bits, (doc, value >> 3), (1 << (value & 7)).astype(np.uint8))
            self.bits = bits.view(np.uint64)

    def count(self, i: int, js: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[js] & self.bits[i]).sum(axis=1, dtype=np.int64)
        a = self.sets[i]
        return np.array([len(np.intersect1d(a, self.sets[j], assume_unique=True)) for j in js], dtype=np.int64)


def _cell(k: int, percent: int):
    def run(cell: pa.Table) -> pa.Table:
        order = np.argsort(cell.column("id").to_numpy(), kind="stable")
        ids = cell.column("id").to_numpy()[order]
        raw = cell.column("full").to_pylist()
        sets = [np.frombuffer(raw[x], np.int64) for x in order]
        one, other = cell.column("x")[0].as_py(), cell.column("y")[0].as_py()
        block = (cell.column("own").to_numpy()[order] != one).astype(int) if one != other else np.zeros(len(ids), int)
        links = Cell(ids, sets, block, k, percent).links()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    percent: int = 80,
    words: int = 5,
    k: int = 64,
    block_rows: int = 1500,
    block_bytes: int = 24 << 20,
    broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """Return for each row its id (long), ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked if their shingle sets have a Jaccard similarity of at least ``percent`` hundredths.
    ``component_id`` is the least id reachable by links, itself included; ``kept`` marks the rows that have that id.
    ``block_rows`` and ``block_bytes`` bound one block of a group; a cell holds two. Up to ``broadcast_ids`` ids are
    broadcast to fetch texts a second time; beyond that they are joined by a shuffle.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    base = cut(docs.mapInArrow(_sketches("long", words, k), "id long, n long, key binary, sketch array<bigint>"))
    classes = base.where("key is not null and id is not null").groupBy("key")
    reps = classes.agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows")
    )

    # Inverted lists of retained values, the rarest first.
    values = reps.select("id", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    t = least_hits(percent, k)
    least = F.when(F.col("n") <= k, F.least(F.ceil(F.col("n") * percent / 100), F.lit(t))).otherwise(F.lit(t)).cast("int")
    ranked = (
        values.join(often, "v")
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("vs"))
        .where(F.size("vs") >= least)
        .select("id", "n", F.slice("vs", F.lit(1), F.size("vs") - least + 1).alias("vs"))
    )
    listed = cut(ranked.select("id", "n", F.explode("vs.v").alias("v")))
    hubs = listed.groupBy("v").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1")
    spokes = listed.join(hubs, "v").where("id <> hub").select("id", "hub").distinct()
    groups = connected_components(spokes)
    sized = groups.join(listed.select("id", "n").distinct(), F.col("node") == F.col("id"))
    sizes = sized.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("b"))
    blocks = F.greatest(F.ceil(F.col("c") / block_rows), F.ceil(F.col("b") * 8 / block_bytes)).cast("int")
    members = cut(
        sized.join(sizes.select("component", blocks.alias("blocks")), "component")
        .select("id", "n", F.col("component").alias("grp"), "blocks")
    )

    # Full sets of the members, once more from the texts.
    few = members.count() <= broadcast_ids
    texts = docs.join(F.broadcast(members) if few else members, "id")
    full = texts.mapInArrow(_full_sets(words), "id long, n long, grp long, blocks int, full binary")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = (
        full.select("id", "grp", "full", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("z"))
        .select("id", "grp", "full", "own", F.least("own", "z").alias("x"), F.greatest("own", "z").alias("y"))
    )
    edges = cells.groupBy("grp", "x", "y").applyInArrow(_cell(k, percent), "a long, b long")
    shared = shared_id_edges(base.where("key is not null and id is not null").select("id", "key"), reps.select("key", "id"))
    labels = connected_components(cut(edges.unionAll(shared)))

    # Only classes of several rows or with links can have another component than the row's own id.
    named = reps.join(labels, F.col("id") == F.col("node"), "left").select(
        "key", F.coalesce("component", "id").alias("component"), "rows", "id"
    )
    special = named.where("rows > 1 or component <> id").select("key", "component")
    return left_join(base.select("id", "n", "key"), special, "key", broadcast_ids).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", percent=85)
