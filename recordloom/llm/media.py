"""Copies among images by local descriptors: cropped, shifted or partly edited copies are found.

An image is a struct of ``width``, ``height`` and ``pixels`` (one grey byte a pixel, row by row).

1.  Corners are found at two scales (structure tensor, local maxima, the ``points`` strongest of each tile of 64
    pixels' side, or less by the area of a smaller tile, so that their number follows the size of the image), turned
    upright by the centroid of their surroundings, and described by 128 binary tests at fixed rotated places.
2.  Hamming tables: the descriptor of a listed point (the stronger six of ten) is cut into two words of 64 bits, each a
    key of its own table, so descriptors that differ in one bit always share a key, and farther ones if one of the words
    is spared. The tests have a margin, so most descriptors of a noisy, cut, turned or scaled copy keep a word (a test
    holds the recall of each kind). Two images meet if the smaller one shares ``MEET`` keys, or ``MEET_SHARE`` of its own,
    with the other. Keys are shuffled packed, in buckets. An image probes with its rarest keys, so many that a copy which shares ``share`` of them meets it by
    these. First every image is held against the least image that has its keys, which joins most
    groups of copies without pairing their members; then images of different groups that meet by keys of at most
    ``few`` images, pair by pair; and for groups that only keys of more images bring together, the shared keys of all
    with all are counted in cells of bounded blocks. So no key is too frequent to be followed, and none is paired out.
3.  Candidates are matched, descriptors within ``most_bits`` bits; geometric consensus keeps the matches that one
    similarity transform (scale, rotation, shift) explains; a pair is linked if these are at least six and ``share`` of
    the smaller image's points.
4.  Links, as spanning forests, give connected components. Identical images take part once.

There are no stored images among the tables, so the query draws each web page: every word of the visible text is a
small block pattern, paragraph after paragraph. The whole page is drawn, whatever its length.

Defined results. Null, empty and broken images, and images without corners, link with nothing, but for identical ones;
rows with a null id link with nothing and have a null component; rows that share an id are one component; an empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, left_join, map_batches, release, remove_path, table, written
from .components import connected_components, shared_id_edges

BITS, RADIUS, PATCH, TILE, LISTED = 128, 11, 16, 64, 0.6
#: A test says that its second place is brighter by more than eight grey levels (of sums of nine), so noise on flat ground says nothing.
MARGIN = 72
_rng = np.random.default_rng(20240607)
#: The places of the binary tests: pairs of points around a corner, and their rotations in steps of which 90 degrees is a
#: multiple, so that an image that lies on its side has the same descriptors.
_TESTS = np.clip(_rng.normal(0, 6, (BITS, 2, 2)), -11, 11)
_TURNS = 32
_ANGLES = np.arange(_TURNS) * 2 * np.pi / _TURNS
_ROTATED = np.rint(
    np.einsum("aij,tpj->atpi", np.array([[[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]] for a in _ANGLES]), _TESTS)
).astype(int)
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS**2])


def _window(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r + 1 of the last two axes, where they lie inside."""
    h, w = a.shape[-2:]
    rows = a[..., : h - 2 * r, :].copy()
    for d in range(1, 2 * r + 1):
        rows += a[..., d : h - 2 * r + d, :]
    out = rows[..., : w - 2 * r].copy()
    for d in range(1, 2 * r + 1):
        out += rows[..., d : w - 2 * r + d]
    return out


def _corners(soft: np.ndarray, tops: np.ndarray, heights: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Image, y and x of the local maxima of the corner response in images that lie one below the other, and which of
    them are listed.

    ``soft`` is their sums over squares of three, whose rows begin at ``tops``. Of every tile the strongest are taken:
    ``most``, or less by its area; the stronger ``LISTED`` of those are listed. Places whose surroundings reach over an
    edge are none.
    """
    soft = soft / np.float32(9)
    gy, gx = soft[2:, 1:-1] - soft[:-2, 1:-1], soft[1:-1, 2:] - soft[1:-1, :-2]
    a, b, c = _window(np.stack([gx * gx, gy * gy, gx * gy]), 2)
    trace = a + b
    r = a * b - c * c - np.float32(0.05) * trace * trace
    h, w = r.shape
    tall = r[: h - 4].copy()
    for d in range(1, 5):
        np.maximum(tall, r[d : h - 4 + d], out=tall)
    wide = tall[:, : w - 4].copy()
    for d in range(1, 5):
        np.maximum(wide, tall[:, d : w - 4 + d], out=wide)
    inner = r[2:-2, 2:-2]
    ys, xs = np.nonzero((inner >= wide) & (inner > 1e6))
    image = np.searchsorted(tops, ys + 6, "right") - 1
    own = ys + 6 - tops[image]
    inside = (own >= 6) & (own < heights[image] - 6)
    image, own, xs, force = image[inside], own[inside] - 6, xs[inside], np.rint(inner[ys[inside], xs[inside]] / 1e5)
    # They come row by row, and the sort is stable, so equal ones stay by y and x.
    order = np.lexsort((-force, (image * (int(own.max(initial=0)) // TILE + 1) + own // TILE) * (w // TILE + 1) + xs // TILE))
    image, own, xs = image[order], own[order], xs[order]
    tile = np.stack([image, own // TILE, xs // TILE])
    first = np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(0)))  # where the corners of each tile begin
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    tall, wide = (np.minimum(size, TILE * (at + 1)) - TILE * at for size, at in ((heights[image] - 12, tile[1]), (w - 4, tile[2])))
    part = tall * wide / TILE**2
    kept = rank < np.ceil(most * part)
    return image[kept], own[kept] + 5, xs[kept] + 5, (rank < np.ceil(LISTED * most * part))[kept]


@cache
def _offsets(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances in memory, in an image of ``width``, from a corner to its disc and to its tests at each turn."""
    return _DISC @ [width, 1], _ROTATED.reshape(_TURNS, -1, 2) @ [1, width]


def _described_at(scale: int, images: list[np.ndarray], points: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, bits) of images of one width."""
    heights = np.array([len(a) for a in images])
    tops = np.cumsum(heights) - heights
    soft = _window(np.concatenate(images), 1)
    image, ys, xs, listed = _corners(soft, tops, heights, points)
    # Every image with ``PATCH`` more rows and columns on every side, which repeat its edges.
    rows = np.concatenate([np.clip(np.arange(-PATCH, h - 2 + PATCH), 0, h - 3) + t for h, t in zip(heights, tops)])
    far = np.empty((len(rows), soft.shape[1] + 2 * PATCH), soft.dtype)
    np.take(soft, rows, 0, out=far[:, PATCH:-PATCH])
    far[:, :PATCH], far[:, -PATCH:] = far[:, PATCH : PATCH + 1], far[:, -PATCH - 1 : -PATCH]
    starts = np.cumsum(heights - 2 + 2 * PATCH) - (heights - 2 + 2 * PATCH)
    flat, at = far.ravel(), (starts[image] + PATCH + ys) * far.shape[1] + PATCH + xs
    disc, tests = _offsets(far.shape[1])
    # Sums of whole numbers (at the second scale, quarters), so they do not depend on the order of adding.
    moment = flat.take(at[:, None] + disc) @ _DISC.astype(np.float32)
    turn = np.rint(np.arctan2(moment[:, 0], moment[:, 1]) / (2 * np.pi / _TURNS)).astype(int) % _TURNS
    values = flat.take(at[:, None] + tests[turn]).reshape(-1, BITS, 2)
    bits = np.packbits(values[:, :, 0] + MARGIN < values[:, :, 1], axis=1)
    places = np.column_stack([ys * scale, xs * scale, np.full(len(ys), scale), turn, listed])
    ends = np.searchsorted(image, np.arange(len(images) + 1))
    return [(places[i:j], bits[i:j]) for i, j in zip(ends, ends[1:])]


def describe_all(images: list[np.ndarray], points: int, rows_at_once: int = 2048) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each image (n, 5) places (y, x, scale, turn, whether it is listed) and (n, 16) bytes of descriptors.

    Images of one width are worked on together, about ``rows_at_once`` rows of pixels at a time, which changes no result.
    """
    out = [([np.empty((0, 5), int)], [np.empty((0, BITS // 8), np.uint8)]) for _ in images]
    now = {i: a.astype(np.float32) for i, a in enumerate(images)}
    for scale in (1, 2):
        if scale == 2:
            even = {i: a[: len(a) // 2 * 2, : a.shape[1] // 2 * 2] for i, a in now.items()}
            now = {i: (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) / 4 for i, a in even.items()}
        now = {i: a for i, a in now.items() if min(a.shape) >= 13}
        parts: list[list[int]] = []
        for i in sorted(now, key=lambda i: (now[i].shape[1], i)):
            a = now[i]
            if not parts or now[parts[-1][0]].shape[1] != a.shape[1] or sum(len(now[j]) for j in parts[-1]) + len(a) > rows_at_once:
                parts.append([])
            parts[-1].append(i)
        for part in parts:
            for i, (places, bits) in zip(part, _described_at(scale, [now[j] for j in part], points)):
                out[i][0].append(places)
                out[i][1].append(bits)
    return [(np.concatenate(p), np.concatenate(b)) for p, b in out]


def describe(pixels: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    return describe_all([pixels], points)[0]


def _pixels(image) -> np.ndarray | None:
    if image is None or not image["pixels"] or not image["width"] or not image["height"]:
        return None
    w, h = image["width"], image["height"]
    return np.frombuffer(image["pixels"], np.uint8).reshape(h, w) if w > 0 and len(image["pixels"]) == w * h else None


def pack_places(places: np.ndarray) -> bytes:
    """Eight bytes for a point: y; x, whether it is listed, turn and scale."""
    y, x, scale, turn, listed = places.T.astype(np.int64)
    return np.stack([y, x << 8 | listed << 7 | turn << 2 | scale], 1).astype("<u4").tobytes()


def unpack_places(raw: bytes) -> np.ndarray:
    y, rest = np.frombuffer(raw, "<u4").reshape(-1, 2).T.astype(np.int64)
    return np.stack([y, rest >> 8, rest & 3, rest >> 2 & 31, rest >> 7 & 1], 1)


def _described(points: int, reader):
    def make():
        def work(cols):
            pixels = [_pixels(reader(image) if reader else image) for image in cols["_image"]]
            keys = [None if a is None else xxhash.xxh3_128_digest(repr(a.shape).encode() + a.tobytes()) for a in pixels]
            # Identical images of a batch are described once.
            first = {key: a for key, a in zip(keys, pixels) if key is not None}
            made = dict(zip(first, describe_all(list(first.values()), points)))
            none = (np.empty((0, 5), int), np.empty((0, BITS // 8), np.uint8))
            found = [made.get(key, none) for key in keys]
            return {
                "_id": cols["_id"], "key": keys, "n": [len(p) for p, _ in found], "places": [pack_places(p) for p, _ in found],
                "bits": [b.tobytes() for _, b in found],
            }

        return work

    return make


TABLES = 2
_OWN = np.array([0, 0x5555555555555555], np.uint64)


def _words(bits: np.ndarray) -> np.ndarray:
    """The keys of descriptors: their two words, each in a table of its own."""
    return (bits.reshape(-1, TABLES) ^ _OWN).view(np.int64)


def _mixed(words: np.ndarray) -> np.ndarray:
    """Keys spread evenly over 64 bits, different ones apart."""
    x = words.astype(np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ x >> np.uint64(30)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte, the lowest of all first, so that high bytes which are alike compress to nothing."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


#: Keys are told apart by so many bits of their mixed words; those that fall together only make further candidates.
KEY_BITS = 48


def _dealt_keys(buckets: int):
    """The keys of images' listed points in the Hamming tables as (bucket, least, ids, ks): for each bucket the keys in
    their order, as differences, and their images' ids from ``least`` on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, places = (batch.column(c).to_pylist() for c in ("id", "bits", "places"))
            listed = np.frombuffer(b"".join(places), "<u4")[1::2] >> 7 & 1 == 1
            image = np.repeat(np.array(ids, np.int64), [len(x) // (BITS // 8) for x in raw])[listed].repeat(TABLES)
            k = _mixed(_words(np.frombuffer(b"".join(raw), np.uint64).reshape(-1, TABLES)[listed]).ravel()) >> np.uint64(64 - KEY_BITS)
            order = np.argsort(k, kind="stable")
            image, k = image[order], k[order]
            bucket = ((k >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with k
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = {"bucket": bucket[starts], "least": [], "ids": [], "ks": []}
            for at, to in zip(starts, [*starts[1:], len(k)]):
                least = image[at:to].min()
                rows["least"].append(least)
                rows["ids"].append(_pack(image[at:to] - least))
                rows["ks"].append(_pack(np.diff(k[at:to], prepend=np.uint64(0))))
            yield pa.record_batch({c: pa.array(x, pa.binary() if c in ("ids", "ks") else pa.int64()) for c, x in rows.items()})

    return run


def _shared_of(bucket: pa.Table) -> pa.Table:
    """(id, k, f, hub) of the keys of a bucket that several images have: a number of the key, how many have it, the least."""
    parts = [(_unpack(i).view(np.int64) + least, np.cumsum(_unpack(k))) for least, i, k in zip(*(bucket.column(c).to_pylist() for c in ("least", "ids", "ks")))]
    ids, keys = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, keys))
    ids, keys = ids[order], keys[order]
    # Points of an image, or rows that share an id, may bring a key twice.
    once = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
    ids, keys = ids[once], keys[once]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(first, len(keys)))
    several = size > 1
    kept, f = np.repeat(several, size), size[several]
    number = np.arange(len(f)) + (bucket.column("bucket")[0].as_py() << 32)
    return pa.table({"id": ids[kept], "k": np.repeat(number, f), "f": np.repeat(f, f), "hub": np.repeat(ids[first][several], f)})


def consensus(
    pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray, most_bits: int, near: float = 3.0, enough: float = np.inf
) -> int:
    """How many points of the first image one similarity transform brings onto matching points of the second.

    The search ends at a transform that explains ``enough``.
    """
    best, least = np.zeros(len(da), int), np.zeros(len(da), int)
    for at in range(0, len(da), 256):
        far = np.bitwise_count(da[at : at + 256, None] ^ db[None]).sum(2)
        best[at : at + 256], least[at : at + 256] = far.argmin(1), far.min(1)
    i = np.flatnonzero(least <= most_bits)
    j = best[i]
    if not len(i):
        return 0
    a, b = pa_[i].astype(float), pb[j].astype(float)
    scale = b[:, 2] / a[:, 2]
    turn = (b[:, 3] - a[:, 3]) * 2 * np.pi / _TURNS
    c, s = np.cos(turn) * scale, np.sin(turn) * scale
    most = 0
    # Each match proposes a transform; all matches are held against all proposals.
    for at in range(0, len(i), 64):
        t = slice(at, at + 64)
        dy, dx = a[None, :, 0] - a[t, None, 0], a[None, :, 1] - a[t, None, 1]
        x = b[t, None, 1] + c[t, None] * dx - s[t, None] * dy
        y = b[t, None, 0] + s[t, None] * dx + c[t, None] * dy
        fits = np.hypot(x - b[None, :, 1], y - b[None, :, 0]) <= near * np.maximum(scale[t], 1)[:, None]
        support = fits.sum(1)
        for best_first in np.argsort(-support, kind="stable"):
            if support[best_first] <= most:
                break
            most = max(most, len(np.unique(j[fits[best_first]])))
            if most >= enough:
                return most
    return most


MEET, MEET_SHARE = 3, 0.1


def _alike(a: tuple, b: tuple, most_bits: int, share: float) -> bool:
    """Whether consensus holds for two (places, bits): six points, and ``share`` of the smaller image's."""
    small, large = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    need = max(6, share * len(small[0]))
    return consensus(small[0], small[1], large[0], large[1], most_bits, enough=need) >= need


def _star(most_bits: int, share: float):
    """A group holds the image ``a`` and those that may be its copies; the links between it and them."""

    def run(group: pa.Table) -> pa.Table:
        ids, centre = group.column("id").to_pylist(), group.column("a")[0].as_py()
        raw = zip(group.column("places").to_pylist(), group.column("bits").to_pylist())
        images = {i: (unpack_places(p), np.frombuffer(b, np.uint64).reshape(-1, TABLES)) for i, (p, b) in zip(ids, raw)}
        own = images.pop(centre)
        found = [i for i in sorted(images) if _alike(own, images[i], most_bits, share)]
        return pa.table({"a": pa.array([centre] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return run


def shared_keys(image: np.ndarray, number: np.ndarray, probing: np.ndarray, n: int, at_once: int = 4096, dense: int = 200) -> np.ndarray:
    """(n, n): with how many of its keys the first image probes that the second has too.

    Entries are an image, the number of its key and whether it probes with it. Keys of few images are paired out; those
    whose pairs are more than one in ``dense`` of all are counted by products of matrices.
    """
    met, most = np.zeros((n, n), np.float32), int(number.max(initial=-1)) + 1
    order = np.argsort(number, kind="stable")
    image, number, probing = image[order], number[order], probing[order]
    size = np.bincount(number, minlength=most)
    often = size * np.bincount(number[probing], minlength=most) * dense > n * n
    start = np.cumsum(size) - size
    asks = np.flatnonzero(probing & ~often[number])
    pairs = np.cumsum(size[number[asks]])
    at = 0
    while at < len(asks):  # about four million pairs at a time
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + (4 << 20), "right")))
        part = asks[at:to]
        times = size[number[part]]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[number[part]], times)
        met += np.bincount(np.repeat(image[part], times) * n + image[place], minlength=n * n).reshape(n, n)
        at = to
    kept = often[number]
    image, number, probing = image[kept], (np.cumsum(often) - 1)[number[kept]], probing[kept]
    for at in range(0, int(often.sum()), at_once):
        part = (number >= at) & (number < at + at_once)
        has, ask = np.zeros((2, n, min(at_once, int(often.sum()) - at)), np.float32)
        has[image[part], number[part] - at] = 1
        ask[image[part & probing], number[part & probing] - at] = 1
        met += ask @ has.T
    return met


def _meeting():
    """A group holds the keys of the images of two blocks. The pairs between or within them, of different groups, of which
    the smaller image probes with enough keys that the other has."""

    def run(cell: pa.Table) -> pa.Table:
        order = np.argsort(cell.column("id").to_numpy(), kind="stable")
        cell = cell.take(order)
        ids, own, size, group, meet = (cell.column(c).to_numpy() for c in ("id", "own", "n", "group", "meet"))
        one, other = cell.column("x")[0].as_py(), cell.column("y")[0].as_py()
        lists = cell.column("ks").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten()
        image = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        number = np.unique(flat.field("k").to_numpy(), return_inverse=True)[1].ravel()
        met = shared_keys(image, number, flat.field("probing").to_numpy(zero_copy_only=False), len(ids))
        found = (met >= meet[:, None]) & (size[:, None] <= size) & (group[:, None] != group)
        found |= found.T
        found &= (own[:, None] == one) & (own == other) if one != other else np.triu(np.ones_like(found), 1)
        i, j = np.nonzero(found)
        return pa.table({"a": pa.array(np.minimum(ids[i], ids[j]), pa.int64()), "b": pa.array(np.maximum(ids[i], ids[j]), pa.int64())})

    return run


def _verified(pairs: DataFrame, strong: DataFrame, most_bits: int, share: float, block_rows: int, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) that consensus links. An image with many candidates is compared in parts of ``block_rows``.

    Up to ``broadcast_rows`` pairs are broadcast to the descriptors, of which only those of candidates then move.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    members = pairs.join(sizes, "a").select("a", part.alias("part"), F.col("b").alias("id"))
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    asked = cut(members.unionAll(centres))
    asked = F.broadcast(asked) if asked.count() <= broadcast_rows else asked
    rows = strong.select("id", "places", "bits").join(asked, "id")
    return cut(rows.groupBy("a", "part").applyInArrow(_star(most_bits, share), "a long, b long"))


def image_copies(
    df: DataFrame, id_col: str, image_col: str, points: int = 40, share: float = 0.3, most_bits: int = 12, block_rows: int = 500, few: int = 16, reader=None, broadcast_rows: int = 250_000, bucket_keys: int = 200_000
) -> DataFrame:
    """Return for each row its id (long), ``n_points``, ``component_id`` (the least id reachable) and ``kept``.

    ``reader`` turns a value of the column into an image, where the column holds something else. Up to
    ``broadcast_rows`` keys and ids of different images are broadcast; more are joined by a shuffle. Keys are counted in
    buckets of about ``bucket_keys``; a task holds one, with eight bytes of id and of key for each image that has one.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{image_col}`").alias("_image"))
    base = written(map_batches(rows, _described(points, reader), "_id long, key binary, n long, places binary, bits binary"), "points", compression="zstd")
    base = base.withColumnRenamed("_id", "id")
    # The descriptors stay where they are: only keys and ids are grouped, and their table is sent to them if it is small.
    light = base.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    classes = cut(light)
    first = classes.select("key", "id")
    strong = base.where("n >= 6").join(F.broadcast(first) if classes.count() <= broadcast_rows else first, ["key", "id"])

    def stage_over() -> None:
        release(df.sparkSession)

    # Inverted lists: the keys that several images have. Every image probes with its rarest ones.
    made = strong.agg(F.sum("n")).first()[0] or 0
    keys = strong.select("id", "bits", "places").mapInArrow(_dealt_keys(int(made * LISTED * TABLES) // bucket_keys + 1), "bucket long, least long, ids binary, ks binary")
    done: list[str] = []
    held = written(keys.groupBy("bucket").applyInArrow(_shared_of, "id long, k long, f long, hub long"), "keys", done, "zstd")
    stage_over()
    own = held.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "k", "hub"))).alias("ks"))
    own = own.join(base.select("id", F.ceil(F.col("n") * LISTED * TABLES).alias("n")).groupBy("id").agg(F.max("n").alias("n")), "id")
    own = own.withColumn("meet", F.greatest(F.lit(MEET), F.ceil(F.col("n") * MEET_SHARE)).cast("int"))
    need = F.greatest(F.lit(6), F.ceil(F.col("n") * share))
    own = own.withColumn("rarest", F.greatest(F.col("meet"), F.size("ks") - need + F.col("meet")))
    listed = own.select("id", "n", "meet", "rarest", F.posexplode("ks").alias("place", "of"))
    listed = written(listed.select("id", "n", "meet", (F.col("place") < F.col("rarest")).alias("probing"), "of.*"), "listed", done, "zstd")
    remove_path(df.sparkSession, done.pop(0))
    stage_over()
    probes = listed.where("probing")

    # First every image is held against the least image of its keys, which joins most groups of copies.
    stars = probes.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b"), "meet").agg(F.count("*").alias("n")).where("n >= meet")
    links = _verified(cut(stars.select("a", "b")), strong, most_bits, share, block_rows, broadcast_rows)
    stage_over()
    joined = cut(connected_components(links, stage_over)).select(F.col("node").alias("id"), "component")
    joined = F.broadcast(joined) if joined.count() <= broadcast_rows else joined
    stage_over()

    # Then images of different groups that share keys of few images, pair by pair.
    members = listed.join(joined, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    spread = members.groupBy("k").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("k")
    open_ = written(members.join(spread, "k"), "open", done, "zstd")
    remove_path(df.sparkSession, done.pop(0))
    stage_over()
    rare = open_.where(F.col("f") <= few)
    other = rare.select("k", F.col("id").alias("other"), F.col("group").alias("of_other"))
    met = rare.where("probing").select("id", "meet", "k", "group").join(other, "k").where("group <> of_other")
    pairs = met.groupBy("id", "other", "meet").agg(F.count("*").alias("n")).where("n >= meet")
    pairs = cut(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    stage_over()
    links = links.unionAll(_verified(pairs, strong, most_bits, share, block_rows, broadcast_rows))
    stage_over()

    # What keys of more images leave open is looked for in groups, all with all, in cells of two blocks each, which hold
    # the open keys alone.
    hot = open_.where(F.col("probing") & (F.col("f") > few)).select("k").distinct()
    ways = cut(open_.where(F.col("f") > few).join(hot, "k").where("hub <> id").select("hub", "id").distinct())
    if not ways.isEmpty():
        around = connected_components(ways, stage_over)
        stage_over()
        sizes = around.groupBy("component").agg(F.ceil(F.count("*") / (2 * block_rows)).cast("int").alias("blocks"))
        dealt = around.join(sizes, "component").withColumnRenamed("node", "id")
        lists = open_.groupBy("id", "group").agg(F.max("n").alias("n"), F.max("meet").alias("meet"), F.collect_list(F.struct("k", "probing")).alias("ks"))
        place = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        cells = (
            lists.join(dealt, "id")
            .select("id", "component", "group", "n", "meet", "ks", place.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("z"))
            .select("id", "component", "group", "n", "meet", "ks", "own", F.least("own", "z").alias("x"), F.greatest("own", "z").alias("y"))
        )
        pairs = cut(cells.groupBy("component", "x", "y").applyInArrow(_meeting(), "a long, b long"))
        stage_over()
        links = links.unionAll(_verified(pairs, strong, most_bits, share, block_rows, broadcast_rows))
        stage_over()
    shared = shared_id_edges(base.where("key is not null and id is not null").select("id", "key"), first)
    labels = connected_components(links.unionAll(shared), stage_over)
    for path in done:
        remove_path(df.sparkSession, path)
    named = classes.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "rows", F.coalesce("component", "id").alias("component"))
    special = named.where("rows > 1 or component <> id").select("key", "component")
    return left_join(base.select("id", "n", "key"), special, "key", broadcast_rows).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_points"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


_HIDDEN = re.compile(r"<(script|style)\b[\s\S]*?</\1\s*>|<!--[\s\S]*?-->", re.I)
_BLOCK = re.compile(r"</?(?:p|h[1-6]|li|ul|ol|div|article|nav|section|footer|header|br|tr|table|title|body)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CELL, WORDS_A_ROW = 4, 16


def draw_page(page: str | None) -> dict | None:
    """The visible text of a page as an image: a block pattern for each word, a new row for each block element."""
    if page is None:
        return None
    text = html.unescape(_TAG.sub(" ", _BLOCK.sub("\n", _HIDDEN.sub("\n", page))))
    # Blanks that only Unicode knows become plain ones, so that the bytes are cut as the text would be.
    lines = [words[i : i + WORDS_A_ROW] for words in map(bytes.split, _BLANK.sub(" ", text).encode().split(b"\n")) for i in range(0, len(words), WORDS_A_ROW)]
    if not lines:
        return None
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    sums = np.zeros((len(lines), WORDS_A_ROW), np.uint32)
    sums[np.arange(WORDS_A_ROW) < counts[:, None]] = np.fromiter(map(zlib.crc32, chain.from_iterable(lines)), np.uint32, counts.sum())
    canvas = np.zeros((len(lines), CELL, WORDS_A_ROW, CELL), np.uint8)
    bits = (sums[:, :, None] >> np.arange(9, dtype=np.uint32)) & 1
    canvas[:, :3, :, :3] = bits.reshape(len(lines), WORDS_A_ROW, 3, 3).transpose(0, 2, 1, 3) * 255
    h, w = len(lines) * CELL, WORDS_A_ROW * CELL
    return {"width": w, "height": h, "pixels": canvas.reshape(h, w).tobytes()}


IMAGE = "struct<width:int,height:int,pixels:binary>"


def draw_pages(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The id and ``image`` of every page; a page without words has none."""
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{html_col}`").alias("_html"))
    kind = rows.schema["_id"].dataType.simpleString()

    def make():
        return lambda cols: {"_id": cols["_id"], "image": list(map(draw_page, cols["_html"]))}

    return map_batches(rows, make, f"_id {kind}, image {IMAGE}").withColumnRenamed("_id", id_col)


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Copies among the drawn images of all pages."""
    return image_copies(table(spark, sf_dir, "pages"), "page_id", "html", reader=draw_page)
