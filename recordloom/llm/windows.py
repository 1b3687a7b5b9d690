"""Concatenate and cut: all documents as one stream of tokens, cut into windows of a fixed length.

The first pass tokenises every partition once and writes, with each document's ids, the number of tokens before it in
its partition. Sums of partition totals, by blocks of partitions and then over the blocks, give every partition its
place in the stream. The second pass adds that place and cuts at the multiples of ``window``: a document that crosses
such a boundary leaves one boundary record (a piece) on each side. No row is shuffled; only a row for each partition is.

The rest of the stream that fills no window is cut at falling powers of two, one for each set bit of its length, so no
sequence has any padding where lengths that are a power of two need none.

Defined results. A null text is an empty one, which is the end token alone; a null id is kept as it is; equal rows are
packed one by one; an empty table gives an empty result; further columns are not looked at. A text of any length is
tokenised whole. The order is that of the table's partitions as the first pass wrote them, so a repeated task of the
second pass cuts alike. Numbers of sequences are gapless from 0, and full ones come first.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROWS, left_join, table, written
from .packing import byte_bpe

#: Partitions of a block, whose totals one task sums.
BLOCK = 1024


def _tokenised(tokenizer_path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = byte_bpe(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                raw = [encode(t.as_py() or "").astype("<u4", copy=False).tobytes() + end for t in batch.column(1)]
                n = np.array([len(x) // 4 for x in raw], dtype=np.int64)
                first = before + np.cumsum(n) - n
                before += int(n.sum())
                cols = [pa.array([part] * len(raw), pa.int32()), batch.column(0), pa.array(first), pa.array(n), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "id", "before", "n", "ids"])

    return run


def partition_starts(totals: DataFrame) -> DataFrame:
    """(part, base) from (part, total): what all earlier partitions hold, by blocks, so no task sees all partitions."""
    blocked = totals.select("part", "total", F.floor(F.col("part") / BLOCK).alias("block"))
    blocks = blocked.groupBy("block").agg(F.sum("total").alias("t"))
    earlier = blocks.select("block", (F.sum("t").over(W.orderBy("block")) - F.col("t")).alias("ahead"))
    within = blocked.select("block", "part", (F.sum("total").over(W.partitionBy("block").orderBy("part")) - F.col("total")).alias("inside"))
    return within.join(earlier, "block").select("part", (F.col("ahead") + F.col("inside")).alias("base"))


def tail_starts(total: int, window: int) -> list[int]:
    """Where the sequences after the last full window start: the rest of the stream in falling powers of two."""
    at, rest, out = total - total % window, total % window, []
    while rest:
        out.append(at)
        size = 1 << (rest.bit_length() - 1)
        at, rest = at + size, rest - size
    return out


def _cut(total: int, window: int, with_ids: bool, arrow: pa.Schema):
    full, tail = total // window, tail_starts(total, window)

    def sequence(g: int) -> tuple[int, int, int]:
        """The sequence that holds place ``g`` of the stream, where it starts, and where it ends."""
        if g < full * window:
            s = g // window
            return s, s * window, (s + 1) * window
        i = bisect.bisect_right(tail, g) - 1
        return full + i, tail[i], tail[i + 1] if i + 1 < len(tail) else total

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, out = whole.slice(at, ROWS), []
                ids, places, raws = (batch.column(c) for c in ("id", "place", "ids"))
                for doc, place, raw in zip(ids.to_pylist(), places.to_pylist(), raws):
                    view = memoryview(raw.as_buffer())
                    n, start = len(view) // 4, 0
                    while start < n:
                        s, begins, ends = sequence(place + start)
                        length = min(n - start, ends - place - start)
                        piece = view[4 * start : 4 * (start + length)]
                        out.append((doc, start, length, zlib.crc32(piece), n, s, place + start - begins, bytes(piece) if with_ids else None))
                        start += length
                cols = zip(*out) if out else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return run


def concatenate_and_cut(
    df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int = 1, window: int = 2048, with_ids: bool = False
) -> DataFrame:
    """Cut the stream of all documents, each followed by ``end_id``, into sequences of ``window`` tokens.

    Returns one row for each piece: the id, ``start`` (ids of its document before it), ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` in that sequence, and with ``with_ids`` also ``ids``, the token ids as
    little-endian unsigned 32-bit numbers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    tokens = written(picked.mapInArrow(_tokenised(tokenizer_path, end_id), f"part int, id {kind}, before bigint, n bigint, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    placed = left_join(tokens, partition_starts(totals), "part").select("id", (F.col("base") + F.col("before")).alias("place"), "ids")
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    pieces = placed.mapInArrow(_cut(total, window, with_ids, to_arrow_schema(_parse_datatype_string(schema))), schema)
    return (pieces if with_ids else pieces.drop("ids")).withColumnRenamed("id", id_col)


def training_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, from pieces with ``ids``. A group is one window."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("held")
    ids = F.aggregate("held", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    n = F.aggregate("held", F.lit(0).cast("bigint"), lambda a, p: a + p["length"])
    return pieces.groupBy("sequence_id").agg(held).select("sequence_id", n.alias("n_tokens"), ids.alias("ids"))


def op12_concat_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents as one stream, cut into sequences of 2048 tokens."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return concatenate_and_cut(table(spark, sf_dir, "documents"), "doc_id", "text", path)
