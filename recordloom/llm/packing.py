"""Best-fit packing of tokenised documents into sequences of a fixed capacity, whatever their layout.

Every input partition tokenises its documents and cuts those longer than a sequence. The pieces that are shorter than a
sequence are dealt by a hash of their place over tasks of about ``deal`` pieces, so that each task sees the lengths of
the whole table, and packed there best-fit in decreasing order. Of the bins of a task at most one is at most half full,
and only such a bin can still join another: the ``fan * max_open`` emptiest bins of all tasks hold these and the bins
they fit best, and meet in one last task. If more bins are half empty, all that are not nearly full (``slack``, doubled
from round to round) are dealt again first. Every piece is in exactly one sequence.

Defined results. A null text is an empty one, which is the end token alone; a null id is kept as it is; equal rows are
packed one by one; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

_tokenizers: dict = {}


def byte_bpe(path: str):
    """Byte-level BPE of a public ``tokenizers`` file, run by ``tiktoken``: text -> uint32 ids.

    A byte-level file whose ids of merged tokens follow the order of its merges is the same tokenizer as its
    vocabulary taken as ranks; any other file is run by ``tokenizers`` itself.
    """
    if path in _tokenizers:
        return _tokenizers[path]
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # The byte-level alphabet, in which printable bytes stand for themselves and the others follow at 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    plain_pre = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain_pre and spec["normalizer"] is None and merged == sorted(merged) and len(merged) + 256 == len(vocab):
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        # Fixed value: the pattern of byte-level pre-tokenisation.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            return fast.encode_to_numpy(text, allowed_special="all")
    else:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)

        def encode(text: str) -> np.ndarray:
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    _tokenizers[path] = encode
    return encode


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes``: each item, the largest first, goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    held = 0  # bit f is set while a bin with f free places exists
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        above = held >> s
        if above:
            f = s + ((above & -above).bit_length() - 1)
            b = free_bins[f].pop()
            if not free_bins[f]:
                held &= ~(1 << f)
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
        free_bins[f - s].append(b)
        held |= 1 << (f - s)
    return bins


_MEMBER = "array<struct<doc_id:{id},piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint,ids:binary>>"


def _round(items: list[tuple[int, list]], capacity: int, slack: int) -> tuple[list, list]:
    """Pack (size, members) items; returns the members of nearly full bins and the (size, members) of all others."""
    final, open_ = [], []
    for b in best_fit([n for n, _ in items], capacity):
        n = sum(items[i][0] for i in b)
        members = [m for i in b for m in items[i][1]]
        if capacity - n <= slack:
            final.append(members)
        else:
            open_.append((n, members))
    return final, open_


def pack_documents(
    df: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 1024,
    fan: int = 8,
    slack: int = 4,
    max_open: int = 4096,
    deal: int = 32_768,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every document of ``df``.

    A document is its token ids and then ``end_id``. One that is longer than ``capacity`` is cut into pieces of
    ``capacity``, of which the first may be shorter. Returns one row for each piece: the id, ``piece``, ``start``,
    ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``, and with ``with_ids`` also ``ids``, the token ids as
    little-endian unsigned 32-bit numbers.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"level int, node int, size int, sequence_id bigint, members {_MEMBER.format(id=kind)}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def rows(level: int, node: int, final: list, open_: list, first: int) -> pa.RecordBatch:
        """Bins that are still open have the complements of their ids, which are negative."""
        bins = final + [m for _, m in open_]
        for members in bins:
            at = 0
            for m in members:
                m["offset"] = at
                at += m["length"]
        keys = [(level << 55) + (node << 24) + first + i for i in range(len(bins))]
        cols = [
            [level] * len(bins),
            [node] * len(bins),
            [sum(m["length"] for m in b) for b in bins],
            [k if i < len(final) else ~k for i, k in enumerate(keys)],
            bins,
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, node = byte_bpe(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=np.uint32)
        done = 0
        for batch in batches:
            full, part = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4", copy=False)
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    raw = ids[a:b].tobytes()
                    m = {"doc_id": doc, "piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(raw), "offset": None, "ids": raw if with_ids else None}
                    if b - a == capacity:
                        full.append([m])
                    else:
                        part.append((b - a, [m]))
            yield rows(0, node, full, part, done)
            done += len(full) + len(part)

    def merger(level: int, slack: int, last: bool):
        def merge(group: pa.Table) -> pa.Table:
            node = group.column("node")[0].as_py()
            # In one order whatever the shuffle delivered, so that a repeated task packs alike.
            got = zip(group.column("size").to_pylist(), group.column("sequence_id").to_pylist(), group.column("members").to_pylist())
            items = [(n, members) for n, _, members in sorted(got, key=lambda x: (-x[0], -x[1]))]
            final, open_ = _round(items, capacity, capacity if last else slack)
            return pa.Table.from_batches([rows(level, node, final, open_, 0)])

        return merge

    def meet(up: DataFrame, level: int, tasks: int, last: bool) -> DataFrame:
        dealt = up.withColumn("node", F.pmod(F.xxhash64(F.lit(level), "sequence_id"), F.lit(tasks)).cast("int"))
        return cut(dealt.groupBy("node").applyInArrow(merger(level, slack * 2 ** (level - 1), last), schema))

    packed = cut(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(local, schema))
    parts, level, before = [packed.where("sequence_id >= 0")], 0, None
    while True:
        level, up = level + 1, packed.where("sequence_id < 0")
        count, half = up.agg(F.count("*"), F.coalesce(F.sum((F.col("size") * 2 <= capacity).cast("int")), F.lit(0))).first()
        if count <= deal:
            parts.append(meet(up, level, 1, True))
            break
        if level > 1 and (2 * half <= fan * max_open or count == before):
            emptiest = cut(up.orderBy("size", "sequence_id").limit(fan * max_open))
            parts.append(meet(emptiest, level, 1, True))
            # No bin that is half empty is among these, so none can join another.
            others = up.join(emptiest.select("sequence_id"), "sequence_id", "left_anti").select(up.columns)
            parts.append(others.withColumn("sequence_id", F.bitwise_not("sequence_id")))
            break
        packed, before = meet(up, level, -(-count // deal), False), count
        parts.append(packed.where("sequence_id >= 0"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    flat = every.select("sequence_id", F.explode("members").alias("m"))
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return flat.select(
        F.col("m.doc_id").alias(id_col), *[F.col(c if c == "sequence_id" else f"m.{c}").alias(c) for c in names]
    )


def op4_best_fit_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", path)
