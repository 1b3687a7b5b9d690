"""Two-pass external shuffle into shards, with built-in DataFrame functions only.

Pass one scatters whole records into memory-sized buckets by seeded hashes; pass two orders every bucket by a
Fisher-Yates shuffle and numbers its records. A record's shard is decided by its key and the number of shards alone
(the highest of one seeded hash per shard wins), so with one more shard records only ever move into the new one.
Inside its shard a record falls into one of ``sub`` buckets, where ``sub`` follows from the measured size of the whole
input; the position of the row in the input takes part in that choice, so a key that holds a third of all rows is
spread over the buckets of its shard.

Defined results. A null key hashes as a key of its own; a null text has size 0 + 1 and the CRC of no bytes; equal rows
get slots of their own; an empty table gives an empty result; every further column travels inside ``record`` and
cannot clash with the columns made here. Columns of map type are refused, as rows with maps cannot be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_long, table


def _shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose seeded hash of the key is the largest. MD5, so that any engine can tell it."""
    name = F.coalesce(key.cast("string"), F.lit("\0"))
    scores = [F.struct(F.md5(F.concat(name, F.lit(f":{seed}:{i}")).cast("binary")).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0]).getField("i").cast("int")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def bucket_size(spark, least: int = 16 << 20) -> int:
    """Bytes of a bucket that a task can hold several times: a sixteenth of the heap that one core has."""
    conf = spark.sparkContext.getConf()
    local = conf.get("spark.master", "").startswith("local[") or conf.get("spark.master", "") == "local"
    memory = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    heap = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(memory)
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "2"))
    return max(least, heap // cores // 16)


def shuffle_into_shards(
    df: DataFrame, key: str, size: Column, shards: int, seed: int = 20240607, bucket_bytes: int | None = None, broadcast_buckets: int = 1_000_000
) -> DataFrame:
    """Shuffle all records of ``df`` into ``shards`` shards.

    ``size`` is the size of a record in bytes and ``bucket_bytes`` the aim for one bucket, which is what a task of the
    second pass holds; without it, it follows from the memory of an executor's core. The first places of up to
    ``broadcast_buckets`` buckets are broadcast, those of more are joined by a shuffle. Returns ``record`` (all columns of
    ``df`` as a struct), ``shard``, ``grown_shard`` (the shard with one more shard) and ``slot`` (gapless from 0 in each
    shard, a uniform random order).
    """
    if _has_map(df.schema):
        raise ValueError("columns of map type cannot be sharded: rows that hold maps have no order")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    bucket_bytes = bucket_bytes or bucket_size(df.sparkSession)
    sub = max(1, -(-int(total) // (shards * bucket_bytes)))
    k = F.col(f"`{key}`")
    shard = _shard_of(k, shards, seed).alias("shard")
    at = F.monotonically_increasing_id().alias("_at")
    spread = F.pmod(F.xxhash64("_key", "_at", F.lit(seed)), F.lit(sub))
    bucket = (F.col("shard") * sub + spread).cast("int").alias("_bucket")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"),
        k.alias("_key"),
        shard,
        _shard_of(k, shards + 1, seed).alias("grown_shard"),
        at,
    )
    # One bucket is one partition, so that the seed of its shuffle is fixed by the bucket's number.
    scattered = rows.select("*", bucket).drop("_key").repartitionById(shards * sub, F.col("_bucket"))
    held = F.collect_list(F.struct("_at", "record", "grown_shard"))
    shuffled = scattered.groupBy("_bucket", "shard").agg(F.shuffle(F.array_sort(held), F.lit(seed)).alias("_rows"))
    placed = shuffled.select("_bucket", "shard", F.posexplode("_rows").alias("_pos", "_row"))
    # The buckets of a shard stand one after the other. They are counted in the very shuffle that holds the records, so
    # counts and records agree however the input is split when it is read. That the count asks for whole rows (by a
    # remainder that is always 0) makes its exchange the same one.
    one = F.pmod(F.xxhash64("_at", "record", "grown_shard"), F.lit(1)) + 1
    first = scattered.groupBy("_bucket", "shard").agg(F.sum(one).alias("_n")).select(
        "_bucket",
        F.expr("sum(_n) over (partition by shard order by _bucket) - _n").alias("_first"),
    )
    # A number for each bucket, of which there are ``shards * sub``.
    return placed.join(F.broadcast(first) if shards * sub <= broadcast_buckets else first, "_bucket").select(
        F.col("_row.record").alias("record"),
        "shard",
        F.col("_row.grown_shard").alias("grown_shard"),
        (F.col("_first") + F.col("_pos")).cast("bigint").alias("slot"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the records as Parquet, one folder for each shard, the rows of a file in the order of their slots."""
    shards = shuffled.select("shard", "slot", "record.*")
    shards.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in ``shards`` shards under the law ``key``."""
    docs = table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    r = shuffle_into_shards(docs, "doc_id", size, shards)
    return r.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length("record.text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        crc32_long(F.col("record.text")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
