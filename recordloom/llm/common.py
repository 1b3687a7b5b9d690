"""Helpers shared by the corpus operators.

All intermediate tables are cut with a reliable ``checkpoint()`` in the folder named by
``spark.checkpoint.dir``, so a lost executor never loses data that only it held.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch that are Python objects at one time.
ROWS = 512


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints. Only a local session may go without: it gets a temporary one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="recordloom-ckpt-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, reliably, and return it without lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, for a table written by an operator."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, paths: list[str] | None = None, compression: str = "snappy") -> DataFrame:
    """Like ``cut``, by a Parquet table in the shared folder: compressed, and read column by column.

    Its path is added to ``paths``, for ``remove_path`` once nobody reads the table any more.
    """
    path = scratch_path(df.sparkSession, what)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table that an operator wrote to ``scratch_path`` and nobody reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of tables that nobody refers to any more.

    Its cleaner learns of them when the driver collects its garbage, which an idle driver hardly ever does by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def left_join(rows: DataFrame, found: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``rows`` with what ``found`` has for their key. Up to ``broadcast_rows`` rows of ``found`` are broadcast, so that a
    key of very many rows stays where its rows are; more are joined by a shuffle, whose hot partitions Spark splits."""
    found = cut(found)
    return rows.join(F.broadcast(found) if found.count() <= broadcast_rows else found, key, "left")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_long(col: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))


def id_fold(col: Column, folds: int) -> Column:
    """crc32 of the id written in decimal, modulo ``folds``; a null id falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds)), F.lit(0).cast("bigint"))


def crc_bytes(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str
) -> DataFrame:
    """Run a column-wise Python function over Arrow batches.

    ``make`` is called once in each task and returns a function from a dictionary of column lists to a
    dictionary of column lists in the order of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                out = work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dictionary that fills itself and holds at most ``2 * limit`` keys.

    Once it has ``limit`` keys they become the older generation, from which a key that is asked for again comes back;
    what nobody asked for since is forgotten.
    """

    def __init__(self, compute: Callable, limit: int = 200_000):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
