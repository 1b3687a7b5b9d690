"""SQLite snapshots as a Spark data source: ``spark.read.format("snapshot")`` and ``df.write.format("snapshot")``.

Reading. The whole key of a table (kind, owner and id; digest) is ordered in the database by its primary key. Conditions
on key columns are options of the reader (``lookup``), what fits them is dealt to partitions by ranges of the whole key, and
every partition reads its range alone, through the key's index. A lookup of one key reads one row. The file is opened
read-only and its header and versions are checked first. Spark's own handing down of filters to Python sources is not
used: in Spark 4.1 what one query has handed down stays with the table for the next query that hands down nothing.

Writing. Each task writes its rows into a file of its own beside the target. The commit puts them together, checks the
keys, and then gives the whole its name in one step; no task's rows, and nothing of a job that fails, are ever seen under
it. An existing snapshot is only replaced if ``overwrite`` is ``true``.

SQLite needs a file system: the folder must lie at the same path on the driver and all executors.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)

SCHEMAS = {
    "manifest": "id int, storage_version int, ir_version int, encoding_version int, producer string, content_fingerprint string",
    "records": "kind string, owner string, id string, content string, fingerprint string",
    "assets": "digest string, media_type string, bytes binary",
}
KEYS = {"manifest": ("id",), "records": ("kind", "owner", "id"), "assets": ("digest",)}
#: Rows of all tables in one, for writing.
ROWS = "section string, kind string, owner string, id string, content string, fingerprint string, digest string, media_type string, bytes binary"
#: The versions that a reader accepts; others are refused, there is no migration.
STORAGE_VERSION, IR_VERSION, ENCODING_VERSION = 2, 16, 1
#: The application ids of a workspace's snapshot and of a bundle of one package, and a bundle's version.
SNAPSHOT_ID, BUNDLE_ID, BUNDLE_VERSION = 0x4449504C, 0x44495042, 1


def open_snapshot(path: str, bundle: bool = False) -> sqlite3.Connection:
    """A database that stands alone (no write-ahead log, no recovery files beside it), read-only. The caller closes it."""
    with open(path, "rb") as f:
        head = f.read(20)
    if head[:16] != b"SQLite format 3\0" or head[18:] != b"\1\1":
        raise ValueError(f"{path} is not a snapshot database with a rollback journal")
    left = [s for s in ("-journal", "-wal", "-shm") if os.path.exists(path + s)]
    if bundle and left:
        raise ValueError(f"{path} has recovery files: {left}")
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        if bundle != (db.execute("pragma application_id").fetchone()[0] == BUNDLE_ID):
            raise ValueError(f"{path} is {'not ' if bundle else ''}a bundle of one package")
        if bundle and db.execute("pragma user_version").fetchone()[0] != BUNDLE_VERSION:
            raise ValueError(f"{path} is a bundle of another version")
    except BaseException:
        db.close()
        raise
    return db


class _Slice(InputPartition):
    """Keys from ``low`` on and below ``high``."""

    def __init__(self, low: tuple | None, high: tuple | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"].removeprefix("file:"), options.get("table", "records")
        self.slices = int(options.get("slices", "4"))
        self.bundle = options.get("bundle", "false") == "true"
        #: Conditions on key columns, from the options of their names: a value, or with ``_from`` and ``_to`` a range.
        self.tests: list[tuple[str, list]] = []
        for column in KEYS[self.table] if self.table != "manifest" else ():
            for suffix, sign in (("", "="), ("_from", ">="), ("_to", "<")):
                value = options.get(f"{column}{suffix}")
                if value is not None:
                    self.tests.append((f"{column} {sign} ?", [value]))

    def _where(self, low: tuple | None, high: tuple | None, after: bool = False) -> tuple[str, list]:
        key = f"({', '.join(KEYS[self.table])})"
        tests = list(self.tests)
        tests += [(f"{key} {'>' if after else '>='} ({', '.join('?' * len(low))})", list(low))] if low else []
        tests += [(f"{key} < ({', '.join('?' * len(high))})", list(high))] if high else []
        return (" where " + " and ".join(t for t, _ in tests) if tests else ""), [v for _, vs in tests for v in vs]

    def partitions(self):
        keys = ", ".join(KEYS[self.table])
        with contextlib.closing(open_snapshot(self.path, self.bundle)) as db:
            manifest = db.execute("select storage_version, ir_version, encoding_version from manifest").fetchall()
            if manifest != [(STORAGE_VERSION, IR_VERSION, ENCODING_VERSION)]:
                raise ValueError(f"unknown snapshot versions: {manifest}")
            where, values = self._where(None, None)
            step = max(1, -(-db.execute(f"select count(*) from {self.table}{where}", values).fetchone()[0] // self.slices))
            cuts, low = [], None
            while len(cuts) < self.slices - 1:  # steps along the key's index; no keys are gathered
                where, values = self._where(low, None, after=True)
                found = db.execute(f"select {keys} from {self.table}{where} order by {keys} limit 1 offset ?", [*values, step if low is None else step - 1]).fetchone()
                if found is None:
                    break
                low = tuple(found)
                cuts.append(low)
        edges = [None, *cuts, None]
        return [_Slice(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, part: _Slice) -> Iterator[tuple]:
        names = [c.split()[0] for c in SCHEMAS[self.table].split(", ")]
        where, values = self._where(part.low, part.high)
        with contextlib.closing(open_snapshot(self.path, self.bundle)) as db:
            yield from db.execute(f"select {', '.join(names)} from {self.table}{where}", values)


@dataclass
class _Shard(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file:")
        self.producer, self.fingerprint = options.get("producer", ""), options.get("fingerprint", "")
        self.overwrite, self.bundle = options.get("overwrite", "false") == "true", options.get("bundle", "false") == "true"
        self.staging = f"{self.path}.writing-{uuid.uuid4().hex}"
        if not self.overwrite and os.path.exists(self.path):
            raise ValueError(f"{self.path} is there already")
        os.makedirs(self.staging)

    def _tables(self, path: str) -> sqlite3.Connection:
        db = sqlite3.connect(path)
        for table, schema in SCHEMAS.items():
            columns = schema.replace("string", "text not null").replace("binary", "blob not null")
            db.execute(f"create table {table}({columns}, primary key ({', '.join(KEYS[table])}))")
        return db

    def write(self, iterator) -> _Shard:
        task = TaskContext.get()
        path = f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}.db"
        with contextlib.closing(self._tables(path)) as db:
            for row in iterator:
                table = row["section"]
                if table not in ("records", "assets"):
                    raise ValueError(f"there is no section {table!r}")
                values = [row[c.split()[0]] for c in SCHEMAS[table].split(", ")]
                db.execute(f"insert into {table} values ({', '.join('?' * len(values))})", values)
            db.commit()
        return _Shard(path)

    def commit(self, messages) -> None:
        whole = f"{self.staging}/whole.db"
        with contextlib.closing(self._tables(whole)) as db:
            for shard in sorted(m.path for m in messages if m is not None):
                db.execute("attach ? as shard", (shard,))
                for table in ("records", "assets"):
                    db.execute(f"insert into {table} select * from shard.{table} order by {', '.join(KEYS[table])}")
                db.commit()
                db.execute("detach shard")
                os.remove(shard)
            db.execute("insert into manifest values (1, ?, ?, ?, ?, ?)", (STORAGE_VERSION, IR_VERSION, ENCODING_VERSION, self.producer, self.fingerprint))
            db.execute(f"pragma application_id = {BUNDLE_ID if self.bundle else SNAPSHOT_ID}")
            db.execute(f"pragma user_version = {BUNDLE_VERSION if self.bundle else 0}")
            db.commit()
        with open(whole, "rb") as f:
            os.fsync(f.fileno())
        if self.overwrite:
            os.replace(whole, self.path)
        else:
            os.link(whole, self.path)  # fails if another writer was first
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class SnapshotSource(DataSource):
    """``spark.read.format("snapshot").option("table", "records").load(path)``"""

    @classmethod
    def name(cls):
        return "snapshot"

    def schema(self):
        return SCHEMAS[self.options.get("table", "records")]

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SnapshotSource)
    return spark


def lookup(spark: SparkSession, path: str, table: str = "records", slices: int = 4, **conditions: str) -> DataFrame:
    """The rows of a table that meet conditions on its key, and no others are read: ``kind="item"`` and the like for a
    value, ``owner_from`` (included) and ``owner_to`` (excluded) for a range."""
    known = {f"{c}{s}" for c in KEYS[table] for s in ("", "_from", "_to")}
    if table == "manifest" or not conditions.keys() <= known:
        raise ValueError(f"no conditions on {sorted(conditions.keys() - known) or table}")
    return registered(spark).read.format("snapshot").options(path=path, table=table, slices=slices, **conditions).load()


def read_snapshot(spark: SparkSession, path: str, bundle: bool = False, slices: int = 4) -> dict[str, DataFrame]:
    """The three tables of a snapshot, or of a bundle; digests are verified by ``verify``."""
    reader = registered(spark).read.format("snapshot").option("path", path).option("bundle", str(bundle).lower()).option("slices", slices)
    return {t: reader.option("table", t).load() for t in SCHEMAS}


def write_snapshot(tables: dict[str, DataFrame], path: str, producer: str = "", fingerprint: str = "", overwrite: bool = False, bundle: bool = False) -> None:
    """Write ``records`` and ``assets`` as one SQLite snapshot; a repeated key or a null is refused and leaves nothing."""
    names = [c.split() for c in ROWS.split(", ")]

    def section(table: str) -> DataFrame:
        df = tables[table]
        return df.select(*[F.lit(table).alias(n) if n == "section" else (F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names])

    rows = section("records").unionAll(section("assets")) if "assets" in tables else section("records")
    registered(rows.sparkSession)
    options = {"producer": producer, "fingerprint": fingerprint, "overwrite": str(overwrite).lower(), "bundle": str(bundle).lower()}
    rows.write.format("snapshot").options(path=path, **options).mode("append").save()
