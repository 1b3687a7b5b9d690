"""The SQLite data source and the log of commits: point lookups, failed tasks, and writers at the same time."""

import concurrent.futures
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from recordloom.operators import site
from recordloom.sources import commits, database, snapshot


def tables_of(spark, n=300):
    ids = spark.range(n).select(F.lit("item").alias("kind"), F.concat(F.lit("p"), F.col("id") % 3).alias("owner"), F.concat(F.lit("i"), "id").alias("id"), F.lit("{}").alias("content"), F.lit("").alias("fingerprint"))
    packages = spark.range(3).select(F.lit("package").alias("kind"), F.lit("").alias("owner"), F.concat(F.lit("p"), "id").alias("id"), F.lit("{}").alias("content"), F.lit("").alias("fingerprint"))
    assets = spark.range(5).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit("text/plain").alias("media_type"), F.col("id").cast("string").cast("binary").alias("bytes"))
    return {"records": ids.unionAll(packages), "assets": assets}


def test_written_snapshots_come_back(spark, tmp_path):
    path = str(tmp_path / "s.db")
    tables = tables_of(spark)
    database.write_snapshot(tables, path, "me", "f")
    back = database.read_snapshot(spark, path, slices=7)
    for name, df in tables.items():
        assert back[name].exceptAll(df).count() == 0 and df.exceptAll(back[name]).count() == 0
    assert tuple(back["manifest"].first()) == (1, 2, 16, 1, "me", "f")
    assert snapshot.verify(back).count() == 0 and os.listdir(tmp_path) == ["s.db"]
    with pytest.raises(Exception, match="there already"):
        database.write_snapshot(tables, path)
    database.write_snapshot({"records": tables["records"].limit(4)}, path, overwrite=True)
    assert database.read_snapshot(spark, path)["records"].count() == 4


def test_lookups_read_what_they_ask_for(spark, tmp_path):
    path = str(tmp_path / "s.db")
    database.write_snapshot(tables_of(spark), path)

    def read(slices=4, **conditions):
        reader = database._Reader({"path": path, "table": "records", "slices": str(slices), **conditions})
        return [list(reader.read(p)) for p in reader.partitions()]

    assert [len(r) for r in read(kind="item", owner="p1", id="i7")] == [1]
    rows = read(kind="item", owner_from="p1", owner_to="p2")
    assert sum(map(len, rows)) == 100 and len(rows) == 4 and max(map(len, rows)) == 25
    assert [len(r) for r in read(slices=5)] == [61, 61, 61, 61, 59]  # ranges of the whole key
    # The condition reaches the database through its index, and the plan.
    db = sqlite3.connect(path)
    plan = db.execute("explain query plan select * from records where kind = 'item' and owner = 'p1' and id = 'i7'").fetchall()
    db.close()
    assert "USING INDEX" in plan[0][3]
    assert [r.id for r in database.lookup(spark, path, kind="item", owner="p1", id="i7").collect()] == ["i7"]
    assert database.lookup(spark, path, "assets", digest_from="0", digest_to="~").count() == 5 and database.lookup(spark, path, kind="none").count() == 0
    with pytest.raises(ValueError, match="content"):
        database.lookup(spark, path, content="{}")
    # A table can be asked again and again, with and without conditions.
    records = database.read_snapshot(spark, path)["records"]
    assert [records.where(c).count() for c in ("kind = 'item' and id like 'i1%'", "true", "kind > 'item'", "true")] == [111, 303, 3, 303]


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "s.db")
    rows = tables_of(spark)["records"]
    broken = rows.withColumn("content", F.when(F.col("id") == "i250", F.raise_error(F.lit("lost"))).otherwise(F.col("content"))).repartition(4)
    for df, what in ((broken, "lost"), (rows.unionAll(rows.limit(1)), "UNIQUE"), (rows.withColumn("owner", F.when(F.col("id") != "i3", F.col("owner"))), "NOT NULL")):
        with pytest.raises(Exception, match=what):
            database.write_snapshot({"records": df}, path)
        assert os.listdir(tmp_path) == []


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    log, other = commits.CommitLog(spark, path), commits.CommitLog(spark, path)
    assert log.latest() is None
    base = log.commit(None, "d0", ["a"])
    mine, theirs = log.latest(), other.latest()
    assert mine == theirs == base and base.version == 0
    # Both work from version 0. Different keys: the later one goes behind the earlier. A key in common: it is refused.
    assert other.commit(theirs, "d1", ["b"], ["b"]).version == 1
    assert log.commit(mine, "d2", ["c"], ["a"], replace=False).live == ("d1", "d2")
    for wrote, read in ((["b"], []), ([], ["b"]), (["*"], []), (["x"], ["*"])):
        with pytest.raises(commits.Conflict, match="version 1"):
            log.commit(mine, "d3", wrote, read)
    # Many at once: every version is given once.
    with concurrent.futures.ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: commits.CommitLog(spark, path).commit(base, f"t{i}", [f"k{i}"]).version, range(16)))
    assert sorted(made) == list(range(3, 19)) and log.versions() == list(range(19))


def test_publishers_do_not_overwrite_each_other(spark, tmp_path):
    path, tables = str(tmp_path / "out"), tables_of(spark, 6)
    tables["manifest"] = spark.createDataFrame([(1, 2, 16, 1, "me", "")], database.SCHEMAS["manifest"])
    first = snapshot.publish(tables, path)
    second = snapshot.publish(tables | {"assets": tables["assets"].limit(1)}, path, base=first)
    with pytest.raises(commits.Conflict):  # also made from the first, but later
        snapshot.publish(tables, path, base=first)
    assert snapshot.published(spark, path)["assets"].count() == 1 and len(list((tmp_path / "out").glob("*/records"))) == 2
    tree = spark.createDataFrame([("index.html", bytearray(b"1"))], "path string, bytes binary")
    made = site.publish_files(tree, str(tmp_path / "site"))
    site.publish_files(tree, str(tmp_path / "site"), base=made)
    with pytest.raises(commits.Conflict):
        site.publish_files(tree, str(tmp_path / "site"), base=made)
    # Clean-up keeps what a reader has leased, and what a writer may still be working on.
    log = commits.CommitLog(spark, path)
    release = log.lease(first.version)
    (tmp_path / "out" / ("0" * 32)).mkdir()
    assert log.clean(keep=1) == []
    release()
    assert log.clean(keep=1) == [first.data] and snapshot.published(spark, path)["records"].count() == 9
    assert log.clean(keep=1, age_seconds=-5) == ["0" * 32] and log.latest() == second


def test_write_once_tables_hold_for_writers_at_the_same_time(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "cache"), "key string, payload string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert commits.put_once(rows(("a", "1"), ("b", "2")), path) == 0
    assert commits.put_once(rows(("a", "1")), path) == -1
    plain, raced, other = snapshot.insert_once, [], ["c"]

    def slow(cache, entries, key, payload):
        """Another writer commits between this one's check and its commit."""
        found = plain(cache, entries, key, payload)
        if not raced:
            raced.append(1)
            commits.put_once(rows((other[0], "theirs")), path)
        return found

    monkeypatch.setattr(snapshot, "insert_once", slow)
    with pytest.raises(ValueError, match="other payloads"):
        commits.put_once(rows(("c", "mine")), path)
    raced.clear()
    other[0] = "f"
    assert commits.put_once(rows(("d", "4"), ("e", "5")), path) == 3  # behind the other's, whose key it does not touch
    got = sorted(map(tuple, commits.once(spark, path, schema).collect()))
    assert got == [("a", "1"), ("b", "2"), ("c", "theirs"), ("d", "4"), ("e", "5"), ("f", "theirs")]
    assert commits.once(spark, str(tmp_path / "none"), schema).count() == 0
