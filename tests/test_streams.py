"""Streams with state against their tables and plain folds, across restarts and failures."""

import datetime
import json
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from recordloom.streaming import debounce, outputs

T0 = datetime.datetime(2024, 1, 1)
EVENT = "page string, seq long, cell long, kind string, name string, payload string, display_id string, wait boolean"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    debounce.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def put(folder, n, rows):
    (folder / f"{n:04}.json").write_text("".join(json.dumps(r, default=str) + "\n" for r in rows))


def drained(stream, kind, out, checkpoint, each=None):
    """Run a stream over what is there, into Parquet files or a function of each batch."""
    writer = stream.writeStream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).outputMode("append")
    writer = writer.foreachBatch(each) if each else writer.format(kind)
    query = writer.start() if each else writer.start(str(out))
    query.awaitTermination()


def log_of(rng, n, paths):
    at, rows = 0, []
    for _ in range(n):
        at += rng.choice([5, 30, 99, 100, 101, 250, 3000])
        rows.append({"path": rng.choice(paths), "state": rng.choice(["x", "y", None]), "at": (T0 + datetime.timedelta(milliseconds=at)).isoformat()})
    return rows


def test_streamed_bursts_survive_restarts_and_failures(rocks, tmp_path):
    spark, rng = rocks, random.Random(1)
    log = log_of(rng, 120, "abc")
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    source.mkdir()
    read = lambda: spark.readStream.schema("path string, state string, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    failed = []

    def store(batch, number):
        rows = batch.collect()
        if number == 2 and not failed:  # the executor or the driver is lost while a batch is being written
            failed.append(number)
            raise RuntimeError("lost")
        spark.createDataFrame(rows, batch.schema).write.mode("overwrite").parquet(f"{out}/batch={number}")

    for part in range(4):  # the query ends and starts again between the parts
        rows = log[part * 30 : part * 30 + 30]
        rng.shuffle(rows)  # within a file changes are in no order
        put(source, part, rows)
        try:
            drained(debounce.stream_bursts(read(), 100), None, None, checkpoint, store)
        except StreamingQueryException:
            assert failed == [2]
            drained(debounce.stream_bursts(read(), 100), None, None, checkpoint, store)
    put(source, 99, [{"path": "end", "state": "z", "at": (T0 + datetime.timedelta(days=1)).isoformat()}])
    drained(debounce.stream_bursts(read(), 100), None, None, checkpoint, store)
    columns = ["path", "start", "last", "changes", "state"]
    got = sorted((tuple(r) for r in spark.read.parquet(str(out)).select(columns).collect()), key=str)
    table = debounce.path_bursts(spark.read.schema("path string, state string, at timestamp").json(str(source)).where("path <> 'end'"), 100)
    assert failed and got == sorted((tuple(r) for r in table.select(columns).collect()), key=str) and len(got) > 30


def test_bursts_of_all_paths_equal_a_plain_merge(spark):
    for n, parts in ((0, 1), (1, 1), (200, 7)):
        log = log_of(random.Random(n), n, "abcdef")
        df = spark.createDataFrame([(r["path"], r["state"], datetime.datetime.fromisoformat(r["at"])) for r in log] + [("null", "x", None)], "path string, state string, at timestamp").repartition(parts)
        want = []
        for r in log:
            at = datetime.datetime.fromisoformat(r["at"])
            if want and at <= want[-1][1] + datetime.timedelta(milliseconds=100):
                want[-1] = (want[-1][0], at, want[-1][2] | {r["path"]})
            else:
                want.append((at, at, {r["path"]}))
        got = sorted((r.start, r.end - datetime.timedelta(milliseconds=100), set(r.paths)) for r in debounce.settled_changes(df, 100).collect())
        assert got == want


def plain_fold(events, join_streams):
    """(cell, position, kind, name, payload, problem) of one page, event by event."""
    cells, waiting, problems = {}, set(), []
    for e in events:
        own = cells.setdefault(e["cell"], [])
        if e["kind"] == "update":
            hit = [s for c in cells.values() for s in c if s["kind"] in ("display", "result") and s["display_id"] is not None and s["display_id"] == e["display_id"]]
            for s in hit:
                s["payload"] = e["payload"]
            problems += [] if hit else [(e["cell"], None, "update", None, e["display_id"], "unknown-display")]
        elif e["kind"] == "clear" and e["wait"]:
            waiting.add(e["cell"])
        elif e["kind"] == "clear":
            own.clear()
            waiting.discard(e["cell"])
        else:
            if e["cell"] in waiting:
                waiting.discard(e["cell"])
                own.clear()
            if join_streams and e["kind"] == "stream" and own and own[-1]["kind"] == "stream" and own[-1]["name"] == e["name"]:
                own[-1]["payload"] += e["payload"]
            else:
                own.append(dict(e))
    return [(c, i, s["kind"], s["name"], s["payload"], None) for c, own in cells.items() for i, s in enumerate(own)] + problems


def events_of(rng, page, n):
    kinds = ["stream"] * 4 + ["display"] * 4 + ["result", "error", "warning"] + ["update"] * 4 + ["clear"] * 2
    return [
        {"page": page, "seq": 10 * i, "cell": rng.randrange(3), "kind": rng.choice(kinds), "name": rng.choice(["out", "err", None]), "payload": f"p{i}", "display_id": rng.choice(["d1", "d2", None]), "wait": rng.random() < 0.5}
        for i in range(n)
    ]


def by_row(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("join_streams", [True, False])
def test_outputs_equal_the_plain_fold(spark, join_streams):
    rng = random.Random(7)
    pages = {f"p{i}": events_of(rng, f"p{i}", rng.randrange(40)) for i in range(60)}
    rows = [tuple(e.values()) for es in pages.values() for e in es]
    rng.shuffle(rows)
    got = outputs.reduce_outputs(spark.createDataFrame(rows, EVENT), join_streams).collect()
    want = [(p, *r) for p, es in pages.items() for r in plain_fold(es, join_streams)]
    assert by_row((r.page, r.cell, r.position, r.kind, r.name, r.payload, r.problem) for r in got) == by_row(want)
    assert outputs.reduce_outputs(spark.createDataFrame([], EVENT)).count() == 0


def test_streamed_outputs_equal_the_table(rocks, tmp_path):
    spark, rng = rocks, random.Random(9)
    pages = {f"p{i}": events_of(rng, f"p{i}", 60) for i in range(8)}
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    source.mkdir()
    read = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(source))
    for part in range(3):  # the query ends and starts again between the parts
        put(source, part, [e for es in pages.values() for e in es[part * 20 : part * 20 + 20]])
        drained(outputs.stream_changes(read()), "parquet", out, checkpoint)
        now = outputs.current_outputs(spark.read.parquet(str(out)))
        table = outputs.reduce_outputs(spark.createDataFrame([tuple(e.values()) for es in pages.values() for e in es[: part * 20 + 20]], EVENT))
        assert by_row(map(tuple, now.select(table.columns).collect())) == by_row(map(tuple, table.collect()))


def test_an_update_costs_one_look_up(spark):
    took = []
    for n in (20_000, 80_000):
        i = F.col("id")
        events = spark.range(2 * n).select(
            F.lit("p").alias("page"), i.alias("seq"), (i % 50).alias("cell"), F.when(i < n, "display").otherwise("update").alias("kind"), F.lit(None).cast("string").alias("name"),
            i.cast("string").alias("payload"), F.concat(F.lit("d"), i % n).alias("display_id"), F.lit(False).alias("wait"),
        )
        began = time.time()
        got = outputs.reduce_outputs(events).agg(F.count("*"), F.sum(F.col("payload").cast("long")), F.count("problem")).first()
        took.append(time.time() - began)
        assert got == (n, sum(range(n, 2 * n)), 0)
    assert took[1] < 8 * took[0] + 5
