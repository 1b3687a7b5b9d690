"""Debouncing a change log (path, state, at): changes closer than the quiet time are one burst.

As a table, bursts of single paths are keyed session windows; the bursts of all paths together come from merging those by
ranges of time, with what earlier ranges reach carried over, so no task sees the whole log. As a stream, every path has
its own state and timers on event time: a burst is handed on once the watermark has passed its quiet time, and its state
goes then. State and timers are part of the query's checkpoint, so a restarted query neither loses nor repeats a burst.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..plans.lineage import settle

#: What a burst of a path is: its first and last change, their number, and the state of the last one.
BURST = StructType(
    [StructField("path", StringType()), StructField("start", TimestampType()), StructField("last", TimestampType()), StructField("changes", LongType()), StructField("state", StringType())]
)


def path_bursts(observations: DataFrame, quiet_ms: int = 200) -> DataFrame:
    """(path, start, last, changes, state): the bursts of each path. Of changes at one time the greatest state is the last."""
    gap = F.session_window("at", f"{quiet_ms} milliseconds")
    found = observations.where("at is not null").groupBy("path", gap).agg(F.max("at").alias("last"), F.count("*").alias("changes"), F.max(F.struct("at", "state")).alias("_s"))
    return found.select("path", F.col("session_window.start").alias("start"), "last", "changes", "_s.state")


def settled_changes(observations: DataFrame, quiet_ms: int = 200) -> DataFrame:
    """(start, end, paths): the bursts of all paths together, with the quiet time behind the last change.

    The bursts of paths are sorted by ranges of their start. Within a range a running maximum tells how far earlier ones
    reach; one row for each range carries that, and the number of bursts so far, over to the later ranges.
    """
    quiet = f"interval {int(quiet_ms)} milliseconds"
    found = settle(path_bursts(observations, quiet_ms).select("path", "start", "last").orderBy("start", "path")).withColumn("_part", F.spark_partition_id())
    here = Window.partitionBy("_part").orderBy("start", "path")
    ranges = found.groupBy("_part").agg(F.max("last").alias("_last"))
    reach = ranges.select("_part", F.max("_last").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    open_ = found.join(F.broadcast(reach), "_part").withColumn("_before", F.greatest("_carried", F.max("last").over(here.rowsBetween(Window.unboundedPreceding, -1))))
    parted = settle(open_.select("path", "start", "last", "_part", F.coalesce(F.expr(f"start > _before + {quiet}"), F.lit(True)).cast("long").alias("_new")))
    begun = parted.groupBy("_part").agg(F.sum("_new").alias("_n"))
    number = begun.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_earlier"))
    bursts = parted.join(F.broadcast(number), "_part").select("path", "start", "last", (F.col("_earlier") + F.sum("_new").over(here)).alias("_burst"))
    return bursts.groupBy("_burst").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.array_sort(F.collect_set("path")).alias("paths")).select(
        "start", F.expr(f"last + {quiet}").alias("end"), "paths"
    )


class _Bursts(StatefulProcessor):
    """Open bursts of one path, as (start, last, changes, state) in milliseconds of event time."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, changes long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            held += [(int(a), int(a), 1, None if pd.isna(s) else s) for a, s in zip(at, frame["state"])]
        merged: list = []
        for start, last, changes, state in sorted(held, key=lambda b: (b[0], b[1])):
            if merged and start <= merged[-1][1] + 1000 * self.quiet:
                before = merged[-1]
                newer = max((before[1], before[3] is not None, before[3] or ""), (last, state is not None, state or ""))
                merged[-1] = (before[0], newer[0], before[2] + changes, newer[2] if newer[1] else None)
            else:
                merged.append((start, last, changes, state))
        self.open.put(merged)
        for start, last, _, _ in merged:
            self.handle.registerTimer(self._due(last))
        return iter(())

    def _due(self, last: int) -> int:
        """The first whole millisecond after the quiet time."""
        return last // 1000 + self.quiet + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        # A timer of a burst that has grown since finds it not yet due.
        done, rest = [b for b in held if self._due(b[1]) <= now], [b for b in held if self._due(b[1]) > now]
        if not done:
            return
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        start, last, changes, state = zip(*done)
        yield pd.DataFrame({"path": [key[0]] * len(done), "start": pd.to_datetime(start, unit="us"), "last": pd.to_datetime(last, unit="us"), "changes": changes, "state": pd.Series(state, dtype=object)})

    def close(self) -> None:
        pass


def stream_bursts(observations: DataFrame, quiet_ms: int = 200, late: str = "0 seconds") -> DataFrame:
    """The stream of ``path_bursts`` over a stream (path, state, at), each once its quiet time has passed.

    Changes that come later than ``late`` behind the newest one are dropped, as on any stream with a watermark. Arbitrary
    state needs the RocksDB state store (``use_rocksdb``).
    """
    marked = observations.select("path", "state", F.col("at").cast("timestamp").alias("at")).where("at is not null").withWatermark("at", late)
    return marked.groupBy("path").transformWithStateInPandas(_Bursts(quiet_ms), BURST, "Append", "eventTime")


def use_rocksdb(spark) -> None:
    """Keep the state of this session's new streaming queries in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
