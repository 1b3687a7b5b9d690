"""Watching input tables: changes between observations, debounced, with our own writes left out.

An observation is (path, state), where the state is a digest or the kind of an error. A watcher is a file stream whose
micro-batches hold rewritten observations; the last published state is a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import changed
from ..sources.snapshot import replace_text

OBSERVATION = "path string, state string, at timestamp"


def observe(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(path, state) of a binary-file table; a declared path without a file is ``missing``."""
    seen = files.select("path", F.sha2("content", 256).alias("state"))
    if declared is None:
        return seen
    return declared.select("path").join(seen, "path", "left").withColumn("state", F.coalesce("state", F.lit("missing")))


def reuse_digests(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, stamp, digest): digests of unchanged stat stamps are reused, the others are null and have to be made."""
    return listing.join(known.select("path", "stamp", "digest"), ["path", "stamp"], "left")


def unacknowledged(changes: DataFrame, now: DataFrame, written: DataFrame) -> DataFrame:
    """Changes whose present state is not one that we wrote ourselves."""
    own = now.join(written, ["path", "state"], "left_semi").select("path")
    return changes.join(own, "path", "left_anti")


def inputs_match(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(ok): whether recorded and current inputs are the same, absent ones included."""
    return changed(recorded, current, "path", "state").agg((F.count("*") == 0).alias("ok"))


def cache_hits(requests: DataFrame, entries: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(key, payload, hit, reason) of requested results (key).

    ``entries`` is (key, payload), ``recorded`` the inputs (key, path, state) that a result was made from, ``current``
    the present (path, state). A result counts only if it has recorded inputs, all of them are as they were (an absent
    one is still absent), and its payload is whole JSON.
    """
    now = recorded.join(current.withColumnRenamed("state", "_now"), "path", "left")
    fresh = now.groupBy("key").agg(F.bool_and(F.coalesce(F.col("state").eqNullSafe(F.col("_now")), F.lit(False))).alias("_fresh"))
    met = requests.select("key").join(entries, "key", "left").join(fresh, "key", "left")
    whole = F.try_parse_json("payload").isNotNull()
    hit = F.coalesce(F.col("_fresh") & whole, F.lit(False))
    reason = (
        F.when(hit, F.lit(None)).when(F.col("payload").isNull(), "no-entry").when(F.col("_fresh").isNull(), "no-inputs")
        .when(~F.col("_fresh"), "inputs-changed").otherwise("broken-payload")
    )
    return met.select("key", F.when(hit, F.col("payload")).alias("payload"), hit.alias("hit"), reason.alias("reason"))


def page_keys(parts: DataFrame, domain: str = "recordloom/page-v1") -> DataFrame:
    """(page, key): the digest of everything that a page's result depends on (page, name, value), in the order of names.

    With these keys ``cache_hits`` looks up whole pages.
    """
    from ..functions.canonical import domain_digest
    from ..functions.text import json_string

    listed = parts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: F.concat(json_string(p["name"]), F.lit(":"), F.coalesce(json_string(p["value"]), F.lit("null")))), ",")
    return listed.select("page", domain_digest(domain, F.concat(F.lit("{"), text, F.lit("}"))).alias("key"))


def link_cycles(links: DataFrame) -> DataFrame:
    """(path): links (path, target) of a directory tree that lead back to themselves; a walk would never end."""
    from ..operators.graphs import closure

    found = closure(links.select(F.col("path").alias("src"), F.col("target").alias("dst")))
    return found.where("start = node").select(F.col("start").alias("path"))


def stream_observations(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over a folder of observation files in JSON."""
    return spark.readStream.schema(OBSERVATION).json(folder)


def states(spark: SparkSession, marker: str) -> list[int]:
    """The batches whose states are complete, in order."""
    try:
        return [int(n) for r in spark.read.text(marker).collect() for n in r["value"].split(",")]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def watch(
    observations: DataFrame, state_path: str, publish: Callable[[DataFrame, int], None], checkpoint: str, written: DataFrame | None = None
) -> StreamingQuery:
    """Publish the changes of each micro-batch against the last published state.

    The state moves on only after ``publish`` has succeeded, so a failed attempt is made again with the same changes
    and the last good output stays. Every batch writes its state to a folder of its own, which a repeated batch
    overwrites, and only then the marker that makes it count; a state without any path is a state as well.
    """
    spark = observations.sparkSession
    schema = "path string, state string"
    marker = f"{state_path}/CURRENT"

    def last_before(number: int) -> DataFrame:
        done = [n for n in states(spark, marker) if n < number]
        return spark.read.schema(schema).parquet(f"{state_path}/batch={max(done)}") if done else spark.createDataFrame([], schema)

    def batch(rows: DataFrame, number: int) -> None:
        now = rows.groupBy("path").agg(F.max_by("state", "at").alias("state"))
        before = last_before(number)
        rest = before.join(now, "path", "left_anti")
        after = rest.unionByName(now.where("state <> 'removed'"))
        changes = changed(before, after, "path", "state")
        if written is not None:
            changes = unacknowledged(changes, now, written)
        publish(changes, number)
        after.write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        # The last two states count: a batch that is repeated after its marker starts from the one before it.
        replace_text(spark, marker, ",".join(map(str, [*[n for n in states(spark, marker) if n < number][-1:], number])))

    return observations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_lines(changes: DataFrame, snapshot: str) -> DataFrame:
    """One JSON line for each published snapshot."""
    paths = changes.agg(F.array_sort(F.collect_set("path")).alias("changed"))
    return paths.select(F.to_json(F.struct(F.lit(snapshot).alias("snapshot"), "changed")).alias("value"))
