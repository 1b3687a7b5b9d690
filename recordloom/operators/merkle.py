"""Digests of trees of files, bottom up, and differences that go down only where digests differ.

A folder's digest covers names, modes, kinds and digests of what is directly in it. The entries of a folder are digested
by 256 buckets of their names first, so that a folder of very many files is the work of as many tasks; a bucket is the
largest group. A level is one round, from the deepest to the root, and folders are rows of the result like files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle

NODE = ["path", "parent", "depth", "directory", "mode", "digest"]
#: Rows of changed folders that a step of a difference broadcasts; more are joined by a shuffle.
BROADCAST = 200_000


def _with_parent(rows: DataFrame) -> DataFrame:
    """``parent`` and ``depth`` of slash-separated paths; the root is the empty path."""
    parts = F.split("path", "/")
    parent = F.when(F.col("path") != "", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    return rows.withColumn("parent", parent).withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(parts)))


def _digests(entries: DataFrame) -> DataFrame:
    """(path, digest) of the folders that the entries (parent, path, directory, mode, digest) lie in."""
    name = F.element_at(F.split("path", "/"), -1)
    line = F.concat_ws(" ", F.coalesce(F.col("mode").cast("string"), F.lit("-")), F.when(F.col("directory"), "folder").otherwise("file"), "digest", name)
    listed = entries.select("parent", F.substring(F.sha2(name, 256), 1, 2).alias("bucket"), line.alias("line"))
    buckets = listed.groupBy("parent", "bucket").agg(F.array_sort(F.collect_list("line")).alias("ls")).select("parent", "bucket", F.sha2(F.array_join("ls", "\n"), 256).alias("d"))
    return buckets.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("bucket", "d"))).alias("bs")).select(
        F.col("parent").alias("path"), F.sha2(F.array_join(F.transform("bs", lambda b: b["d"]), "\n"), 256).alias("digest")
    )


def merkle_tree(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """All nodes (``NODE``) of a tree of files (path, digest, mode). Folders come from the paths; those of ``folders``
    (path, mode) have a mode, and are there even if they are empty. A missing file has a null digest, which is one too."""
    leaves = _with_parent(files.select("path", F.lit(False).alias("directory"), "mode", F.coalesce("digest", F.lit("missing")).alias("digest"))).select(NODE)
    parts = F.split("path", "/")
    uppers = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    named = files.select("path") if folders is None else files.select("path").unionAll(folders.where("path <> ''").select("path"))
    implied = named.select(F.explode(uppers).alias("path"))
    given = implied.select("path", F.lit(None).cast(files.schema["mode"].dataType).alias("mode"))
    if folders is not None:
        given = given.unionByName(folders.select("path", F.col("mode").cast(files.schema["mode"].dataType)))
    inner = settle(_with_parent(given.groupBy("path").agg(F.max("mode").alias("mode"))))
    deepest = inner.agg(F.max("depth")).first()[0]
    if deepest is None:
        return leaves
    empty, done = F.sha2(F.lit(""), 256), []
    below = None
    for depth in range(deepest, -1, -1):
        entries = leaves.where(F.col("depth") == depth + 1)
        found = _digests(entries if below is None else entries.unionByName(below))
        level = inner.where(F.col("depth") == depth).join(found, "path", "left")
        below = settle(level.withColumn("directory", F.lit(True)).withColumn("digest", F.coalesce("digest", empty)).select(NODE))
        done.append(below)
    return reduce(DataFrame.unionByName, done, leaves)


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, directory, change) between two trees of ``merkle_tree``: added, removed or modified.

    Starts at the roots and opens only folders that differ: what is read of the trees is what lies directly in them. A
    folder is modified if its own mode is; a path that was a file and is a folder, or the other way, is removed and added.
    """
    columns = ["path", "parent", "directory", "mode", "digest"]
    a, b = before.select(columns), after.select(columns)
    spark, found = before.sparkSession, []
    open_ = spark.createDataFrame([], "path string")
    step = _pairs(a.where("path = ''"), b.where("path = ''"))
    while True:
        differ = settle(step)
        found.append(differ)
        open_ = differ.where("(coalesce(da, false) or coalesce(db, false)) and not (ha <=> hb)").select(F.col("path").alias("parent"))
        count = open_.count()
        if not count:
            break
        open_ = F.broadcast(open_) if count <= BROADCAST else open_
        step = _pairs(a.join(open_, "parent", "left_semi"), b.join(open_, "parent", "left_semi"))
    every = reduce(DataFrame.unionByName, found)
    same_kind = F.col("da").eqNullSafe(F.col("db"))
    gone = every.where(F.col("da").isNotNull() & ~same_kind).select("path", F.col("da").alias("directory"), F.lit("removed").alias("change"))
    new = every.where(F.col("db").isNotNull() & ~same_kind).select("path", F.col("db").alias("directory"), F.lit("added").alias("change"))
    own = every.where(same_kind & (~F.col("da") | ~F.col("ma").eqNullSafe(F.col("mb")))).select("path", F.col("da").alias("directory"), F.lit("modified").alias("change"))
    return gone.unionAll(new).unionAll(own)


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes side by side where they differ. The mode of the root is nobody's entry, but it is its own."""
    x = a.select("path", F.col("directory").alias("da"), F.col("mode").alias("ma"), F.col("digest").alias("ha"))
    y = b.select("path", F.col("directory").alias("db"), F.col("mode").alias("mb"), F.col("digest").alias("hb"))
    return x.join(y, "path", "full_outer").where("not (da <=> db and ma <=> mb and ha <=> hb)")
