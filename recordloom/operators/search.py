"""Ranked substring search: one query by a scan, a table of queries by an inverted index of three-character pieces."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settle


def search(entries: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """The best ``limit`` entries (title, text, package, ordinal) that hold the query, with their ``rank``.

    Rank 0: the title is the query or ends with it after ``.`` or ``::``; 1: the title holds it; 2: the rest does.
    Entries of a rank keep the order of ``ordinal``. An empty query has no results. Filter, rank and limit are one
    pass and a top-k per partition; nothing is sorted whole.
    """
    q = query.strip().lower()
    if not q:
        return entries.withColumn("rank", F.lit(0)).limit(0)
    title = F.lower("title")
    text = _full_text()
    exact = (title == q) | F.endswith(title, F.lit(f".{q}")) | F.endswith(title, F.lit(f"::{q}"))
    rank = F.when(exact, 0).when(F.contains(title, F.lit(q)), 1).otherwise(2)
    return entries.where(F.contains(text, F.lit(q))).withColumn("rank", rank).orderBy("rank", "ordinal").limit(limit)


def _full_text() -> Column:
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("package", F.lit(""))))


def _grams(text: Column) -> Column:
    """The different three-character pieces of a text; two marks behind its end let every character begin one."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    marks = F.array(F.lit("\0"), F.lit("\0"))
    second, third = F.slice(F.concat(letters, marks), F.lit(2), F.size(letters)), F.slice(F.concat(letters, marks), F.lit(3), F.size(letters))
    both = F.zip_with(letters, second, lambda x, y: F.concat(x, y))
    return F.array_distinct(F.zip_with(both, third, lambda x, y: F.concat(x, y)))


def build_index(entries: DataFrame, block: int = 1 << 16, most: int = 1 << 20) -> DataFrame:
    """The inverted index of entries (title, text, package, ordinal): (gram, block, ordinals, n), sorted by gram in each partition.

    A row has entries of a block of ordinals that hold the gram, as a task met them, so no row grows with the table and
    none is shuffled; several rows may have the same gram and block. ``n`` is the number of its entries. A task holds at
    most about ``most`` of them. Written as Parquet, the order lets a look-up skip the row groups of other grams.
    """
    import pyarrow as pa

    def rows(held: dict) -> pa.RecordBatch:
        sizes = [len(found) for found in held.values()]
        ordinals = pa.array(itertools.chain.from_iterable(held.values()), pa.int64())
        listed = pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(sizes)], pa.int32()), ordinals)
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.string()), pa.array([b for _, b in held], pa.int64()), listed, pa.array(sizes, pa.int64())], names=["gram", "block", "ordinals", "n"])

    def run(batches):
        held, n = {}, 0
        for batch in batches:
            for ordinal, text in zip(batch.column("ordinal").to_pylist(), batch.column("text").to_pylist()):
                marked, at = text + "\0\0", ordinal // block
                grams = {marked[i : i + 3] for i in range(len(text))}
                for gram in grams:
                    held.setdefault((gram, at), []).append(ordinal)
                n += len(grams)
                if n >= most:
                    yield rows(held)
                    held, n = {}, 0
        if held:
            yield rows(held)

    texts = entries.where("ordinal is not null").select(F.col("ordinal").cast("long").alias("ordinal"), _full_text().alias("text"))
    return texts.mapInArrow(run, "gram string, block bigint, ordinals array<bigint>, n bigint").sortWithinPartitions("gram", "block")


def search_many(entries: DataFrame, index: DataFrame, queries: DataFrame, limit: int = 12, broadcast_rows: int = 200_000) -> DataFrame:
    """(query_id, query, title, text, package, ordinal, rank, place): what ``search`` finds for each of ``queries`` (query_id, query).

    A query's candidates are the entries that hold its rarest three-character piece; of one or two characters, those of
    all pieces that begin so. They are verified on their texts, ranked, and the best ``limit`` of each query kept. No
    query meets an entry that does not hold its rarest piece. ``ordinal`` tells entries apart.
    """
    asked = queries.select("query_id", F.lower(F.btrim("query", F.lit(" \t\n\x0b\x0c\r"))).alias("query")).where("query <> ''")
    counts = settle(index.groupBy("gram").agg(F.sum("n").alias("n")))
    pieces = asked.where("length(query) > 2").select("query_id", F.explode(F.filter(_grams(F.col("query")), lambda g: ~F.contains(g, F.lit("\0")))).alias("gram"))
    rarest = pieces.join(counts, "gram", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_r")).select("query_id", "_r.gram")
    short = counts.select("gram", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("query")).join(asked.where("length(query) < 3"), "query").select("query_id", "gram")
    wanted = settle(rarest.unionAll(short).distinct())
    small = wanted.count() <= broadcast_rows
    wanted = F.broadcast(wanted) if small else wanted
    candidates = index.join(wanted, "gram").select("query_id", F.explode("ordinals").alias("ordinal")).distinct()
    named = candidates.join(F.broadcast(asked) if small else asked, "query_id")
    met = named.join(entries.withColumn("_full", _full_text()), "ordinal").where(F.contains("_full", F.col("query")))
    title = F.lower("title")
    exact = (title == F.col("query")) | F.endswith(title, F.concat(F.lit("."), "query")) | F.endswith(title, F.concat(F.lit("::"), "query"))
    ranked = met.withColumn("rank", F.when(exact, 0).when(F.contains(title, F.col("query")), 1).otherwise(2))
    best = _best(ranked, limit).join(F.broadcast(asked) if small else asked, "query_id")
    few = small and asked.count() * limit <= broadcast_rows
    return (F.broadcast(best) if few else best).join(entries, "ordinal").select("query_id", "query", "title", "text", "package", "ordinal", "rank", "place")


def _best(ranked: DataFrame, limit: int) -> DataFrame:
    """(query_id, ordinal, rank, place): the first ``limit`` of each query, salted first so that no window is one query's whole."""
    rows = ranked.select("query_id", "rank", "ordinal", F.pmod(F.xxhash64("ordinal"), F.lit(64)).alias("_salt"))
    part = Window.partitionBy("query_id", "_salt").orderBy("rank", "ordinal")
    some = rows.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= limit)
    whole = Window.partitionBy("query_id").orderBy("rank", "ordinal")
    return some.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= limit).select("query_id", "ordinal", "rank", "place")
