"""Aggregations, orders, set operations and constraints over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Titles, white space collapsed, of several pages (title, route), with their routes in order."""
    named = pages.select(collapse_space(F.col("title")).alias("title"), "route")
    return named.groupBy("title").agg(F.count("*").alias("n"), F.expr("listagg(route, ', ') within group (order by route)").alias("routes")).where("n > 1")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def repeats(rows: DataFrame, scope: list[str], name: str, ordinal: str) -> DataFrame:
    """Every declaration after the first of a name in its scope."""
    w = Window.partitionBy(*scope, name).orderBy(ordinal)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def merge_assets(assets: DataFrame) -> DataFrame:
    """(digest, media_type, conflict): a specific type beats the generic one, two specific ones are a conflict."""
    specific = F.when(F.col("media_type") != "application/octet-stream", F.col("media_type"))
    kinds, sizes = F.count_distinct(specific), F.count_distinct("byte_size")
    return assets.groupBy("digest").agg(
        F.coalesce(F.max(specific), F.lit("application/octet-stream")).alias("media_type"), ((kinds > 1) | (sizes > 1)).alias("conflict")
    )


def navigation_groups(pages: DataFrame) -> DataFrame:
    """(grp, path, position): pages (path) by first path segment; pages without one are in the group ``''``.

    The overview comes first, then pages by their path. One sort by ranges numbers all groups, however large.
    """
    from .graphs import numbered
    group = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    rows = pages.select(group.alias("grp"), "path")
    placed = numbered(rows.withColumn("_rest", ~F.endswith("path", F.lit("index.html"))), "grp", "_rest", "path", name="_n")
    first = placed.groupBy("grp").agg(F.min("_n").alias("_first"))
    return placed.join(first, "grp").select("grp", "path", (F.col("_n") - F.col("_first")).alias("position"))


def grouped_members(members: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Members (owner, kind, name, id) with ``position`` in the order of kind rank, name and id."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("kind")), F.lit(len(ranks)))
    w = Window.partitionBy("owner").orderBy("rank", "name", "id")
    return members.withColumn("rank", rank).withColumn("position", F.row_number().over(w))


#: Under which title each kind of C++ member stands; all others are methods.
CPP_TITLES = {"field": "Fields", "variable": "Fields", "enumerator": "Values", "type-alias": "Types"}


def titled_members(members: DataFrame) -> DataFrame:
    """(owner, title, id, position) of C++ members (owner, kind, family, name, id), titles in alphabetical order.

    A member of a family, unless the family is another member's, is an overload; within a title the order is by name, id.
    """
    titles = F.create_map(*[F.lit(x) for kv in CPP_TITLES.items() for x in kv])
    own = members.where(F.col("family").isNull() | (F.col("family") == F.col("owner")))
    title = F.when(F.col("family").isNotNull(), "Overloads").otherwise(F.coalesce(F.try_element_at(titles, F.col("kind")), F.lit("Methods")))
    w = Window.partitionBy("owner").orderBy("title", "name", "id")
    return own.withColumn("title", title).select("owner", "title", "id", (F.row_number().over(w) - 1).alias("position"))


def missing_last(*columns: str) -> list[Column]:
    """Sort keys in which a missing value comes after all others."""
    return [F.col(c).asc_nulls_last() for c in columns]


def order_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics with their ``position`` in the total order: source, span, code, severity, entity, message, related spans; missing last."""
    from .graphs import numbered

    return numbered(diagnostics, *missing_last("source", "span", "code", "severity", "entity", "message", "related_spans"))


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key: a minimum over structs, which aggregates before the shuffle; no window sort."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest, *order), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}") for c in (*rest, *order)])


def last_in_place(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The last value of each key, at the position of its first."""
    return rows.groupBy(*keys).agg(F.max_by(value, position).alias(value), F.min(position).alias(position))


def next_free(used: set, pointers: dict, slug: str) -> str:
    """``slug``, or with the least number from 2 that makes it new. A pointer for each slug never looks at a number twice."""
    found = slug
    if found in used:
        n = pointers.get(slug, 2)
        while (found := f"{slug}-{n}") in used:
            n += 1
        pointers[slug] = n + 1
    used.add(found)
    return found


def unique_slugs(headings: DataFrame) -> DataFrame:
    """(doc, ordinal, slug, identifier): repeated slugs get ``-2``, ``-3`` … against all identifiers used before.

    The suffixes cascade, so a document is walked in order: its rows stream through one task, sorted, which holds the
    identifiers of that document alone. The work is linear in the headings. A null slug stays without identifier.

    The window is what tells Spark that a document's rows belong together: a mere ``repartition`` is left out where a join
    has dealt the rows by document already, and that join may then be dealt by its mappers or split anew.
    """
    import pyarrow as pa

    kinds = {c: headings.schema[c].dataType.simpleString() for c in ("doc", "ordinal")}

    def run(batches):
        used, pointers = set(), {}
        for batch in batches:
            out = []
            for n, s in zip(batch.column("_n").to_pylist(), batch.column("slug").to_pylist()):
                if n == 1:
                    used, pointers = set(), {}
                out.append(None if s is None else next_free(used, pointers, s))
            rest = batch.select(["doc", "ordinal", "slug"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.string())], names=[*rest.schema.names, "identifier"])

    place = F.row_number().over(Window.partitionBy("doc").orderBy("ordinal", "slug"))
    dealt = headings.select("doc", "ordinal", "slug").withColumn("_n", place)
    return dealt.mapInArrow(run, f"doc {kinds['doc']}, ordinal {kinds['ordinal']}, slug string, identifier string")


def preferred(rows: DataFrame, keys: list[str], value: str, preference: list[str]) -> DataFrame:
    """The value of each key that stands first in ``preference``, and all that stand in it, in that order."""
    place = F.array_position(F.array(*map(F.lit, preference)), F.col(value))
    ranked = F.array_sort(F.collect_set(F.when(place > 0, F.struct(place.alias("p"), F.col(value).alias("v")))))
    return rows.groupBy(*keys).agg(F.transform(ranked, lambda x: x["v"]).alias("accepted")).withColumn("selected", F.try_element_at("accepted", F.lit(1)))


def option_values(options: DataFrame) -> DataFrame:
    """(cell, key, value): the highest tier wins; a key repeated within a tier is ambiguous and not applied there."""
    single = options.groupBy("cell", "key", "tier").agg(F.count("*").alias("n"), F.max("value").alias("value")).where("n = 1")
    return single.groupBy("cell", "key").agg(F.max_by("value", "tier").alias("value"))


def coverage(ranges: DataFrame) -> DataFrame:
    """(doc, covered): whether the ranges (doc, ord, start, stop, length) follow each other from 0 to the length."""
    w = Window.partitionBy("doc").orderBy("ord")
    chained = ranges.withColumn("ok", F.col("start") == F.coalesce(F.lag("stop").over(w), F.lit(0)))
    return chained.groupBy("doc").agg((F.bool_and("ok") & (F.max_by("stop", "ord") == F.max("length"))).alias("covered"))


def median_p95(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, and the nearest-rank 95th percentile."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.median(value).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95")
    )


def hit_miss(events: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    return events.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


def phase_seconds(events: DataFrame) -> DataFrame:
    """(sample, phase, seconds) from (sample, id, phase, event, at): finish less start of each id, summed.

    One aggregation pairs starts and finishes; ids without exactly one of each are dropped (see ``unbalanced``).
    """
    return _paired(events).where("starts = 1 and ends = 1").groupBy("sample", "phase").agg(F.sum(F.col("finish") - F.col("start")).alias("seconds"))


def unbalanced(events: DataFrame) -> DataFrame:
    return _paired(events).where("starts <> 1 or ends <> 1").select("sample", "phase", "id")


def _paired(events: DataFrame) -> DataFrame:
    begins, ends = F.col("event") == "start", F.col("event") == "finish"
    return events.groupBy("sample", "phase", "id").agg(
        F.max(F.when(begins, F.col("at"))).alias("start"), F.max(F.when(ends, F.col("at"))).alias("finish"),
        F.count_if(begins).alias("starts"), F.count_if(ends).alias("ends"),
    )


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) of keys on one side only, or with other values; a null value is a value."""
    a = before.select(F.col(key), F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    b = after.select(F.col(key), F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    change = F.when(F.col("_ina").isNull(), "added").when(F.col("_inb").isNull(), "removed").otherwise("modified")
    differs = F.col("_ina").isNull() | F.col("_inb").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return a.join(b, key, "full_outer").where(differs).select(key, change.alias("change"))


def difference(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Keys of ``before`` that ``after`` has no more, each once; null keys are keys."""
    return before.select(*keys).subtract(after.select(*keys))


def replacement(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action) that make ``after`` out of ``before``: ``write`` what is new or differs, ``delete`` what is gone."""
    action = F.when(F.col("change") == "removed", "delete").otherwise("write")
    return changed(before, after, key, value).select(key, action.alias("action"))


def diagnostics_set(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics, each once, equal in all columns."""
    return diagnostics.dropDuplicates()


def retained_assets(slots: DataFrame) -> DataFrame:
    """(digest, media_type, uses, conflict) of the assets (slot, digest, media_type, bytes) that surviving slots name."""
    kinds = F.count_distinct("media_type", "byte_size")
    return slots.groupBy("digest").agg(F.min("media_type").alias("media_type"), F.count_distinct("slot").alias("uses"), (kinds > 1).alias("conflict"))


def observed_values(rows: DataFrame, keys: list[str], json_col: str, paths: dict[str, str]) -> DataFrame:
    """For each key the sorted set of values at each JSON path of its rows; a path under an array takes all elements."""
    named = rows.select(*keys, *[F.get_json_object(json_col, p).alias(n) for n, p in paths.items()])
    return named.groupBy(*keys).agg(*[F.array_sort(F.collect_set(n)).alias(n) for n in paths])


def sections(members: DataFrame) -> DataFrame:
    """(owner, section, item, position) of members (owner, role, item, start, ord): fields in the order of their source,
    those without a place first and as given, then methods as given."""
    rank = F.when(F.col("role") == "field", 0).when(F.col("role") == "method", 1)
    start = F.when(F.col("role") == "field", F.col("start"))
    w = Window.partitionBy("owner", "_rank").orderBy(start.asc_nulls_first(), "ord")
    rows = members.withColumn("_rank", rank).where("_rank is not null").withColumn("position", F.row_number().over(w) - 1)
    return rows.select("owner", F.when(F.col("_rank") == 0, "Fields").otherwise("Methods").alias("section"), "item", "position")


def keyword_only_last(parameters: DataFrame) -> DataFrame:
    """Parameters (owner, ord, name, keyword_only) with ``position``: keyword-only ones after all others, else as given."""
    w = Window.partitionBy("owner").orderBy("keyword_only", "ord")
    return parameters.withColumn("position", F.row_number().over(w) - 1)


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's child."""
    return nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def minimal_roots(paths: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """Paths under no other path of the table: an anti-join on exploded ancestors.

    A path is not covered by one above it if an excluded folder lies between them, as a walk would not enter that. What
    covers is then always a kept path: one that is itself covered has a kept one above it, with nothing between them.
    """
    parts = F.split("path", "/")
    n = F.size(parts)
    bad = F.transform(parts, lambda p: p.isin(*excluded)) if excluded else F.transform(parts, lambda p: F.lit(False))
    # The shortest ancestor that a walk reaches the path from: everything below the last excluded component.
    last = F.coalesce(F.array_max(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.element_at(bad, i), i))), F.lit(1))
    upper = F.transform(F.sequence(last, n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = F.when(last <= n - 1, upper).otherwise(F.array().cast("array<string>"))
    tried = paths.select("path", F.explode(above).alias("_up"))
    covered = tried.join(paths.select(F.col("path").alias("_up")).distinct(), "_up", "left_semi").select("path")
    return paths.distinct().join(covered, "path", "left_anti")


def overlapping_prefixes(sections: DataFrame) -> DataFrame:
    """(prefix, inner): pairs of different prefixes, one of which starts with the other, by components."""
    parts = F.split("prefix", "/")
    uppers = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    inner = sections.select(F.col("prefix").alias("inner"), F.explode(uppers).alias("prefix"))
    return inner.join(sections.select("prefix").distinct(), "prefix").select("prefix", "inner")


def relationship_checks(relationships: DataFrame, versions: DataFrame) -> DataFrame:
    """Relationships (from, to, constraint) with the version they meet and ``outcome``: ok, mismatch or unknown."""
    from ..functions.versions import satisfies

    met = relationships.join(versions.withColumnRenamed("package", "to"), "to")
    holds = satisfies(F.col("ecosystem"), F.col("version"), F.col("constraint"))
    return met.withColumn("outcome", F.when(holds, "ok").when(~holds, "mismatch").otherwise("unknown"))
