"""Link targets, help topics, and the constraints on published links, assets and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import relative_url, url_allowed


def resolve_links(refs: DataFrame, anchors: DataFrame, pages: DataFrame, assets: DataFrame, repository: DataFrame) -> DataFrame:
    """Resolve ``refs`` (ref, doc, spelling, path, fragment) in a fixed order of kinds.

    External URLs come first, then a bare fragment in the same document, a page path (of exactly one page, whose
    anchors must hold a fragment), an asset path, and a path in the repository. Adds ``kind``, ``target`` and
    ``problem``. ``path`` is the normalised path of the spelling, null if it has none.
    """
    one_page = pages.groupBy("path").agg(F.count("*").alias("_pages"), F.max("page").alias("_page"))
    own = anchors.select(F.col("doc"), F.col("anchor").alias("fragment"), F.lit(True).alias("_own"))
    far = anchors.select(F.col("doc").alias("_page"), F.col("anchor").alias("fragment"), F.lit(True).alias("_far"))
    rows = (
        refs.join(own.distinct(), ["doc", "fragment"], "left")
        .join(one_page, "path", "left")
        .join(far.distinct(), ["_page", "fragment"], "left")
        .join(assets.select("path", F.col("digest").alias("_asset")).dropDuplicates(["path"]), "path", "left")
        .join(repository.select("path", F.lit(True).alias("_file")).distinct(), "path", "left")
    )
    scheme = F.regexp_like("spelling", F.lit("^[A-Za-z][A-Za-z0-9+.-]*:|^//"))
    bare = F.startswith("spelling", F.lit("#"))
    page = (F.col("_pages") == 1) & (F.col("fragment").isNull() | F.col("_far"))
    kind = (
        F.when(scheme & url_allowed(F.col("spelling")), "external").when(scheme, F.lit(None))
        .when(bare & F.col("_own"), "anchor").when(bare, F.lit(None))
        .when(page, "page").when(F.col("_pages") >= 1, F.lit(None))
        .when(F.col("_asset").isNotNull(), "asset").when(F.col("_file"), "repository")
    )
    problem = (
        F.when(kind.isNotNull(), F.lit(None)).when(scheme, "unsafe-url").when(bare | (F.col("_pages") == 1), "missing-anchor")
        .when(F.col("_pages") > 1, "ambiguous-page").otherwise("missing-target")
    )
    target = F.when(kind == "external", F.col("spelling")).when(kind == "anchor", F.col("doc")).when(kind == "page", F.col("_page"))
    target = target.when(kind == "asset", F.col("_asset")).when(kind == "repository", F.col("path"))
    return rows.select(*refs.columns, kind.alias("kind"), target.alias("target"), problem.alias("problem"))


def target_urls(links: DataFrame, routes: DataFrame) -> DataFrame:
    """``url`` of resolved links (from_route, page, fragment): the way from page to page, with the fragment."""
    placed = links.join(routes.select("page", F.col("route").alias("_to")), "page", "left")
    mark = F.when(F.col("fragment").isNotNull(), F.concat(F.lit("#"), "fragment")).otherwise("")
    way = F.when(F.col("from_route") == F.col("_to"), mark).otherwise(F.concat(relative_url(F.col("from_route"), F.col("_to")), mark))
    return placed.withColumn("url", way).drop("_to")


def resolve_topics(refs: DataFrame, topics: DataFrame, installed: DataFrame) -> DataFrame:
    """Help links (ref, owner, package, topic): the owner's topics, then those of the named or any package, then
    installed help. A reference to a package of the workspace never falls through to installed help."""
    from .resolve import best_targets, by_name

    inside = topics.select("package").distinct().withColumn("_ours", F.lit(True))
    rows = refs.join(inside, "package", "left")
    tried = [
        rows.where("package is null").select("ref", F.concat_ws("\0", "owner", "topic").alias("name"), F.lit(0).alias("tier")),
        rows.where("package is not null").select("ref", F.concat_ws("\0", "package", "topic").alias("name"), F.lit(1).alias("tier")),
        rows.where("package is null").select("ref", F.concat(F.lit("\0"), "topic").alias("name"), F.lit(1).alias("tier")),
        rows.where("_ours is null").select("ref", F.concat(F.lit("?\0"), "topic").alias("name"), F.lit(2).alias("tier")),
    ]
    names = topics.select(F.concat_ws("\0", "package", "topic").alias("name"), F.concat_ws("/", "package", "item").alias("target"))
    names = names.unionAll(topics.select(F.concat(F.lit("\0"), "topic").alias("name"), F.concat_ws("/", "package", "item").alias("target")))
    names = names.unionAll(installed.select(F.concat(F.lit("?\0"), "topic").alias("name"), F.col("url").alias("target")))
    wanted = tried[0]
    for t in tried[1:]:
        wanted = wanted.unionAll(t)
    met = wanted.join(by_name(names.withColumn("priority", F.lit(0))).drop("priority"), "name").withColumnRenamed("tier", "priority")
    joined = refs.select("ref").distinct().join(best_targets(met), "ref", "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return joined.select(F.col("ref").cast("string").alias("ref"), F.when(F.col("n") == 1, F.col("target")).alias("target"), status.alias("status"))


def reserved(path: Column, names: list[str], generated: str) -> Column:
    """Whether a path has a reserved component, or starts with the folder of generated files."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names))) | (path == generated) | F.startswith(path, F.lit(generated + "/"))


def _overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of ``left`` that are, hold, or lie under a path of ``right``; equi-joins on exploded ancestors."""
    def uppers(df: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        return df.select("path", F.explode(every).alias("upper"))

    under = uppers(left).join(right.select(F.col("path").alias("upper")).distinct(), "upper", "left_semi").select("path")
    over = left.join(uppers(right).select(F.col("upper").alias("path")).distinct(), "path", "left_semi").select("path")
    return under.unionAll(over).distinct()


def asset_violations(assets: DataFrame, taken: DataFrame) -> DataFrame:
    """(code, path): public assets that overlap pages, their siblings, redirects or reserved names, or each other."""
    clash = _overlaps(assets.select("path"), taken.select("path")).select(F.lit("occupied").alias("code"), "path")
    twice = assets.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("code"), "path")
    return clash.unionAll(twice)


def url_map_violations(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(code, key) for a URL map (section, key, destination): unknown keys, shared destinations, bad destinations."""
    fine = F.regexp_like("destination", F.lit(r"^(?:https?://[^\s\\?#]+|/[^\s\\?#]*)$"))
    shared = entries.groupBy("destination").agg(F.count("*").alias("n")).where("n > 1").select("destination")
    return (
        entries.join(known, ["section", "key"], "left_anti").select(F.lit("unknown-key").alias("code"), "key")
        .unionAll(entries.join(shared, "destination", "left_semi").select(F.lit("shared-destination").alias("code"), "key"))
        .unionAll(entries.where(~fine).select(F.lit("bad-destination").alias("code"), "key"))
    )


def sidebar_violations(links: DataFrame, pages: DataFrame, max_depth: int = 6) -> DataFrame:
    """(code, text, target) of sidebar links (text, target, depth) without text, too deep, or to no visible page."""
    visible = pages.where("visible").select(F.col("route").alias("target"))
    return (
        links.where(F.trim("text") == "").select(F.lit("empty-text").alias("code"), "text", "target")
        .unionAll(links.where(F.col("depth") > max_depth).select(F.lit("too-deep").alias("code"), "text", "target"))
        .unionAll(links.where("target is not null").join(visible, "target", "left_anti").select(F.lit("missing-page").alias("code"), "text", "target"))
    )


def fragment_alias_violations(aliases: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(route, alias, n): declared aliases that are not the identifier of exactly one element of their page."""
    counts = identifiers.groupBy("route", F.col("identifier").alias("alias")).agg(F.count("*").alias("n"))
    return aliases.join(counts, ["route", "alias"], "left").select("route", "alias", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def sidebar_for(routes: DataFrame, sections: DataFrame) -> DataFrame:
    """Each route with the sidebar (prefix) of the longest prefix it lies under."""
    from .resolve import longest_prefix

    return longest_prefix(routes.select(F.col("route").alias("path")), sections.select(F.col("prefix").alias("root"))).select(
        F.col("path").alias("route"), F.col("root").alias("prefix")
    )
