"""The site model: routes, canonical URLs, metadata, search entries, sitemap, redirects, navigation and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_route, html_escape

#: Limits of the published files.
MAX_URLS, MAX_SITEMAP_BYTES, MAX_URL = 50_000, 52_428_800, 2_048
MAX_REDIRECTS, MAX_REDIRECT = 2_000, 1_000


def routes(pages: DataFrame) -> DataFrame:
    """``route`` of authored pages (root, mount, stem); empty parts are left out."""
    part = [F.when(F.col(c) != "", F.col(c)) for c in ("root", "mount", "stem")]
    return pages.withColumn("route", F.concat(F.concat_ws("/", *part), F.lit(".html")))


def identity_routes(rows: DataFrame) -> DataFrame:
    """(kind, root, id, route): pages and items without a place of their own stand under the digest of their id."""
    file = F.concat(F.sha2("id", 256), F.lit(".html"))
    return rows.select("kind", "root", "id", F.when(F.col("kind") == "page", F.concat(F.lit("pages/"), file)).otherwise(F.concat("root", F.lit("/reference/"), file)).alias("route"))


def canonical_urls(pages: DataFrame, base: str, clean: bool = True) -> DataFrame:
    path = clean_route(F.col("route")) if clean else F.col("route")
    return pages.withColumn("url", F.concat(F.lit(base.rstrip("/") + "/"), path))


def page_metadata(pages: DataFrame, overrides: DataFrame, site: str, description: str) -> DataFrame:
    """Title and description of each page: an override, else the page's title with the site's, else the default."""
    o = overrides.select("route", F.col("title").alias("_t"), F.col("description").alias("_d"))
    joined = F.when(F.col("title") == site, F.col("title")).otherwise(F.concat("title", F.lit(f" · {site}")))
    return pages.join(o, "route", "left").select(
        "route", F.coalesce("_t", joined).alias("full_title"), F.coalesce("_d", F.lit(description)).alias("description")
    )


def search_entries(pages: DataFrame, blocks: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each visible page, with the text of its blocks in order, and one for each API member."""
    texts = blocks.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), " ").alias("text"))
    shown = pages.where("visible").join(texts, "route", "left").select("title", F.col("route").alias("path"), "package", F.lit(False).alias("api"), F.coalesce("text", F.lit("")).alias("text"))
    return shown.unionByName(members.select("title", "path", "package", F.lit(True).alias("api"), "text"))


def canonical_violations(pages: DataFrame) -> DataFrame:
    """(url, routes): canonical URLs of several pages."""
    return pages.groupBy("url").agg(F.array_sort(F.collect_list("route")).alias("routes")).where(F.size("routes") > 1)


def sitemap(urls: DataFrame) -> DataFrame:
    """The entries of a sitemap, distinct and sorted, with ``ok``: each URL within the limit of length."""
    row = F.concat(F.lit("<url><loc>"), html_escape(F.col("url")), F.lit("</loc></url>"))
    return urls.select("url").distinct().withColumn("entry", row).withColumn("ok", F.octet_length("url") < MAX_URL)


def sitemap_violations(urls: DataFrame) -> DataFrame:
    """(code, n) for each limit that a sitemap would break."""
    s = sitemap(urls).agg(F.count("*").alias("urls"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0)).alias("bytes"), F.count_if(~F.col("ok")).alias("long"))
    codes = F.array(
        F.when(F.col("urls") > MAX_URLS, F.struct(F.lit("too-many-urls").alias("code"), F.col("urls").alias("n"))),
        F.when(F.col("bytes") > MAX_SITEMAP_BYTES, F.struct(F.lit("too-many-bytes").alias("code"), F.col("bytes").alias("n"))),
        F.when(F.col("long") > 0, F.struct(F.lit("url-too-long").alias("code"), F.col("long").alias("n"))),
    )
    return s.select(F.inline(F.array_compact(codes)))


def redirect_violations(redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """(code, source): redirects to no visible page, from an occupied route, repeated, or over the limits."""
    visible = pages.where("visible").select(F.col("route").alias("target"))
    taken = pages.select(F.col("route").alias("source"))

    def found(rows, code):
        return rows.select(F.lit(code).alias("code"), "source")

    line = F.char_length("source") + F.char_length("target") + 5
    parts = [
        found(redirects.join(visible, "target", "left_anti"), "missing-target"),
        found(redirects.join(taken, "source", "left_semi"), "occupied-source"),
        found(redirects.groupBy("source").count().where("count > 1"), "repeated-source"),
        found(redirects.where(line > MAX_REDIRECT), "rule-too-long"),
        found(redirects.agg(F.count("*").alias("n")).where(f"n > {MAX_REDIRECTS}").withColumn("source", F.lit("")), "too-many-rules"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def topic_routes(topics: DataFrame) -> DataFrame:
    """Topics (id, stem) with ``file``: every odd character is a hyphen, none stand at the ends (nor do dots), and a stem
    that is empty (then ``topic``), ``index`` or not unique gets the digest of the id."""
    stem = F.regexp_replace(F.regexp_replace("stem", "[^A-Za-z0-9_.-]", "-"), "^[-.]+|[-.]+$", "")
    rows = topics.withColumn("_s", stem)
    many = rows.groupBy("_s").agg(F.count("*").alias("_n"))
    plain = (F.col("_n") == 1) & ~F.col("_s").isin("", "index")
    marked = F.concat(F.when(F.col("_s") == "", F.lit("topic")).otherwise(F.col("_s")), F.lit("-"), F.sha2("id", 256))
    return rows.join(many, "_s").select("id", "stem", F.when(plain, F.col("_s")).otherwise(marked).alias("file"))


def topic_index(items: DataFrame) -> DataFrame:
    """(package, item, name, position): discoverable items that are their help topic's primary, by name."""
    from pyspark.sql import Window

    shown = items.where(F.col("discoverable") & (F.col("primary").isNull() | (F.col("primary") == F.col("item"))))
    w = Window.partitionBy("package").orderBy("name", "item")
    return shown.select("package", "item", "name", (F.row_number().over(w) - 1).alias("position"))


def robots(base: str, sitemap_path: str = "sitemap.xml") -> str:
    """The lines that let crawlers in and name the sitemap."""
    return f"User-agent: *\nAllow: /\n\nSitemap: {base.rstrip('/')}/{sitemap_path}\n"


def redirect_lines(redirects: DataFrame, base: str = "/") -> DataFrame:
    """(source, line): a rule for each redirect; ``redirect_violations`` has the limits."""
    root = base.rstrip("/")
    return redirects.select("source", F.concat(F.lit(f"{root}/"), "source", F.lit(f" {root}/"), "target", F.lit(" 301")).alias("line"))


def search_lines(entries: DataFrame) -> DataFrame:
    """(path, line): a JSON object for each search entry, its keys in a fixed order."""
    return entries.select("path", F.to_json(F.struct("title", "path", "package", "ecosystem", "api", "text"), {"ignoreNullFields": "false"}).alias("line"))


def fragment_index(pages: DataFrame, packages: DataFrame, headings: DataFrame, identities: DataFrame, url_map: DataFrame | None = None) -> DataFrame:
    """(path, document): for each page the JSON of its index entry.

    ``pages`` is (route, url, title, package, qualified_name, public_name, visible), ``packages`` (package, version),
    ``headings`` (route, ord, level, anchor, text), ``identities`` (route, identity). A URL map replaces the URL.
    """
    heads = F.transform(F.array_sort(F.collect_list(F.struct("ord", "level", "anchor", "text"))), lambda h: F.struct(h["level"], h["anchor"], h["text"]))
    listed = headings.groupBy("route").agg(heads.alias("headings"))
    whose = identities.groupBy("route").agg(F.array_sort(F.collect_set("identity")).alias("identities"))
    rows = pages.join(packages.select("package", F.col("version").alias("package_version")), "package", "left")
    rows = rows.join(listed, "route", "left").join(whose, "route", "left")
    if url_map is not None:
        mapped = url_map.where("section = 'documents'").select(F.col("key").alias("route"), F.col("destination").alias("_url"))
        rows = rows.join(mapped, "route", "left").withColumn("url", F.coalesce("_url", "url"))
    entry = F.struct(
        F.col("route").alias("path"), F.concat(F.regexp_replace("route", "\\.html$", ""), F.lit(".md")).alias("markdown_path"), "url", "title", "package",
        "package_version", "qualified_name", "public_name", "visible", F.coalesce("identities", F.array().cast("array<string>")).alias("identities"), "headings",
    )
    return rows.select(F.col("route").alias("path"), F.to_json(entry, {"ignoreNullFields": "false"}).alias("document"))


def fragment_targets(aliases: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(route, alias, target): old fragments that are to lead to a present one: the target occurs, the alias does not."""
    have = identifiers.select("route", F.col("identifier").alias("target")).distinct()
    taken = identifiers.select("route", F.col("identifier").alias("alias")).distinct()
    return aliases.join(have, ["route", "target"], "left_semi").join(taken, ["route", "alias"], "left_anti").select("route", "alias", "target")


def concept_links(concepts: DataFrame, routes: DataFrame, block: int = 1_000) -> DataFrame:
    """(route, concept, target, label): from each page of a concept's member to the pages of its others.

    ``concepts`` is (concept, kind, package, item), ``routes`` (package, item, route, package_name, name). The links of a
    concept are as many as its pages times its members; its pages are dealt in blocks, each with a copy of the members, so
    that a large concept is the work of many tasks. Their number is given, since the rows before the join are too few to
    tell how many come out.
    """
    placed = concepts.join(routes, ["package", "item"])
    label = F.when(F.col("kind") == "equivalent", "Same API in").otherwise("Related API")
    ends = placed.select("concept", F.col("route").alias("target"), F.concat_ws(": ", "package_name", "name").alias("text"), label.alias("label"))
    pages = placed.select("concept", "route").distinct()
    sizes = pages.groupBy("concept").agg(F.ceil(F.count("*") / block).alias("_n"))
    dealt = pages.join(sizes, "concept").withColumn("_b", F.pmod(F.xxhash64("route"), "_n")).drop("_n")
    copies = ends.join(sizes, "concept").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    tasks = int(concepts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, copies = (rows.repartition(tasks, "concept", "_b") for rows in (dealt, copies))
    return dealt.join(copies, ["concept", "_b"]).where("route <> target").select("route", "concept", "target", "text", "label")


def social_metadata(pages: DataFrame, site: str, image_url: str, image_type: str, width: int, height: int, alt: str) -> DataFrame:
    """(route, ord, property, content) of the cards of pages (route, title, url, description)."""
    fixed = {
        "og:type": F.lit("website"), "og:title": F.col("title"), "og:site_name": F.lit(site), "og:url": F.col("url"), "og:image": F.lit(image_url), "og:image:type": F.lit(image_type),
        "og:image:width": F.lit(str(width)), "og:image:height": F.lit(str(height)), "og:image:alt": F.lit(alt), "og:description": F.col("description"),
    }
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("property"), v.alias("content")) for i, (k, v) in enumerate(fixed.items())])
    return pages.select("route", F.inline(cells)).where("content is not null")


#: How languages are written for readers.
LANGUAGE_NAMES = {"r": "R", "python": "Python", "julia": "Julia", "rust": "Rust", "cpp": "C++"}


def package_overview(packages: DataFrame) -> DataFrame:
    """(package, fields, search_text) from (package, name, ecosystem, version, license, description, authors).

    The panel has the name, the language, and what else is known, in that order; the text for the search has the values
    and the description and authors.
    """
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    language = F.coalesce(F.try_element_at(names, F.col("ecosystem")), F.col("ecosystem"))
    cells = [("Package", F.col("name")), ("Language", language), ("Version", F.col("version")), ("License", F.col("license"))]
    fields = F.filter(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in cells]), lambda c: c["value"].isNotNull())
    text = F.concat_ws("\n", F.transform(fields, lambda c: c["value"]), "description", "authors")
    return packages.select("package", fields.alias("fields"), text.alias("search_text"))


def output_overlaps(outputs: DataFrame, inputs: DataFrame, caches: DataFrame) -> DataFrame:
    """(output, path): inputs at or under an output, and caches at, under or above one. Joins on exploded ancestors."""

    def with_uppers(df: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        return df.select("path", F.explode(every).alias("upper"))

    named = outputs.select(F.col("path").alias("output"))
    under = with_uppers(inputs.select("path").unionAll(caches.select("path"))).join(named.withColumn("upper", F.col("output")), "upper").select("output", "path")
    above = with_uppers(outputs.select("path")).select(F.col("path").alias("output"), "upper").join(caches.select(F.col("path").alias("upper")), "upper").select("output", F.col("upper").alias("path"))
    return under.unionAll(above).distinct()


def publish_files(files: DataFrame, path: str, base="latest"):
    """Publish a tree of files (path, bytes) as a version of its own and make it the present one by a commit.

    ``base`` is the commit that the tree was made from; if there is a later one, ``Conflict`` is raised. A folder that
    holds something else than published trees is refused. Returns the commit.
    """
    from ..sources.commits import CommitLog

    spark = files.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(folder) and len(list(system.listStatus(folder))) and not system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_log")):
        raise ValueError(f"{path} holds files that were not published here")
    twice = files.groupBy("path").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several files for {[r.path for r in twice]}")
    log = CommitLog(spark, path)
    base = log.latest() if base == "latest" else base
    version, at = log.data_path()
    try:
        files.select("path", "bytes").write.parquet(at)
        return log.commit(base, version, ["*"], ["*"])
    except BaseException:
        log.remove(version)
        raise


def published_files(spark, path: str) -> DataFrame:
    from ..sources.commits import CommitLog

    return spark.read.parquet(f"{path}/{CommitLog(spark, path).latest().data}")


def visible_pages(pages: DataFrame, packages: DataFrame) -> DataFrame:
    """Pages with ``visible``: those of a hidden package are not."""
    hidden = packages.where("visibility = 'hidden'").select(F.col("package").alias("owner"), F.lit(True).alias("_hidden"))
    return pages.join(hidden, "owner", "left").withColumn("visible", F.col("_hidden").isNull()).drop("_hidden")


def package_order(packages: DataFrame, languages: list[str]) -> DataFrame:
    """Packages with ``position``: by the rank of their language, then name, then id."""
    from .graphs import numbered

    rank = F.array_position(F.array(*map(F.lit, languages)), F.col("language"))
    return numbered(packages.withColumn("rank", F.when(rank > 0, rank).otherwise(len(languages) + 1).cast("int")), "rank", "name", "id")
