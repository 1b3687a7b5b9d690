"""Reference resolution: joins in which ambiguity is an outcome, never a fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_names(items: DataFrame) -> DataFrame:
    """(package, name, item, exact): every spelling of an item. ``items`` has package, item, qualified_name, aliases,
    and ``secondary`` for overloads and methods, which only their id finds.

    With a column ``ecosystem`` Julia's items are also found by the last part of a dotted name, Rust's without their
    crate and by a ``public_path``, if there is such a column.
    """
    own = items.select("package", F.col("item").alias("name"), "item", F.lit(True).alias("exact"))
    spelled = F.concat(F.array("qualified_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    if "ecosystem" in items.columns:
        paths = F.array_compact(F.concat(spelled, F.array("public_path"))) if "public_path" in items.columns else spelled
        last = F.transform(spelled, lambda n: F.element_at(F.split(n, "[.]"), -1))
        inner = F.transform(F.filter(paths, lambda n: F.contains(n, F.lit("::"))), lambda n: F.regexp_replace(n, "^.*?::", ""))
        spelled = F.when(F.col("ecosystem") == "julia", F.concat(spelled, last)).when(F.col("ecosystem") == "rust", F.concat(paths, inner)).otherwise(spelled)
    spelled = F.array_distinct(spelled)
    named = items.where(~F.col("secondary")).select("package", F.explode(spelled).alias("name"), "item", F.lit(False).alias("exact"))
    return own.unionAll(named.where("name is not null"))


def _in_package(names: DataFrame) -> DataFrame:
    """For each (package, name) the one item, or null if several have it; an id hides other spellings."""
    exact = F.max(F.when(F.col("exact"), F.col("item")))
    others = F.count_distinct(F.when(~F.col("exact"), F.col("item")))
    only = F.when(exact.isNotNull(), exact).when(others == 1, F.max(F.when(~F.col("exact"), F.col("item"))))
    return names.groupBy("package", "name").agg(only.alias("item"))


def resolve_items(refs: DataFrame, items: DataFrame) -> DataFrame:
    """Resolve ``refs`` (ref, owner, target) in three tiers: explicit ``package::name``, the owner, the whole workspace.

    Adds ``package``, ``item`` and ``status``: resolved, ambiguous or unresolved. A tier that finds the name in any way
    ends the search; in the last one, several packages with the name are ambiguous. With a column ``ecosystem``, an
    explicit name that a Rust or C++ package does not know is looked up there as a whole, prefix included.
    """
    known = _in_package(lookup_names(items))
    packages = items.select("package").distinct()
    prefix = F.split_part("target", F.lit("::"), F.lit(1))
    explicit = (
        refs.where(F.contains("target", F.lit("::")) & ~F.regexp_like(prefix, F.lit(r"[({\[]")))
        .withColumn("package", prefix)
        .join(packages, "package", "left_semi")
        .select("ref", "package", F.expr("substring(target, instr(target, '::') + 2)").alias("name"), F.lit(0).alias("tier"))
    )
    if "ecosystem" in items.columns:
        known_names = known.select("package", "name").distinct()
        whole = items.where(F.col("ecosystem").isin("rust", "cpp")).select("package").distinct()
        lost = explicit.join(known_names, ["package", "name"], "left_anti").join(whole, "package", "left_semi")
        again = lost.join(refs.select("ref", F.col("target").alias("_whole")), "ref").select("ref", "package", F.col("_whole").alias("name"), "tier")
        explicit = explicit.join(lost.select("ref"), "ref", "left_anti").unionByName(again)
    owned = refs.where("owner is not null").select("ref", F.col("owner").alias("package"), F.col("target").alias("name"), F.lit(1).alias("tier"))
    # A name that a tier does not know at all leaves the search open, except for the explicit one.
    tried = explicit.unionAll(owned).join(known.withColumn("there", F.lit(True)), ["package", "name"], "left").where("tier = 0 or there")
    first = tried.groupBy("ref").agg(F.min_by(F.struct("package", "item", "there"), "tier").alias("hit"))
    # Explicitly qualified or found names never fall through to the workspace, which has one row for each name.
    wide = known.groupBy(F.col("name").alias("target")).agg(F.count("*").alias("n"), F.min(F.struct("package", "item")).alias("only"))
    out = refs.join(first, "ref", "left").join(wide, "target", "left")
    one = F.when(F.col("hit").isNotNull(), F.struct(F.col("hit.package"), F.col("hit.item"))).when(F.col("n") == 1, F.col("only"))
    ambiguous = (F.col("hit").isNotNull() & F.coalesce("hit.there", F.lit(False))) | (F.col("hit").isNull() & (F.col("n") >= 1))
    return out.select(
        *refs.columns,
        F.when(one["item"].isNotNull(), one["package"]).alias("package"),
        one["item"].alias("item"),
        F.when(one["item"].isNotNull(), "resolved").when(ambiguous, "ambiguous").otherwise("unresolved").alias("status"),
    )


def concept_members(members: DataFrame, items: DataFrame) -> DataFrame:
    """Members (concept, package, name) with the one ``item`` of their package that has the name, and ``problem``."""
    known = _in_package(lookup_names(items)).withColumn("_there", F.lit(True))
    met = members.join(known, ["package", "name"], "left")
    problem = F.when(F.col("item").isNotNull(), F.lit(None)).when(F.col("_there"), "ambiguous").otherwise("unresolved")
    return met.select("concept", "package", "name", "item", problem.alias("problem"))


def reconcile_modules(sources: DataFrame, exports: DataFrame) -> DataFrame:
    """(module, name, origin, facts, public, problem): declarations (module, name, origin, file, facts) of stubs and
    sources brought together.

    A module has at most one source and one stub; more are a problem of the module. A stub is taken before a source.
    ``exports`` (module, name) of a runtime decide alone what is public where they name the module; else names that do
    not begin with an underscore are. An exported name without a declaration is a row without an origin.
    """
    files = sources.groupBy("module", "origin").agg(F.count_distinct("file").alias("_n")).where("_n > 1").groupBy("module").agg(F.lit("several-files").alias("problem"))
    rank = F.when(F.col("origin") == "stub", 0).otherwise(1)
    best = sources.groupBy("module", "name").agg(F.min_by(F.struct("origin", "facts"), rank).alias("_d"))
    ran = exports.select("module").distinct().withColumn("_ran", F.lit(True))
    rows = best.join(exports.distinct().withColumn("_exported", F.lit(True)), ["module", "name"], "full_outer").join(ran, "module", "left").join(files, "module", "left")
    public = F.when(F.col("_ran"), F.coalesce("_exported", F.lit(False))).otherwise(~F.startswith("name", F.lit("_")))
    return rows.select("module", "name", "_d.origin", "_d.facts", public.alias("public"), "problem")


def reconcile_help(exports: DataFrame, help_topics: DataFrame, sources: DataFrame) -> DataFrame:
    """(package, name, topic, source, status) of what a runtime exports, help describes and source files define.

    ``exports`` is (package, name), ``help_topics`` (package, name, topic), ``sources`` (package, name, source). Several
    topics of a name are a conflict; a name that is exported without help is undocumented, one with help that is not
    exported is internal, one that only a source has is private.
    """
    topics = help_topics.groupBy("package", "name").agg(F.count_distinct("topic").alias("_n"), F.min("topic").alias("topic"))
    places = sources.groupBy("package", "name").agg(F.min("source").alias("source"))
    rows = exports.distinct().withColumn("_out", F.lit(True)).join(topics, ["package", "name"], "full_outer").join(places, ["package", "name"], "full_outer")
    status = (
        F.when(F.col("_n") > 1, "conflict").when(F.col("_out") & F.col("topic").isNotNull(), "documented").when(F.col("_out"), "undocumented")
        .when(F.col("topic").isNotNull(), "internal").otherwise("private")
    )
    return rows.select("package", "name", F.when(F.col("_n") == 1, F.col("topic")).alias("topic"), "source", status.alias("status"))


def reconcile_methods(runtime: DataFrame, sources: DataFrame) -> DataFrame:
    """(function, signature, file, line, origin): method tables of a runtime matched with parsed definitions.

    Methods match by function and signature; of several definitions the last in (file, line) stands, as it replaced the
    others. A method without a definition keeps no place; definitions that no table has are ``source`` alone.
    """
    last = sources.groupBy("function", "signature").agg(F.max(F.struct("file", "line")).alias("_s"))
    rows = runtime.select("function", "signature").distinct().withColumn("_ran", F.lit(True)).join(last, ["function", "signature"], "full_outer")
    origin = F.when(F.col("_ran") & F.col("_s").isNotNull(), "both").when(F.col("_ran"), "runtime").otherwise("source")
    return rows.select("function", "signature", "_s.file", "_s.line", origin.alias("origin"))


def best_targets(met: DataFrame) -> DataFrame:
    """(ref, n, target) of (ref, priority, low, high): the least and the greatest target of the best priority tell
    whether it is one (``n`` 1) or several (2). Such rows combine before they are shuffled."""
    best = met.groupBy("ref", "priority").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy("ref").agg(F.min_by(F.struct("low", "high"), "priority").alias("_b"))
    return best.select("ref", F.when(F.col("_b.low") == F.col("_b.high"), 1).otherwise(2).alias("n"), F.col("_b.low").alias("target"))


def by_name(candidates: DataFrame) -> DataFrame:
    """(name, priority, low, high): one row for each name, of the best priority of its candidates (name, target, priority)."""
    tiers = candidates.where("target is not null").groupBy("name", "priority").agg(F.min("target").alias("low"), F.max("target").alias("high"))
    return tiers.groupBy("name").agg(F.min_by(F.struct("priority", "low", "high"), "priority").alias("_b")).select("name", "_b.*")


def resolve_prioritised(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each ``ref`` the candidates (ref-side key ``name``, value ``target``, ``priority``) of the best priority only.

    One target there is the answer, several are ambiguous, none at all is unresolved. Candidates become one row for each
    name before references meet them, so a frequent name costs references plus candidates, not their product.
    """
    joined = refs.select("ref").distinct().join(best_targets(refs.join(by_name(candidates), "name").select("ref", "priority", "low", "high")), "ref", "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return joined.select("ref", F.when(F.col("n") == 1, F.col("target")).alias("target"), status.alias("status"))


def unique_match(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with ``value`` where exactly one row of ``right`` has its key, else null."""
    single = right.groupBy(key).agg(F.count("*").alias("_n"), F.max(value).alias(value)).where("_n = 1").drop("_n")
    return left.join(single, key, "left")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path with the ``root`` of most components that it lies under (null if none): an equi-join on exploded
    prefixes, so no pair of path and root that does not match is ever made."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = paths.select("path", F.posexplode(prefixes).alias("depth", "root"))
    best = tried.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", "depth").alias("root"))
    return paths.join(best, "path", "left")


def dangling_anchors(refs: DataFrame, anchors: DataFrame) -> DataFrame:
    return refs.where("anchor is not null").join(anchors, ["doc", "anchor"], "left_anti")


def range_lookup(points: DataFrame, ranges: DataFrame, cell: int = 1024) -> DataFrame:
    """Points (doc, pos) with the range (doc, start, stop, source) that holds them, ``start <= pos < stop``.

    A point in no range takes the last range that ends at it. Ranges are dealt to cells of ``cell`` positions, so the
    join is one of equal keys however long a document is.
    """
    cells = F.sequence(F.floor(F.col("start") / cell), F.floor(F.greatest(F.col("stop"), F.col("start")) / cell))
    dealt = ranges.select("doc", "start", "stop", "source", F.explode(cells).alias("_cell"))
    met = points.withColumn("_cell", F.floor(F.col("pos") / cell)).join(dealt, ["doc", "_cell"])
    inside = (F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("stop"))
    met = met.where(inside | (F.col("stop") == F.col("pos")))
    best = met.groupBy("doc", "pos").agg(F.max_by("source", F.struct(inside.alias("in"), F.col("start"))).alias("source"))
    return points.join(best, ["doc", "pos"], "left")


def dependencies(packages: DataFrame, needs: DataFrame) -> DataFrame:
    """(package, dependency): packages of the same ecosystem whose normalised name another one needs."""
    def normal(col):
        return F.regexp_replace(F.lower(col), "[-_.]+", "-")

    named = packages.select(F.col("package").alias("dependency"), "ecosystem", normal(F.col("name")).alias("key"))
    wanted = needs.join(packages.select("package", "ecosystem"), "package").select("package", "ecosystem", normal(F.col("needs")).alias("key"))
    return wanted.join(named, ["ecosystem", "key"]).where("package <> dependency").select("package", "dependency").distinct()


def merge_by_rank(rows: DataFrame, keys: list[str], rank: str, facts: list[str], unions: list[str]) -> DataFrame:
    """Reconcile rows of several sources: facts from the best rank that has them, arrays united in rank order."""

    def united(c: str):
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(rank, c))), lambda x: x[c]))).alias(c)

    lists = [united(c) for c in unions]
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(rank))).alias(c) for c in facts]
    return rows.groupBy(*keys).agg(*firsts, *lists)
