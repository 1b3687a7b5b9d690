"""References between records as anti-joins, and rules on record contents: an empty result is a sound table.

Every rule is one narrow projection of the contents and at most one join on keys; the results are united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import field


def _found(rows: DataFrame, code: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), "kind", "owner", "id")


def _missing(rows: DataFrame, target: DataFrame, keys: list[str], code: str) -> DataFrame:
    return _found(rows.join(target, keys, "left_anti"), code)


def reference_violations(records: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(code, kind, owner, id) of records whose content names something that is not there, or breaks a rule of its kind."""

    def of(kind: str, **columns: Column) -> DataFrame:
        return records.where(F.col("kind") == kind).select("kind", "owner", "id", *[c.alias(n) for n, c in columns.items()])

    def listed(kind: str, path: str, schema: str) -> DataFrame:
        return records.where(F.col("kind") == kind).select("kind", "owner", "id", F.inline(F.from_json(field(path), f"array<struct<{schema}>>")))

    packages = records.where("kind = 'package'").select(F.col("id").alias("_package"))
    repositories = records.where("kind = 'repository'").select(F.col("id").alias("_repository"))
    items = records.where("kind = 'item'").select(F.col("owner").alias("_package"), F.col("id").alias("_item"))
    collections = of("collection", _owner=F.struct(field("$.owner.kind"), field("$.owner.package")))
    pages = of("page", _as=field("$.kind.kind"), _owner=F.struct(field("$.owner.kind"), field("$.owner.package")), _collection=field("$.kind.collection"),
               _concept=field("$.kind.concept"), _package=field("$.kind.item.package"), _item=field("$.kind.item.item"), _role=field("$.kind.role"))
    parts = []
    # Owners and repositories.
    for kind in ("page", "collection"):
        owned = of(kind, _kind=field("$.owner.kind"), _package=field("$.owner.package")).where("_kind = 'package'")
        parts.append(_missing(owned, packages, ["_package"], "missing-owner"))
    parts.append(_missing(of("collection", _repository=field("$.repository")), repositories, ["_repository"], "missing-repository"))
    located = of("item", _repository=field("$.source_location.repository")).where("_repository is not null")
    parts.append(_missing(located, repositories, ["_repository"], "missing-source-repository"))
    # What a page stands for.
    kept = collections.select(F.col("id").alias("_collection"), F.col("_owner"))
    parts.append(_missing(pages.where("_as = 'authored'"), kept, ["_collection", "_owner"], "page-collection"))
    parts.append(_missing(pages.where("_as = 'api'"), items, ["_package", "_item"], "page-item"))
    concepts = records.where("kind = 'concept'").select(F.col("id").alias("_concept"))
    parts.append(_missing(pages.where("_as = 'concept'"), concepts, ["_concept"], "page-concept"))
    documented = pages.where("_as = 'package-documentation'")
    parts.append(_found(documented.where(F.col("_owner")["col1"] != "package"), "documentation-owner"))
    roles = documented.groupBy("_owner", "_role").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    parts.append(_found(documented.join(roles, ["_owner", "_role"], "left_semi"), "repeated-role"))
    # Groups, relationships, executions.
    members = listed("concept", "$.members", "package:string,item:string").withColumnsRenamed({"package": "_package", "item": "_item"})
    parts.append(_missing(members, items, ["_package", "_item"], "concept-member").distinct())
    end = "struct<kind:string,package:string>"
    ends = listed("workspace", "$.relationships", f"`from`:{end},`to`:{end}").select("kind", "owner", "id", F.explode(F.array("from", "to")).alias("e"))
    inside = ends.where("e.kind = 'workspace'").withColumn("_package", F.col("e.package"))
    parts.append(_missing(inside, packages, ["_package"], "relationship-end").distinct())
    page_ids = records.where("kind = 'page'").select("id")
    parts.append(_missing(of("execution"), page_ids, ["id"], "execution-page"))
    # A finished snapshot has no errors among its diagnostics.
    parts.append(_found(listed("workspace", "$.diagnostics", "severity:string").where("severity = 'error'"), "error-diagnostic").distinct())
    # Documents: one for each page, and for each item and concept with documentation; none besides.
    wanted = pages.select(F.lit("page").alias("_k"), F.lit("").alias("_a"), F.col("id").alias("_b"), "kind", "owner", "id")
    for kind in ("item", "concept"):
        with_text = records.where((F.col("kind") == kind) & field("$.documentation").isNotNull())
        wanted = wanted.unionAll(with_text.select(F.lit(kind).alias("_k"), F.col("owner").alias("_a"), F.col("id").alias("_b"), "kind", "owner", "id"))
    what = field("$.kind", F.col("id"))
    have = records.where("kind = 'document'").select(
        what.alias("_k"), F.coalesce(field("$.item.package", F.col("id")), F.lit("")).alias("_a"),
        F.coalesce(field("$.item.item", F.col("id")), field("$.page", F.col("id")), field("$.concept", F.col("id"))).alias("_b"), "kind", "owner", "id",
    )
    parts.append(_missing(wanted, have.select("_k", "_a", "_b"), ["_k", "_a", "_b"], "document-missing"))
    parts.append(_missing(have, wanted.select("_k", "_a", "_b"), ["_k", "_a", "_b"], "document-of-nothing"))
    if assets is not None:
        # Bytes that a record names by digest have to be there.
        named = listed("presentation", "$.public_assets", "publish:string,digest:string")
        parts.append(_missing(named, assets.select("digest").distinct(), ["digest"], "missing-asset").distinct())
    return reduce(DataFrame.unionAll, parts)


def closed_keys(records: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """(kind, owner, id, key): top-level keys of contents that their kind does not have. Record schemas are closed."""
    pairs = [F.lit(x) for kind, keys in known.items() for x in (kind, "\0".join(keys))]
    allowed = F.split(F.element_at(F.create_map(*pairs), F.col("kind")), "\0")
    odd = F.array_except(F.json_object_keys("content"), allowed)
    return records.where(F.col("kind").isin(list(known))).select("kind", "owner", "id", F.explode(odd).alias("key"))


def language_violations(items: DataFrame) -> DataFrame:
    """(code, package, item) of items (package, item, ecosystem, role, parent, family, exported, primary) that break the
    rules of their language's tables.

    An overload, a method and a field belong to an item of the same package; an overload's family is no overload itself;
    a help topic names a primary item, whose own primary it is; an item of one language is not in a package of another.
    """
    keys = items.select("package", F.col("item").alias("_target"), F.col("role").alias("_role"), F.col("primary").alias("_primary"))
    held = items.join(keys, (items["package"] == keys["package"]) & (items["family"] == keys["_target"]), "left").select(items["*"], "_role", F.col("_target").alias("_family"))
    above = items.select("package", F.col("item").alias("parent"), F.lit(True).alias("_there"))
    topics = items.select("package", F.col("item").alias("primary"), F.col("primary").alias("_own"))

    def found(rows: DataFrame, code: str) -> DataFrame:
        return rows.select(F.lit(code).alias("code"), "package", "item")

    needs = F.col("role").isin("overload", "method")
    parts = [
        found(held.where(needs & F.col("_family").isNull()), "family-missing"),
        found(held.where(needs & (F.col("_role") == F.col("role"))), "family-is-member"),
        found(items.where("role = 'field'").join(above, ["package", "parent"], "left_anti"), "field-without-type"),
        found(items.where("primary is not null").join(topics, ["package", "primary"], "left_anti"), "topic-missing"),
        found(items.where("primary is not null").join(topics, ["package", "primary"]).where("not (_own <=> primary)"), "topic-not-primary"),
        found(items.where(~F.col("language").eqNullSafe(F.col("ecosystem"))), "language-mismatch"),
    ]
    return reduce(DataFrame.unionAll, parts)


def execution_violations(settings: DataFrame) -> DataFrame:
    """(code, doc, key) of metadata (doc, mode, key, value) by which a document would grant itself execution.

    Documents may veto, never grant: ``execute`` may be ``false`` anywhere, ``true`` only where its collection executes;
    selectors of an engine or kernel are the collection's alone; merge keys hide what they set and are refused.
    """
    grants = (F.col("key") == "execute") & (F.col("value") == "true") & (F.col("mode") != "execute")
    selectors = F.col("key").isin("jupyter", "engine", "kernel", "execution", "execute.mode", "execute.engine", "execute.kernel") & (F.col("mode") != "execute")
    code = (
        F.when(F.endswith("key", F.lit("<<")), "merge-key").when(grants | selectors, "not-authorized")
        .when((F.col("key") == "execute") & ~F.col("value").isin("true", "false"), "not-a-flag")
    )
    return settings.select(code.alias("code"), "doc", "key").where("code is not null")
