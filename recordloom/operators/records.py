"""The record table (kind, owner, id, content, fingerprint), its queries, writer and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, domain_digest, record_fingerprint

#: Kinds whose owner is empty, and kinds that belong to a package.
TOP_KINDS = ["workspace", "presentation", "repository", "package", "collection", "page", "concept", "document", "execution"]
OWNED_KINDS = ["target", "item"]


def field(path: str, content: Column | None = None) -> Column:
    return F.get_json_object(F.col("content") if content is None else content, path)


def with_fingerprints(records: DataFrame, **options) -> DataFrame:
    return records.withColumn("fingerprint", record_fingerprint(F.col("kind"), F.col("owner"), F.col("id"), F.col("content"), **options))


def package_metadata(records: DataFrame) -> DataFrame:
    return records.where("kind = 'package'").select("id", field("$.name").alias("name"), field("$.version").alias("version"))


#: Where each ecosystem's metadata has what all of them have in common.
COMMON_FIELDS = {
    "r": {"name": "$.description.name", "version": "$.description.version", "description": "$.description.description", "title": "$.description.title", "license": "$.description.license"},
    "julia": {"name": "$.name", "version": "$.version", "description": "$.fields.description.value", "license": "$.fields.license.value"},
    "cpp": {"name": "$.name", "version": "$.version", "description": "$.description"},
    "python": {"name": "$.name", "version": "$.version", "description": "$.description", "license": "$.license"},
    "rust": {"name": "$.name", "version": "$.version", "description": "$.description", "license": "$.license"},
}


def common_metadata(packages: DataFrame) -> DataFrame:
    """(package, name, version, description, license) out of (package, ecosystem, metadata), whose JSON differs by
    ecosystem; an R package without a description is described by its title."""

    def common(name: str) -> Column:
        cases = [F.when(F.col("ecosystem") == e, F.get_json_object("metadata", paths[name])) for e, paths in COMMON_FIELDS.items() if name in paths]
        return F.coalesce(*cases)

    return packages.select("package", common("name").alias("name"), common("version").alias("version"), F.coalesce(common("description"), common("title")).alias("description"), common("license").alias("license"))


#: The tables of a snapshot, by which a database file is recognised.
SNAPSHOT_TABLES = ["assets", "manifest", "records"]


def generated_files(files: DataFrame) -> DataFrame:
    """(path, generated) of database files (path, application_id, tables): those that we wrote ourselves."""
    from ..sources.database import BUNDLE_ID, SNAPSHOT_ID

    ours = F.col("application_id").isin(SNAPSHOT_ID, BUNDLE_ID) & (F.array_sort("tables") == F.array(*map(F.lit, SNAPSHOT_TABLES)))
    return files.select("path", F.coalesce(ours, F.lit(False)).alias("generated"))


def lookup(records: DataFrame, kind: str, owner: str, id_: str) -> DataFrame:
    """Point lookup; the filters reach the scan."""
    return records.where((F.col("kind") == kind) & (F.col("owner") == owner) & (F.col("id") == id_)).select("content")


def item_documents(records: DataFrame) -> DataFrame:
    """Items with the references of their documents. JSON paths are read once, before the join."""
    items = records.where("kind = 'item'").select("owner", "id")
    docs = records.where((F.col("kind") == "document") & (F.col("owner") == "") & (field("$.document.kind") == "item")).select(
        field("$.document.item.package").alias("owner"), field("$.document.item.item").alias("id"), field("$.references").alias("references_json")
    )
    return items.join(docs, ["owner", "id"])


def documents(records: DataFrame) -> DataFrame:
    return records.where("kind = 'document'").select("id", field("$.references").alias("references_json"))


def decode(records: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """For each kind its records as columns (owner, id, and the fields of its schema). A content that does not fit gives
    nulls; ``decode_violations`` finds those."""
    return {k: records.where(F.col("kind") == k).select("owner", "id", F.from_json("content", s).alias("_c")).select("owner", "id", "_c.*") for k, s in schemas.items()}


def decode_violations(records: DataFrame, schemas: dict[str, str], required: dict[str, list[str]]) -> DataFrame:
    """(code, kind, owner, id) of contents that are no JSON objects, lack a required field, or have another type in one."""
    parts = []
    for kind, schema in schemas.items():
        rows = records.where(F.col("kind") == kind)
        whole = F.json_object_keys("content")
        parts.append(rows.where(whole.isNull()).select(F.lit("no-object").alias("code"), "kind", "owner", "id"))
        fields = rows.where(whole.isNotNull()).withColumn("_keys", whole).withColumn("_c", F.from_json("content", schema, {"mode": "PERMISSIVE"}))
        for name in required.get(kind, []):
            bad = F.when(~F.array_contains("_keys", name), "missing-field").when(F.col(f"_c.{name}").isNull(), "wrong-type")
            parts.append(fields.select(bad.alias("code"), "kind", "owner", "id").where("code is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def keyed_order(records: DataFrame) -> DataFrame:
    """Records with their ``position`` by kind, owner and id, byte by byte."""
    from .graphs import numbered

    return numbered(records, "kind", "owner", "id")


def asset_sizes(assets: DataFrame) -> DataFrame:
    return assets.select("digest", "media_type", F.octet_length("bytes").cast("bigint").alias("byte_size"))


def item_counts(records: DataFrame) -> DataFrame:
    """How many items each package has, none included."""
    items = records.where("kind = 'item'").groupBy("owner").agg(F.count("*").alias("n"))
    packages = records.where("kind = 'package'").select("id")
    return packages.join(items, F.col("id") == F.col("owner"), "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("items"))


def media_type_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("media_type").agg(F.count("*").alias("n"))


def manifest_is_single(manifest: DataFrame) -> DataFrame:
    return manifest.agg((F.count("*") == 1).alias("ok"))


def discoverable(items: DataFrame) -> DataFrame:
    """Items shown by themselves: a rule for each language over its projected fields."""
    python = ~F.col("visibility").eqNullSafe("private") & ~F.col("role").eqNullSafe("overload")
    julia = ~F.col("visibility").eqNullSafe("private") & ~F.col("role").eqNullSafe("field")
    rule = (
        F.when(F.col("language") == "cpp", F.col("family").isNull())
        .when(F.col("language") == "r", ~F.coalesce("internal", F.lit(False)))
        .when(F.col("language") == "python", python)
        .when(F.col("language") == "julia", julia)
        .otherwise(True)
    )
    return items.withColumn("discoverable", rule)


def record_violations(records: DataFrame) -> DataFrame:
    """(code, kind, owner, id) of every broken rule of the key contract; an empty result is a valid table."""

    def found(rows: DataFrame, code: str) -> DataFrame:
        return rows.select(F.lit(code).alias("code"), "kind", "owner", "id")

    packages = records.where("kind = 'package'").select(F.col("id").alias("owner"))
    owned = records.where(F.col("kind").isin(OWNED_KINDS))
    children = records.where("kind = 'item'").select(
        "kind", "owner", F.explode(F.from_json(field("$.children"), "array<string>")).alias("id")
    )
    items = records.where("kind = 'item'").select("owner", "id")
    slugs = records.where("kind = 'package'").select("kind", "owner", "id", field("$.slug").alias("slug")).where("slug is not null")
    repeated = slugs.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1").select("slug")
    repositories = records.where("kind = 'repository'").select(F.col("id").alias("repository"))
    uses = records.where("kind = 'package'").select("kind", "owner", "id", field("$.repository").alias("repository"))
    parts = [
        found(records.where(~F.col("kind").isin(TOP_KINDS + OWNED_KINDS)), "unknown-kind"),
        found(records.where(F.col("kind").isin(TOP_KINDS) & (F.col("owner") != "")), "owner-not-empty"),
        found(records.where(F.col("kind").isin("workspace", "presentation") & (F.col("id") != "")), "id-not-empty"),
        found(records.where(~F.col("kind").isin("workspace", "presentation") & (F.col("id") == "")), "id-empty"),
        found(records.groupBy("kind", "owner", "id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate-key"),
        found(owned.join(packages, "owner", "left_anti"), "orphan-owner"),
        found(children.join(items, ["owner", "id"], "left_anti"), "missing-child"),
        found(slugs.join(repeated, "slug", "left_semi"), "duplicate-slug"),
        found(uses.where("repository is not null").join(repositories, "repository", "left_anti"), "missing-repository"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def fingerprint_violations(records: DataFrame, **options) -> DataFrame:
    """Rows whose stored fingerprint is not that of their content, or whose content is not in canonical form."""
    checked = records.withColumn("expected", record_fingerprint(F.col("kind"), F.col("owner"), F.col("id"), F.col("content"), **options))
    bad = ~F.col("expected").eqNullSafe(F.col("fingerprint")) | ~canonical_json("content").eqNullSafe(F.col("content"))
    return checked.where(bad).select("kind", "owner", "id", "fingerprint", "expected")


def content_fingerprint(records: DataFrame, assets: DataFrame, domain: str = "recordloom/content-v1") -> DataFrame:
    """One digest over all records and asset metadata, whatever their order.

    A tree of digests: rows are digested where they are, those of a bucket in key order, and the 256 buckets in turn,
    so no task holds more than a bucket's digests.
    """
    rows = records.select(F.concat_ws("\0", F.lit("record"), "kind", "owner", "id", "fingerprint").alias("row")).unionAll(
        assets.select(F.concat_ws("\0", F.lit("asset"), "digest", "media_type", F.octet_length("bytes")).alias("row"))
    )
    digests = rows.select(F.sha2("row", 256).alias("d"))
    leaves = digests.groupBy(F.substring("d", 1, 4).alias("leaf")).agg(F.array_sort(F.collect_list("d")).alias("ds"))
    leaves = leaves.select("leaf", F.sha2(F.array_join("ds", ""), 256).alias("d"))
    buckets = leaves.groupBy(F.substring("leaf", 1, 2).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("leaf", "d"))).alias("ds"))
    buckets = buckets.select("bucket", F.sha2(F.array_join(F.transform("ds", lambda x: x["d"]), ""), 256).alias("d"))
    root = buckets.agg(F.array_sort(F.collect_list(F.struct("bucket", "d"))).alias("ds"))
    return root.select(domain_digest(domain, F.array_join(F.transform("ds", lambda x: x["d"]), "")).alias("fingerprint"))
