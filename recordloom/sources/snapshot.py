"""Snapshots: verifying, publishing, importing and exporting their tables. ``database`` reads and writes SQLite files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Commit, CommitLog
from .database import SCHEMAS


def verify(tables: dict[str, DataFrame], domain: str | None = None, rules: bool = True) -> DataFrame:
    """(code, key) of everything broken: the manifest, digests of assets, the key contract and references between
    records, and with the ``domain`` of their producer the fingerprints of records. Empty means valid."""
    from ..operators.integrity import reference_violations
    from ..operators.records import fingerprint_violations, record_violations

    single = tables["manifest"].agg(F.count("*").alias("n")).where("n <> 1").select(F.lit("manifest-not-single").alias("code"), F.col("n").cast("string").alias("key"))
    assets = tables["assets"].where(F.sha2("bytes", 256) != F.col("digest")).select(F.lit("asset-digest").alias("code"), F.col("digest").alias("key"))
    twice = tables["assets"].groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate-asset").alias("code"), F.col("digest").alias("key"))
    found = record_violations(tables["records"]).select("code", "kind", "owner", "id")
    if rules:
        found = found.unionAll(reference_violations(tables["records"], tables["assets"]))
    if domain is not None:
        wrong = fingerprint_violations(tables["records"], domain=domain)
        found = found.unionAll(wrong.select(F.lit("record-fingerprint").alias("code"), "kind", "owner", "id"))
    return single.unionAll(assets).unionAll(twice).unionAll(found.select("code", F.concat_ws("/", "kind", "owner", "id").alias("key")))


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put ``text`` into a file in one step: written beside it, then renamed over it, so readers find the old or the new."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = target.getFileSystem(conf).create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, target, how)


def publish(tables: dict[str, DataFrame], path: str, domain: str | None = None, base: Commit | None | str = "latest") -> Commit:
    """Write the tables as Parquet, read them back, verify them, and only then commit them as the published version.

    Versions stand side by side and readers take the last commit, so they never see a part of a snapshot. ``base`` is the
    version that the tables were made from; if another one was published since, this one is refused with ``Conflict``.
    Records are clustered by their key for point lookups.
    """
    spark = tables["records"].sparkSession
    log = CommitLog(spark, path)
    base = log.latest() if base == "latest" else base
    version, folder = log.data_path()
    try:
        for name, df in tables.items():
            df = df.repartitionByRange("kind", "owner", "id").sortWithinPartitions("kind", "owner", "id") if name == "records" else df
            df.write.parquet(f"{folder}/{name}")
        broken = verify({name: spark.read.parquet(f"{folder}/{name}") for name in tables}, domain).limit(5).collect()
        if broken:
            raise ValueError(f"refused to publish: {[tuple(r) for r in broken]}")
        return log.commit(base, version, ["*"], ["*"])
    except BaseException:
        log.remove(version)
        raise


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    now = CommitLog(spark, path).latest()
    if now is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return {name: spark.read.parquet(f"{path}/{now.data}/{name}") for name in SCHEMAS}


def bundle_violations(records: DataFrame) -> DataFrame:
    """(code, n) of what a bundle may not hold: one package and one repository, none of the kinds of a whole workspace."""
    def count(kind):
        return F.count_if(F.col("kind") == kind)

    counts = records.agg(*[count(k).alias(k) for k in ("package", "repository", "collection", "concept", "execution")])
    codes = [F.when(F.col(k) != 1, F.struct(F.lit(f"not-one-{k}").alias("code"), F.col(k).alias("n"))) for k in ("package", "repository")]
    codes += [F.when(F.col(k) > 0, F.struct(F.lit(f"has-{k}").alias("code"), F.col(k).alias("n"))) for k in ("collection", "concept", "execution")]
    return counts.select(F.inline(F.array_compact(F.array(*codes))))


def import_bundle(base: dict[str, DataFrame], bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Union of a snapshot and a bundle of one package and repository.

    A key or a package's slug in both is an error; an equal asset, or the same repository with equal content, is not.
    """
    broken = bundle_violations(bundle["records"]).collect()
    if broken:
        raise ValueError(f"a bundle holds one package and one repository: {[tuple(r) for r in broken]}")
    single = ["workspace", "presentation"]
    new = bundle["records"].where(~F.col("kind").isin(single))
    same = F.col("kind") == "repository"
    known = base["records"].where(same).select("kind", "owner", "id", "content")
    new = new.where(~same).unionByName(new.where(same).join(known, ["kind", "owner", "id", "content"], "left_anti").select(new.columns))
    both = new.join(base["records"], ["kind", "owner", "id"], "left_semi").limit(5).collect()
    if both:
        raise ValueError(f"already there: {[(r.kind, r.owner, r.id) for r in both]}")
    slug = F.get_json_object("content", "$.slug").alias("slug")
    held = base["records"].where("kind = 'package'").select(slug)
    slugs = new.where("kind = 'package'").select(slug).where("slug is not null").join(held, "slug", "left_semi").limit(5).collect()
    if slugs:
        raise ValueError(f"slug already taken: {[r.slug for r in slugs]}")
    assets = base["assets"].unionByName(bundle["assets"].join(base["assets"], "digest", "left_anti"))
    return base | {"records": base["records"].unionByName(new), "assets": assets}


def insert_once(cache: DataFrame, entries: DataFrame, key: str, payload: str) -> DataFrame:
    """The rows of ``entries`` to append to a write-once table; two payloads for a key, known or new, are an error."""
    twice = entries.groupBy(key).agg(F.count_distinct(F.struct(payload)).alias("_n")).where("_n > 1").select(key).limit(5).collect()
    if twice:
        raise ValueError(f"several payloads for {[r[0] for r in twice]}")
    known = cache.select(key, F.col(payload).alias("_held"))
    clash = entries.join(known, key).where(~F.col(payload).eqNullSafe(F.col("_held"))).select(key).limit(5).collect()
    if clash:
        raise ValueError(f"other payloads for {[r[0] for r in clash]}")
    return entries.join(known, key, "left_anti").dropDuplicates([key])


def export_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, key, line): the canonical text of every record and asset. ``write_lines`` puts them in order."""
    from ..functions.canonical import canonical_json

    record = F.to_json(F.struct("kind", "owner", "id", "fingerprint"))
    lines = tables["records"].select(
        F.lit(0).alias("section"), F.concat_ws("\0", "kind", "owner", "id").alias("key"), F.concat_ws("\t", record, canonical_json("content")).alias("line")
    )
    asset = F.to_json(F.struct("digest", "media_type", F.octet_length("bytes").alias("byte_size"), F.base64("bytes").alias("bytes_base64")))
    return lines.unionAll(tables["assets"].select(F.lit(1).alias("section"), F.col("digest").alias("key"), asset.alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write exported lines in the order of section and key: a range-partitioned sort, so the files in the order of
    their names are the sorted whole, however large."""
    lines.orderBy("section", "key").select("line").write.text(path)


def pretty(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
