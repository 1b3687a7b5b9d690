"""API indexes as tables: rustdoc's JSON and Doxygen's XML, read by Spark's own readers.

The rows are what the walks of ``operators.graphs`` and ``operators.selection`` take: nodes with their kind and
visibility, and edges to their children in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version of rustdoc's format that is read, and the kinds of items that stand for themselves.
RUSTDOC_FORMAT = 61
RUST_KINDS = ["module", "struct", "union", "enum", "trait", "trait_alias", "function", "type_alias", "constant", "static", "macro", "proc_macro"]
#: Compounds of Doxygen that hold no declarations.
DOXYGEN_OTHER = ["group", "page", "dir", "example"]


def rust_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, root, id, name, kind, crate_id, public, hidden, docs, inner) of rustdoc files, a row for each item.

    The payload of an item stays JSON text; ``rust_children`` reads what it needs from it. Files of another format are
    refused.
    """
    item = "struct<id:bigint,crate_id:bigint,name:string,docs:string,visibility:string,attrs:array<string>,inner:string>"
    schema = f"root bigint, format_version int, index map<string,{item}>"
    held = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    wrong = held.where(F.col("format_version").isNull() | (F.col("format_version") != RUSTDOC_FORMAT)).limit(1).collect()
    if wrong:
        raise ValueError(f"not rustdoc of format {RUSTDOC_FORMAT}: {wrong[0]['file']}")
    rows = held.select("file", "root", F.explode("index").alias("_key", "i"))
    hidden = F.exists(F.coalesce("i.attrs", F.array().cast("array<string>")), lambda a: F.contains(a, F.lit("doc(hidden)")))
    kind = F.get(F.json_object_keys("i.inner"), F.lit(0))
    return rows.select("file", "root", "i.id", "i.name", kind.alias("kind"), "i.crate_id", (F.col("i.visibility") == "public").alias("public"), hidden.alias("hidden"), "i.docs", "i.inner")


def rust_children(index: DataFrame) -> DataFrame:
    """(file, parent, ord, child, name, use_name, glob) of modules, traits, enums, structs and variants.

    A re-export is the edge of its module to what it names: ``use_name`` is the name it gives, null under a glob.
    """
    ids = F.from_json(
        F.coalesce(
            F.get_json_object("inner", "$.module.items"), F.get_json_object("inner", "$.trait.items"), F.get_json_object("inner", "$.enum.variants"),
            F.get_json_object("inner", "$.struct.kind.plain.fields"), F.get_json_object("inner", "$.union.fields"), F.get_json_object("inner", "$.variant.kind.struct.fields"),
            F.get_json_object("inner", "$.struct.kind.tuple"), F.get_json_object("inner", "$.variant.kind.tuple"),
        ),
        "array<bigint>",
    )
    edges = index.select("file", F.col("id").alias("parent"), F.posexplode(ids).alias("ord", "child")).where("child is not null")
    uses = index.where("kind = 'use'").select(
        "file", F.col("id").alias("child"), F.get_json_object("inner", "$.use.id").cast("bigint").alias("_to"), F.get_json_object("inner", "$.use.name").alias("_as"),
        (F.get_json_object("inner", "$.use.is_glob") == "true").alias("_glob"),
    )
    met = edges.join(uses, ["file", "child"], "left").join(index.select("file", F.col("id").alias("child"), "name"), ["file", "child"], "left")
    return met.select(
        "file", "parent", "ord", F.coalesce("_to", "child").alias("child"), "name", F.when(~F.col("_glob"), F.col("_as")).alias("use_name"), F.coalesce("_glob", F.lit(False)).alias("glob")
    )


def rust_exports(index: DataFrame) -> DataFrame:
    """(file, module, name, target) for ``public_paths``: public, unhidden children of modules; a glob has no name."""
    seen = index.where("public and not hidden").select("file", F.col("id").alias("_entry"))
    modules = index.where("kind = 'module'").select("file", F.col("id").alias("parent"))
    ids = F.from_json(F.get_json_object("inner", "$.module.items"), "array<bigint>")
    entries = index.where("kind = 'module'").select("file", F.col("id").alias("parent"), F.posexplode(ids).alias("ord", "_entry")).join(seen, ["file", "_entry"], "left_semi")
    edges = rust_children(index).join(modules, ["file", "parent"], "left_semi")
    rows = entries.join(edges, ["file", "parent", "ord"])
    name = F.when(F.col("glob"), F.lit(None)).otherwise(F.coalesce("use_name", "name"))
    return rows.select("file", F.col("parent").alias("module"), name.alias("name"), F.col("child").alias("target")).where("name is not null or target is not null")


def doxygen_index(spark: SparkSession, path: str) -> DataFrame:
    """(refid, kind, name) of the compounds of an ``index.xml`` that hold declarations."""
    schema = "_refid string, _kind string, name string"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "compound").load(path)
    return rows.where(~F.col("_kind").isin(DOXYGEN_OTHER)).select(F.col("_refid").alias("refid"), F.col("_kind").alias("kind"), "name")


def doxygen_members(spark: SparkSession, path: str) -> DataFrame:
    """(compound, ord, id, kind, name, protection, static, virtual, is_member, definition, arguments) of compound files.

    ``native_members`` chooses among them; ``is_member`` tells members of classes from those of files and namespaces.
    """
    member = "struct<_id:string,_kind:string,_prot:string,_static:string,_virt:string,name:string,definition:string,argsstring:string>"
    schema = f"_id string, _kind string, compoundname string, sectiondef array<struct<_kind:string,memberdef:array<{member}>>>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "compounddef").load(path)
    every = F.flatten(F.transform(F.coalesce("sectiondef", F.array().cast(f"array<struct<_kind:string,memberdef:array<{member}>>>")), lambda s: F.coalesce(s["memberdef"], F.array().cast(f"array<{member}>"))))
    flat = rows.select(F.col("_id").alias("compound"), F.col("_kind").alias("_compound_kind"), F.posexplode(every).alias("ord", "m"))
    return flat.select(
        "compound", "ord", F.col("m._id").alias("id"), F.col("m._kind").alias("kind"), F.col("m.name").alias("name"), F.col("m._prot").alias("protection"),
        (F.col("m._static") == "yes").alias("static"), F.col("m._virt").isin("virtual", "pure-virtual").alias("virtual"),
        F.col("_compound_kind").isin("class", "struct", "union").alias("is_member"), F.col("m.definition").alias("definition"), F.col("m.argsstring").alias("arguments"),
    )


def doxygen_missing(index: DataFrame, compounds: DataFrame) -> DataFrame:
    """(refid) of compounds that the index names and no file has."""
    return index.select("refid").join(compounds.select(F.col("compound").alias("refid")), "refid", "left_anti")
