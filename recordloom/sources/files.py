"""File trees, configuration documents and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never inputs. A producer's own state folder comes on top, as a parameter.
EXCLUDED = [
    ".git", ".devenv", ".direnv", ".cache", "node_modules", "target", "dist", "build", "_site", ".docs-sources", "site", "artifacts", "coverage",
    "__pycache__", ".playwright-cli", "playwright-report", "test-results",
]
#: Document formats by extension.
FORMATS = {"md": "markdown", "qmd": "quarto", "Rmd": "rmarkdown"}


def java_quoted(text: str) -> str:
    """A pattern that matches ``text`` as it is."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def file_tree(spark: SparkSession, root: str, pattern: str = "*", excluded: list[str] = EXCLUDED) -> DataFrame:
    """(path, length, modificationTime, content, relative) of all files under ``root``, excluded folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    inner = F.regexp_replace("path", "^.*?" + java_quoted(root.rstrip("/")) + "/", "")
    folders = F.slice(F.split(inner, "/"), F.lit(1), F.size(F.split(inner, "/")) - 1)
    return files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, excluded)))).withColumn("relative", inner)


def pages_in(spark: SparkSession, root: str, reserved: list[str] = (".git",), generated: str | None = None, formats: list[str] | None = None) -> DataFrame:
    """(relative, format, text) of the documents under a root, in the order of their paths.

    Nothing under a reserved folder or that of generated files counts; ``formats`` leaves only those.
    """
    ext = F.regexp_extract("relative", r"\.([^./]+)$", 1)
    kinds = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    files = file_tree(spark, root).withColumn("format", F.try_element_at(kinds, ext)).where("format is not null")
    folder = F.arrays_overlap(F.split("relative", "/"), F.array(*map(F.lit, reserved))) if reserved else F.lit(False)
    if generated:
        folder = folder | (F.col("relative") == generated) | F.startswith("relative", F.lit(generated.rstrip("/") + "/"))
    files = files.where(~folder)
    if formats:
        files = files.where(F.col("format").isin(formats))
    return files.select("relative", "format", F.col("content").cast("string").alias("text")).orderBy("relative")


def manifest(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, digest): declared paths with the digest of their file; a missing one is a row with null."""
    return declared.select("path").join(files.select("path", F.sha2("content", 256).alias("digest")), "path", "left")


def first_of(files: DataFrame, names: list[str]) -> DataFrame:
    """(folder, name, content) of the first of ``names`` that each folder has."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    found = files.withColumn("_p", place).where("_p > 0")
    return found.groupBy("folder").agg(F.min_by(F.struct("name", "content"), "_p").alias("f")).select("folder", "f.*")


def python_sources(files: DataFrame, roots: list[str]) -> DataFrame:
    """(root, module, stub, relative) of Python files under import roots, the deepest root first.

    ``files`` has ``relative``. A package is named by its folder; a stub is a file of its own beside a source.
    """
    from ..operators.resolve import longest_prefix

    spark = files.sparkSession
    found = files.where(F.regexp_like("relative", F.lit(r"\.pyi?$"))).select("relative")
    places = found.withColumn("path", F.regexp_replace("relative", "/?[^/]*$", ""))
    known = longest_prefix(places.select("path").distinct(), spark.createDataFrame([(r.strip("/"),) for r in roots], "root string"))
    rows = places.join(known.where("root is not null"), "path")
    inner = F.when(F.col("root") == "", F.col("relative")).otherwise(F.substr("relative", F.char_length("root") + 2))
    bare = F.regexp_replace(F.regexp_replace(inner, r"\.pyi?$", ""), r"(^|/)__init__$", "")
    module = F.replace(bare, F.lit("/"), F.lit("."))
    return rows.select("root", module.alias("module"), F.endswith("relative", F.lit(".pyi")).alias("stub"), "relative").where("module <> ''")


def r_sources(files: DataFrame) -> DataFrame:
    """(package, kind, relative) of the files of R packages: sources, help, the index of exports and the description.

    A package is a folder with a ``DESCRIPTION``; only its own ``R`` and ``man`` folders count.
    """
    rows = files.select("relative", F.regexp_extract("relative", r"^((?:.*/)?)(?:R/[^/]+\.[RrSsq]|man/[^/]+\.[Rr]d|NAMESPACE|DESCRIPTION)$", 1).alias("package"))
    kind = (
        F.when(F.regexp_like("relative", F.lit(r"(?:^|/)R/[^/]+\.[RrSsq]$")), "source").when(F.regexp_like("relative", F.lit(r"(?:^|/)man/[^/]+\.[Rr]d$")), "help")
        .when(F.regexp_like("relative", F.lit(r"(?:^|/)NAMESPACE$")), "namespace").when(F.regexp_like("relative", F.lit(r"(?:^|/)DESCRIPTION$")), "description")
    )
    rows = rows.withColumn("kind", kind).where("kind is not null")
    packages = rows.where("kind = 'description'").select("package").distinct()
    return rows.join(packages, "package", "left_semi").select(F.regexp_replace("package", "/$", "").alias("package"), "kind", "relative")


def environment(spark: SparkSession, names: list[str], values: dict[str, str]) -> DataFrame:
    """(name, digest) of named variables; one that is not set has a null digest."""
    rows = spark.createDataFrame([(n, values.get(n)) for n in sorted(set(names))], "name string, value string")
    return rows.select("name", F.sha2("value", 256).alias("digest"))


def url_map(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, destination) of a URL map in JSON; only version 1 is read, and no other sections."""
    schema = "version int, documents map<string,string>, assets map<string,string>, _corrupt_record string"
    held = spark.read.schema(schema).option("multiLine", "true").json(path)
    wrong = held.where("version is null or version <> 1 or _corrupt_record is not null").limit(1).collect()
    if wrong:
        raise ValueError(f"not a URL map of version 1: {path}")
    parts = [held.select(F.lit(s).alias("section"), F.explode(s).alias("key", "destination")) for s in ("documents", "assets")]
    return parts[0].unionAll(parts[1])


def read_config(spark: SparkSession, path: str, known: dict[str, set[str]]) -> dict:
    """One configuration document, YAML or JSON; unknown keys are errors. ``known``: allowed keys by dotted section."""
    import json

    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith(".json"):
        value = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML configuration needs the yaml module; use JSON instead") from error
        value = yaml.safe_load(text)

    def walk(node, section):
        if isinstance(node, dict):
            if section in known and (odd := set(node) - known[section]):
                raise ValueError(f"unknown keys in {section or 'the document'}: {sorted(odd)}")
            for k, v in node.items():
                walk(v, f"{section}.{k}".strip("."))
        elif isinstance(node, list):
            for v in node:
                walk(v, section)

    walk(value, "")
    return value


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark events, one JSON object a line, with a declared schema."""
    schema = "sample string, event string, id string, phase string, package string, target string, seconds double, at double"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
