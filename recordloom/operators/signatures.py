"""Signatures as text: expression trees folded bottom up, and the calls that are made of them.

A tree is rows of nodes whose place is the array of ordinals on the way to them. The fold goes level by level, from the
deepest: the texts of a level are gathered under their parents, which become texts in turn. The rows of each level are
written apart, so a round reads two levels and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle, shared_path

#: Fixed value: calls longer than this get a line for each parameter.
WIDTH = 80


def fold_expressions(nodes: DataFrame) -> DataFrame:
    """(tree, text) of the nodes (tree, way, kind, text, ecosystem) of expression trees.

    Kinds: ``name`` and ``literal`` are their text; ``apply`` puts its further children in brackets behind the first, in
    the brackets of the ecosystem; ``sequence`` joins by commas; ``union`` by bars, ``tokens`` of Rust by nothing; any other
    kind by blanks, unless it has a text of its own.
    """
    path = shared_path(nodes.sparkSession, "expressions")
    placed = nodes.select("tree", "way", "kind", "text", "ecosystem", F.size("way").alias("depth"))
    placed.write.partitionBy("depth").parquet(path)
    levels = nodes.sparkSession.read.schema(placed.schema).parquet(path)
    deepest = levels.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("tree", "text").limit(0)
    below = None
    for depth in range(deepest, -1, -1):
        level = levels.where(F.col("depth") == depth).drop("depth")
        if below is None:
            rows = level.withColumn("parts", F.array().cast("array<string>"))
        else:
            up = below.select("tree", F.slice("way", F.lit(1), F.size("way") - 1).alias("way"), F.struct(F.element_at("way", -1).alias("i"), "text").alias("part"))
            gathered = up.groupBy("tree", "way").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]).alias("parts"))
            rows = level.join(gathered, ["tree", "way"], "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
        below = settle(rows.select("tree", "way", _written().alias("text")))
    return below.select("tree", "text")


def _written() -> Column:
    kind, text, parts, eco = F.col("kind"), F.col("text"), F.col("parts"), F.col("ecosystem")
    open_, close = (F.when(eco == "python", a).when(eco == "rust", b).otherwise(c) for a, b, c in (("[", "<", "("), ("]", ">", ")")))
    inside = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ", ")
    return (
        F.when(kind.isin("name", "literal"), text).when(kind == "apply", F.concat(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), open_, inside, close))
        .when(kind == "sequence", F.array_join(parts, ", ")).when(text.isNotNull(), text).when((kind == "tokens") & (eco == "rust"), F.array_join(parts, ""))
        .when(kind == "union", F.array_join(parts, " | ")).otherwise(F.array_join(parts, " "))
    )


def callable_signatures(items: DataFrame, parameters: DataFrame) -> DataFrame:
    """(item, signature) of items (item, name, ecosystem, returns) and parameters (item, ord, name, kind, annotation, default).

    Annotations, defaults and results are texts, such as ``fold_expressions`` makes. Kinds: ``positional-only``,
    ``positional``, ``variadic-positional``, ``keyword-only``, ``variadic-keyword``. Python marks where positional-only
    parameters end and keyword-only ones begin; Julia puts keywords behind a semicolon. A call of more than 80 characters
    gets a line for each parameter. A group is one signature's parameters.
    """
    listed = parameters.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "kind", "annotation", "default"))).alias("ps"))
    rows = items.join(listed, "item", "left").withColumn("ps", F.coalesce("ps", F.from_json(F.lit("[]"), listed.schema["ps"].dataType)))
    python, julia = F.col("ecosystem") == "python", F.col("ecosystem") == "julia"
    tail = lambda p, colon: F.coalesce(F.concat(F.lit(colon), p["annotation"]), F.lit(""))
    value = lambda p: F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit(""))

    def plain(p: Column) -> Column:
        star = F.when(python & (p["kind"] == "variadic-positional"), "*").when(python & (p["kind"] == "variadic-keyword"), "**").otherwise("")
        return F.concat(star, p["name"], tail(p, ": "), value(p))

    kinds = F.transform("ps", lambda p: p["kind"])
    keyword, variadic = F.array_position(kinds, "keyword-only"), F.array_position(kinds, "variadic-positional")
    marked = F.when(python & (keyword > 0) & ((variadic == 0) | (variadic > keyword)), keyword).otherwise(F.lit(0))

    def with_marks(p: Column, i: Column) -> Column:
        after = F.try_element_at(kinds, (i + 2).cast("int"))
        last = python & (p["kind"] == "positional-only") & ~F.coalesce(after == "positional-only", F.lit(False))
        return F.concat(F.when(marked == i + 1, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")), F.array(plain(p)), F.when(last, F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")))

    parts = F.flatten(F.transform("ps", with_marks))
    suffix = F.coalesce(F.concat(F.lit(" -> "), "returns"), F.lit(""))
    short = F.concat("name", F.lit("("), F.array_join(parts, ", "), F.lit(")"), suffix)
    long = F.concat("name", F.lit("(\n    "), F.array_join(parts, ",\n    "), F.lit("\n)"), suffix)
    laid = F.when((F.char_length(short) > WIDTH) & ~F.contains(short, F.lit("\n")) & (F.size("ps") > 0), long).otherwise(short)
    spread = lambda p: F.concat(p["name"], tail(p, "::"), F.when(p["kind"].isin("variadic-positional", "variadic-keyword"), "...").otherwise(""), value(p))
    named = lambda p: p["kind"].isin("keyword-only", "variadic-keyword")
    positional, keywords = F.transform(F.filter("ps", lambda p: ~named(p)), spread), F.transform(F.filter("ps", named), spread)
    more = F.when(F.size(keywords) > 0, F.concat(F.lit("; "), F.array_join(keywords, ", "))).otherwise("")
    of_julia = F.concat("name", F.lit("("), F.array_join(positional, ", "), more, F.lit(")"), F.coalesce(F.concat(F.lit("::"), "returns"), F.lit("")))
    return rows.select("item", F.when(julia, of_julia).otherwise(laid).alias("signature"))
