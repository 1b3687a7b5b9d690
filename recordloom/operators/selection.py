"""Choosing items: discoverable sets, documentation blocks, members of native indexes, trees with active paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import reachable
from .records import discoverable


def discoverable_set(items: DataFrame, members: DataFrame) -> DataFrame:
    """(package, item): discoverable items, methods of discoverable families, and all modules that enclose them.

    ``items`` has the columns of ``discoverable`` and package, item, method_of; ``members`` is (package, parent, child).
    """
    shown = discoverable(items)
    direct = shown.where(F.col("discoverable") & F.col("method_of").isNull()).select("package", "item")
    methods = items.where("method_of is not null").join(direct.select("package", F.col("item").alias("method_of")), ["package", "method_of"], "left_semi").select("package", "item")
    both = direct.unionAll(methods)
    edges = members.select(F.struct("package", F.col("child").alias("item")).alias("src"), F.struct("package", F.col("parent").alias("item")).alias("dst"))
    return reachable(edges, both.select(F.struct("package", "item").alias("node"))).select("node.package", "node.item")


def documentation_block(items: DataFrame, blocks: DataFrame, order: list[str]) -> DataFrame:
    """Items of each block (block, ordinal, module, pages, public, private) with their ``position``.

    Fields, methods and undocumented items are left out, then those the visibility flags exclude. Within a module the
    order is by the position of the item's page among the block's pages, the rank of its kind, and its name.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    met = items.where("documented and role not in ('field', 'method')").join(blocks, "module")
    kept = met.where((F.col("exported") & F.col("public")) | (~F.col("exported") & F.col("private")))
    kept = kept.withColumn("page_position", F.when(F.size("pages") == 0, 0).otherwise(F.array_position("pages", F.col("page"))))
    kept = kept.where((F.size("pages") == 0) | (F.col("page_position") > 0))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "page_position", F.when(rank > 0, rank).otherwise(len(order) + 1).alias("rank"), "name", "item")))
    return kept.groupBy("block").agg(rows.alias("rows")).select("block", F.posexplode("rows").alias("position", "r")).select("block", "position", "r.item")


def documentation_list(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(block, ordinal, item, problem) of explicit entries (block, ordinal, owner, target) of a block.

    Each has to name exactly one item, which is of the block's language and has documentation.
    """
    from .resolve import resolve_items

    rows = entries.withColumn("ref", F.struct("block", "ordinal"))
    found = resolve_items(rows.select("ref", "owner", "target"), items.select("package", "item", "qualified_name", "aliases", "secondary", "ecosystem"))
    facts = items.select("package", "item", F.col("ecosystem").alias("_language"), "documented")
    met = rows.select("ref", "language").join(found.select("ref", "package", "item", "status"), "ref").join(facts, ["package", "item"], "left")
    problem = (
        F.when(F.col("status") != "resolved", F.col("status")).when(F.col("_language") != F.col("language"), "other-language").when(~F.col("documented"), "undocumented")
    )
    return met.select("ref.block", "ref.ordinal", "item", problem.alias("problem"))


def native_members(members: DataFrame, extract_private: bool = False, extract_virtual: bool = False, extract_static: bool = False) -> DataFrame:
    """Members of an index of native code that are documented: private ones and file-level statics only if asked for."""
    private = F.col("protection") == "private"
    shown = ~private | F.lit(extract_private) | (F.lit(extract_virtual) & F.col("virtual"))
    static = ~F.col("static") | F.col("is_member") | F.lit(extract_static)
    return members.where(shown & static)


def active_tree(edges: DataFrame, active: DataFrame) -> DataFrame:
    """(node, active) over (parent, child): a node is active if it, or anything below it, is."""
    nodes = edges.select(F.col("parent").alias("node")).unionAll(edges.select(F.col("child").alias("node"))).distinct()
    hit = reachable(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), active)
    return nodes.join(hit.withColumn("active", F.lit(True)), "node", "left").select("node", F.coalesce("active", F.lit(False)).alias("active"))


def exported_names(steps: DataFrame) -> DataFrame:
    """(module, names, dynamic) from ordered (module, ord, op, names), a fold over null for a list that is not known.

    An assignment makes the list known, or unknown if its names are null; append adds exactly one name and extend any
    number to a known list; anything else makes it unknown. Names keep their order and repeats. A list that ends unknown
    is dynamic.
    """
    listed = steps.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("ord", "op", "names"))).alias("steps"))
    unknown = F.lit(None).cast("array<string>")

    def step(names, s):
        adds = (s["op"] == "extend") | ((s["op"] == "append") & (F.size(s["names"]) == 1))
        # concat with null is null: nothing can be added to a list that is not known.
        return F.when(s["op"] == "assign", s["names"]).when(adds, F.concat(names, s["names"])).otherwise(unknown)

    return listed.select("module", F.aggregate("steps", unknown, step).alias("names")).withColumn("dynamic", F.col("names").isNull())


def public_paths(exports: DataFrame, roots: DataFrame) -> DataFrame:
    """(item, path): every public path of an item over (module, name, target) exports from the roots (module, path).

    A target is a module of its own or an item; a lineage that meets a module again ends there, so no path is longer
    than there are modules and the rounds end. An export without a name is a glob: its module's exports are taken in
    under the path of the importing one.
    """
    from ..plans.lineage import settle

    front = settle(roots.select("module", "path", F.array("module").alias("seen")))
    found = None
    while True:
        step = front.join(exports, "module").select("target", F.concat_ws("::", "path", "name").alias("path"), "seen")
        step = settle(step.where(~F.array_contains("seen", F.col("target"))))
        if step.isEmpty():
            break
        part = step.select(F.col("target").alias("item"), "path")
        found = part if found is None else found.unionAll(part)
        front = settle(step.select(F.col("target").alias("module"), "path", F.concat("seen", F.array("target")).alias("seen")))
    modules = exports.select(F.col("module").alias("item")).distinct()
    return roots.select(F.col("module").alias("item"), "path").limit(0) if found is None else found.join(modules, "item", "left_anti").distinct()
