"""Walks over block trees that are stored as JSON in page records: references, anchors, text and mathematics.

A tree is a ``VARIANT`` and is walked level by level: a round opens the children of the nodes that the last one found, by
built-in functions only, so the plan has no Python and no join or shuffle. A round is written once; what later rounds
carry are the subtrees that are still closed. The rounds are as many as the deepest tree is deep. A node's place is the
array of ordinals on the way to it, and arrays compare like the order of the document.

Which fields hold children depends on the kind, as below. Nodes of other kinds are leaves, whatever fields they have. In
executed cells only outputs that are generated Markdown hold blocks; what lies in them is ``generated`` and is reported
at the place of its cell (or of the output's own record of origin), not at its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle

# Kinds of nodes by the field that holds their children.
INLINES = ("paragraph", "heading", "emphasis", "strong", "strikeout", "styled", "citation", "link")
BLOCKS = ("block-quote", "container", "component", "tabset", "callout")
# Kinds that carry attributes with an identifier, containers of generated content, and references.
ATTRIBUTED = ("heading", "callout", "component", "tabset", "link", "image")
GENERATED = ("generated-chunk", "generated-output")
REFERENCES = {"semantic-reference": "semantic", "auto-link": "link", "link": "link", "image": "image"}
SPACES = ("space", "soft-break", "hard-break", "nonbreaking-space")


def _quoted(kinds) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


_NONE = "filter(array(cast(null as variant)), x -> false)"


def _list(node: str, field: str) -> str:
    return f"coalesce(try_variant_get({node}, '$.{field}', 'array<variant>'), {_NONE})"


def _plain(field: str, *before: str) -> str:
    way = ", ".join([*before, "i"])
    return f"transform({_list('node', field)}, (x, i) -> struct(array({way}) as way, x as node, cast(null as variant) as origin))"


#: The spans of an output's records of generated Markdown, and its Markdown representations; the n-th belong together.
_OUTPUTS = f"""transform({_list('node', 'outputs')}, o -> struct(
  transform(filter({_list('o', 'provenance')}, p -> try_variant_get(p, '$.activity.kind', 'string') = 'generated-markdown'), p -> try_variant_get(p, '$.span', 'variant')) as spans,
  filter({_list('o', 'representations')}, r -> coalesce(try_variant_get(r, '$.type', 'string') = 'markdown-blocks', false)) as parts))"""

_CHILDREN = f"""case when kind in ({_quoted(INLINES)}) then {_plain('inlines')}
when kind = 'image' then {_plain('alt')}
when kind in ({_quoted(BLOCKS)}) then {_plain('blocks')}
when kind = 'list' then flatten(transform({_list('node', 'items')}, (t, n) -> transform({_list('t', 'blocks')}, (x, i) -> struct(array(n, i) as way, x as node, cast(null as variant) as origin))))
when kind = 'table' then concat({_plain('caption', '0')}, flatten(flatten(transform({_list('node', 'rows')}, (r, n) -> transform({_list('r', 'cells')}, (c, m) ->
  transform({_list('c', 'blocks')}, (x, i) -> struct(array(1, n, m, i) as way, x as node, cast(null as variant) as origin)))))))
when kind = 'code-cell' then flatten(flatten(transform({_OUTPUTS}, (o, n) -> transform(o.parts, (r, m) ->
  transform({_list('r', 'blocks')}, (x, i) -> struct(array(n, m, i) as way, x as node, coalesce(try_element_at(o.spans, m + 1), try_variant_get(node, '$.span', 'variant')) as origin))))))
end"""


def _text(path: str) -> Column:
    return F.expr(f"try_variant_get(node, '$.{path}', 'string')")


def walk(documents: DataFrame, id_col: str, json_col: str, max_depth: int = 10_000) -> DataFrame:
    """All nodes of the block arrays in ``json_col``, one row each.

    ``way`` is the node's place and ``block`` that of its nearest block (a paragraph, heading or table for what stands in
    a line). ``generated`` tells whether an executed cell made it, ``hidden`` whether a container of generated content
    holds it. ``kind`` and the fields that a node of that kind may have: ``container`` (the kind of a container),
    ``target``, ``text`` (what it adds to a line), ``anchors``, ``start`` and ``end`` of the source range that it is
    reported at. Texts that are no JSON array give nothing.
    """
    tree = documents.select(F.col(f"`{id_col}`").alias("id"), F.try_parse_json(F.col(f"`{json_col}`")).alias("tree"))
    top = "explode(coalesce(try_variant_get(tree, '$', 'array<variant>'), {none}))".format(none=_NONE)
    nodes = tree.select("id", F.posexplode(F.expr(top.removeprefix("explode"))).alias("i", "node")).select(
        "id", F.array("i").alias("way"), F.lit(None).cast("array<int>").alias("block"), F.lit(False).alias("generated"), F.lit(False).alias("hidden"),
        F.lit(None).cast("variant").alias("origin"), "node", _text("type").alias("kind"),
    )
    kind, found, depth = F.col("kind"), None, 0
    while True:
        nodes = settle(nodes)
        if nodes.isEmpty():
            return _facts(nodes if found is None else found)
        found = nodes if found is None else found.unionAll(nodes)
        depth += 1
        if depth > max_depth:
            raise ValueError(f"a tree is deeper than {max_depth}")
        inside = kind.isin(*INLINES, "image", "table")
        carried = nodes.select(
            "id", "way", F.when(kind.isin("paragraph", "heading", "table"), F.col("way")).otherwise(F.when(inside, F.col("block"))).alias("block"),
            (F.col("generated") | (kind == "code-cell")).alias("generated"),
            (F.col("hidden") | ((kind == "container") & F.coalesce(_text("kind").isin(*GENERATED), F.lit(False)))).alias("hidden"), "origin",
            F.explode(F.expr(_CHILDREN)).alias("child"),
        )
        nodes = carried.select(
            "id", F.concat("way", "child.way").alias("way"), "block", "generated", "hidden", F.coalesce("child.origin", "origin").alias("origin"),
            F.col("child.node").alias("node"), F.expr("try_variant_get(child.node, '$.type', 'string')").alias("kind"),
        )


def _facts(nodes: DataFrame) -> DataFrame:
    kind = F.col("kind")
    text = (
        F.when(kind.isin("text", "code"), _text("value")).when(kind.isin(*SPACES), " ").when(kind.isin("auto-link", "semantic-reference"), _text("target"))
        .when(kind == "unsupported", _text("raw")).when(kind == "math", F.coalesce(_text("fallback"), _text("latex")))
    )
    option = "transform(filter({}, o -> try_variant_get(o, '$.key', 'string') = 'label' and try_variant_get(o, '$.resolution.type', 'string') = 'resolved'), o -> {})".format(
        _list("node", "resolved_options"), f"try_variant_get(try_element_at({_list('node', 'options')}, 1 + try_variant_get(o, '$.resolution.declaration', 'int')), '$.cooked_value', 'string')"
    )
    labels = f"transform({_list('node', 'labels')}, x -> try_variant_get(x, '$.value', 'string'))"
    anchors = (
        F.when(kind.isin("api-documentation", "container"), F.array(_text("identifier"))).when(kind.isin(*ATTRIBUTED), F.array(_text("attributes.identifier.value")))
        .when(kind == "code-cell", F.concat(F.array(_text("identifier.value")), F.expr(labels), F.expr(option)))
    )
    where = "coalesce(try_variant_get(origin, '$.{f}', 'bigint'), try_variant_get(node, '$.span.{f}', 'bigint'))"
    return nodes.select(
        "id", "way", "block", "generated", "hidden", "kind", F.when(kind == "container", _text("kind")).alias("container"), _text("target").alias("target"), text.alias("text"),
        F.array_compact(F.coalesce(anchors, F.array().cast("array<string>"))).alias("anchors"), F.expr(where.format(f="start")).alias("start"), F.expr(where.format(f="end")).alias("end"),
    )


def stored_references(nodes: DataFrame) -> DataFrame:
    """(id, way, reference, target, start, end, generated): semantic references, links and images of ``walk``."""
    reference = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])[F.col("kind")]
    return nodes.where(F.col("kind").isin(*REFERENCES) & F.col("target").isNotNull()).select("id", "way", reference.alias("reference"), "target", "start", "end", "generated")


def stored_anchors(nodes: DataFrame) -> DataFrame:
    """(id, anchor): the anchors of a page, but for those inside generated content. A page has each once."""
    return nodes.where("not generated and not hidden").select("id", F.explode("anchors").alias("anchor")).distinct()


def line_texts(nodes: DataFrame) -> DataFrame:
    """(id, block, text): the plain text of every paragraph, heading and table caption, in the order of its parts.

    Links, emphasis and so on add what is inside them, a formula its alternative text or else its source. A group is one
    line's parts. A line without any has no row.
    """
    parts = nodes.where("block is not null and text is not null").groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("way", "text"))).alias("parts"))
    return parts.select("id", "block", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def pages_with_math(nodes: DataFrame) -> DataFrame:
    """(id): pages that show a formula, outside of executed cells' outputs."""
    return nodes.where("not generated and kind in ('math', 'display-math')").select("id").distinct()
