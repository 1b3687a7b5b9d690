"""Queries over stored block trees, and the SQL that they are held against.

A conversation plays a page: every turn's block holds the next turn's, so the trees are as deep as conversations are
long. The SQL never sees the trees: it says from the turns what a walk has to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import trees
from .queries import query, read


def _pages(spark, sf_dir: str) -> DataFrame:
    """(id, tree): nested blocks of a conversation.

    A user's turn is a heading with its text (and a formula, if that is of even length) and a quotation around what follows; an assistant's a table, with a link in
    its caption and what follows in a cell; a system's an executed cell, whose generated Markdown starts with a formula.
    """
    turns = read(spark, sf_dir, "conversations")
    json = lambda x: F.to_json(F.struct(x.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("v")))) - 6)
    text = F.concat(F.lit('{"type":"text","value":'), json(F.col("text")), F.lit("}"))
    name = F.concat(F.lit('"t'), F.col("turn"), F.lit('"'))
    span = F.concat(F.lit('"span":{"start":'), F.col("turn") * 10, F.lit(',"end":'), F.col("turn") * 10 + 5, F.lit("}"))
    user_head = F.concat(
        F.lit('{"type":"heading","level":2,"attributes":{"identifier":{"value":'), name, F.lit('}},"inlines":[{"type":"strong","inlines":['), text, F.lit("]},"),
        F.lit('{"type":"soft-break"},{"type":"semantic-reference","target":'), name, F.lit(","), span, F.lit("}"),
        F.when(F.char_length("text") % 2 == 0, ',{"type":"math","latex":"y","fallback":"why"}').otherwise(""), F.lit(']},{"type":"block-quote","blocks":['),
    )
    table_head = F.concat(
        F.lit('{"type":"table","caption":[{"type":"link","target":"#'), F.col("turn"), F.lit('",'), span, F.lit(',"attributes":{"identifier":{"value":'), name,
        F.lit('}},"inlines":[{"type":"code","value":"c"}]}],"rows":[{"cells":[{"blocks":[{"type":"paragraph","inlines":['), text, F.lit("]}]}]},"),
        F.lit('{"cells":[{"blocks":['),
    )
    cell_head = F.concat(
        F.lit('{"type":"code-cell","labels":[{"value":'), name, F.lit("}],"), span,
        F.lit(',"outputs":[{"provenance":[],"representations":[{"type":"plain-text","text":"x"},{"type":"markdown-blocks","blocks":[{"type":"paragraph","inlines":[{"type":"math","latex":"x^2"}]},'),
    )
    role = F.col("role")
    head = F.when(role == "user", user_head).when(role == "assistant", table_head).otherwise(cell_head)
    tail = F.when(role == "user", "]}").when(role == "assistant", "]}]}]}").otherwise("]}]}]}")
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", head.alias("head"), tail.alias("tail")))).alias("t"))
    heads, tails = F.array_join(F.transform("t", lambda x: x["head"]), ""), F.array_join(F.transform(F.reverse("t"), lambda x: x["tail"]), "")
    return parts.select(F.col("conv_id").alias("id"), F.concat(F.lit("["), heads, F.lit('{"type":"thematic-break"}'), tails, F.lit("]")).alias("tree"))


#: Of every turn, whether an executed cell holds it, and the first cell's place; the innermost cell is where it is reported.
_TURNS = """t as (select conv_id, turn, role, text, coalesce(max(case when role = 'system' then turn end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), -1) as cell,
  row_number() over (partition by conv_id order by turn) as depth from conversations)"""


@query(
    f"""with {_TURNS} select conv_id as id, row_number() over (partition by conv_id order by turn) as place, case when role = 'user' then 'semantic' else 'link' end as reference,
    case when role = 'user' then 't' || turn else '#' || turn end as target, case when cell >= 0 then cell * 10 else turn * 10 end as start, cell >= 0 as generated from t where role in ('user', 'assistant')"""
)
def t1_stored_references(spark, sf_dir):
    from pyspark.sql import Window

    found = trees.stored_references(trees.walk(_pages(spark, sf_dir), "id", "tree"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("way"))
    return found.select("id", place.cast("bigint").alias("place"), "reference", "target", "start", "generated")


@query(f"with {_TURNS} select conv_id as id, 't' || turn as anchor from t where cell < 0")
def t2_stored_anchors(spark, sf_dir):
    return trees.stored_anchors(trees.walk(_pages(spark, sf_dir), "id", "tree"))


@query(
    f"""with {_TURNS} select conv_id as id, count(*) as lines, sha256(string_agg(line, chr(10) order by turn, part)) as digest from (
    select conv_id, turn, 0 as part, text || ' t' || turn || case when length(text) % 2 = 0 then 'why' else '' end as line from t where role = 'user' union all select conv_id, turn, 0, 'c' from t where role = 'assistant' union all select conv_id, turn, 1, text from t where role = 'assistant'
    union all select conv_id, turn, 0, 'x^2' from t where role not in ('user', 'assistant')) group by conv_id"""
)
def x14_stored_lines(spark, sf_dir):
    lines = trees.line_texts(trees.walk(_pages(spark, sf_dir), "id", "tree"))
    listed = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("l"))
    return listed.select("id", F.size("l").cast("bigint").alias("lines"), F.sha2(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), 256).alias("digest"))


@query(f"with {_TURNS} select distinct conv_id as id from t where role = 'user' and length(text) % 2 = 0 and cell < 0")
def t13_stored_math(spark, sf_dir):
    return trees.pages_with_math(trees.walk(_pages(spark, sf_dir), "id", "tree"))
