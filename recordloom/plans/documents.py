"""Queries of document trees, links, watching and the site model, with the SQL they are held against.

Pages play documents, whose Markdown is made from their addresses in the forms that matter; customers play routes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import links, markup, records, site, tables
from ..streaming import debounce, outputs, watch
from .queries import query, read


def _case(key: Column, *values) -> Column:
    """The value at the remainder of the key by their number."""
    out = F
    for i, v in enumerate(values[:-1]):
        out = out.when(key % len(values) == i, v)
    return out.otherwise(values[-1])


@query(
    """select page_id, page_id % 6 in (0, 4) as link, page_id % 6 = 0 as image from pages"""
)
def x9_url_policy(spark, sf_dir):
    url = _case(F.col("page_id"), F.col("url"), F.concat(F.lit("javascript:"), "url"), F.regexp_replace("url", "://", ":/user:pw@"), F.concat("url", F.lit("%C2%85")), F.lit("mailto:me@x.org"), F.lit("https://"))
    return read(spark, sf_dir, "pages").select("page_id", X.url_allowed(url).alias("link"), X.url_allowed(url, "image").alias("image"))


@query(
    """with p as (select page_id, page_id % 8 as k, replace(url, '&', '&amp;') as u, substr(url, strpos(url, '://') + 3) as host from pages)
    select page_id, case k when 0 then '<p><a href="' || u || '" title="t">x &amp; y</a><br></p>' when 3 then '<td colspan="' || 1 + page_id || '">z</td>' when 6 then '<img alt="a" src="i/' || page_id || '.png">' end as safe,
    case k when 1 then 'element' when 2 then 'url' when 4 then 'attribute' when 5 then 'url' when 7 then 'remote-image' end as rejected from p"""
)
def t11_html_policy(spark, sf_dir):
    u, n = F.replace("url", F.lit("&"), F.lit("&amp;")), F.col("page_id")
    host = F.regexp_replace("url", "^https?:", "")
    html = _case(
        n, F.concat(F.lit('<p class="c"><a title="t" href="'), u, F.lit('">x &amp; y</a><br><!-- c --></p>')), F.concat(F.lit("<p>a</p><script>"), u, F.lit("</script>")),
        F.concat(F.lit('<a href="javascript:'), u, F.lit('">x</a>')), F.concat(F.lit('<td colspan="00'), n + 1, F.lit('">z')), F.concat(F.lit('<p onclick="'), u, F.lit('">x</p>')),
        F.concat(F.lit('<a href="'), host, F.lit('">x</a>')), F.concat(F.lit('<img src="i/'), n, F.lit('.png" alt="a">')), F.concat(F.lit('<img src="'), u, F.lit('">')),
    )
    return markup.apply_html_policy(read(spark, sf_dir, "pages").select("page_id", html.alias("html")), "html").select("page_id", "safe", "rejected")


def _docs(spark, sf_dir) -> DataFrame:
    """Markdown documents: front matter, headings with and without identifiers, links of every form, tables, code, math."""
    n, u = F.col("page_id"), F.col("url")
    head = _case(n, F.concat(F.lit("---\ntitle: Front "), n, F.lit("\n---\n\n# Other\n\n")), F.concat(F.lit("intro\n\n# Head *"), n, F.lit("*\n\n")), F.lit("no heading\n\n"))
    body = _case(
        n, F.concat(F.lit("See [the [very] page]("), u, F.lit(' "t").\n')), F.concat(F.lit("See [the page][Ref] and [ref].\n\n[ref]: "), u, F.lit("\n")), F.concat(F.lit("See <"), u, F.lit("> or `[no]("), u, F.lit(")`.\n")),
        F.concat(F.lit("| a | b |\n|:-:|---|\n| [x]("), u, F.lit(") | ![i](p.png) |\n")), F.concat(F.lit("```\n[no]("), u, F.lit(")\n```\n\n$x^2$ and [![i](q.png)]("), u, F.lit(")\n")),
    )
    tail = F.concat(F.lit("\n## Part {#p"), n, F.lit("}\n\n## Same\n\n## Same\n"))
    return read(spark, sf_dir, "pages").select(n.alias("doc"), F.concat(head, body, tail).alias("text"))


@query("select page_id as doc, case page_id % 3 when 0 then 'Front ' || page_id when 1 then 'Head ' || page_id else 'Part' end as title from pages")
def o12_titles(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return markup.titles(docs, markup.flatten(docs))


@query(
    """select page_id as doc, 'link' as kind, url as target from pages union all select page_id, 'link', url from pages where page_id % 5 = 1
    union all select page_id, 'image', case page_id % 5 when 3 then 'p.png' else 'q.png' end from pages where page_id % 5 in (3, 4)"""
)
def t1_references(spark, sf_dir):
    return markup.references(markup.flatten(_docs(spark, sf_dir))).select("doc", "kind", "target")


@query(
    """select page_id as doc, 'p' || page_id as anchor from pages union all select page_id, 'same' from pages union all select page_id, 'same-2' from pages
    union all select page_id, 'other' from pages where page_id % 3 = 0 union all select page_id, 'head-' || page_id from pages where page_id % 3 = 1"""
)
def t2_anchors(spark, sf_dir):
    return markup.anchors(markup.flatten(_docs(spark, sf_dir)))


@query("select page_id as doc, 'x' as text, 'center' as side from pages where page_id % 5 = 3 union all select page_id, 'i', null from pages where page_id % 5 = 3")
def t4_table_cells(spark, sf_dir):
    return markup.flatten(_docs(spark, sf_dir)).where("kind = 'cell'").select("doc", "text", F.col("target").alias("side"))


@query("select page_id as doc, page_id % 5 = 4 as math from pages")
def t13_math(spark, sf_dir):
    return markup.has_math(markup.flatten(_docs(spark, sf_dir)))


@query("select page_id as doc, 2 as level, 'Part' as text, 'p' || page_id as identifier from pages union all select page_id, 2, 'Same', null from pages, range(2) union all select page_id, 1, case when page_id % 3 = 0 then 'Other' else 'Head ' || page_id end, null from pages where page_id % 3 < 2")
def t14_headings(spark, sf_dir):
    return markup.headings(markup.flatten(_docs(spark, sf_dir))).select("doc", "level", "text", "identifier")


@query("select conv_id as doc, string_agg('Turn ' || turn || ' &x', ' ' order by turn) as text from conversations group by conv_id")
def x14_plain_text(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda n: F.concat(F.lit("Turn **"), n.cast("string"), F.lit("** [&amp;x](b.md)"))), "\n\n").alias("text"))
    return markup.plain_text(markup.flatten(t.select(F.col("conv_id").alias("doc"), "text")))


@query(
    """with e as (select event_id as doc, event_id % 3 as k, user_id from events where event_id % 50 = 0 or true)
    select doc, 0 as cell, case k when 0 then 'r' when 1 then 'python' else 'julia' end as language, case when k = 1 then 'fig' || user_id else '' end as label,
    case k when 0 then 'eval=FALSE@1,echo=false@2' when 1 then '' else 'eval=true@2' end as options from e"""
)
def t7_cells(spark, sf_dir):
    n = F.col("event_id")
    text = _case(n, F.lit("a\n\n```{r, eval=FALSE}\n#| echo: false\nx\n```\n"), F.concat(F.lit("```{python fig"), "user_id", F.lit("}\nx\n```\n\n```python\nno\n```\n")), F.lit("~~~{julia}\n#| eval: true\nx\n~~~\n"))
    found = markup.cells(read(spark, sf_dir, "events").select(n.alias("doc"), text.alias("text")))
    shown = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit("="), o["value"], F.lit("@"), o["tier"].cast("string"))), ",")
    return found.select("doc", "cell", "language", "label", shown.alias("options"))


@query(
    """with p as (select page_id, page_id % 4 as k from pages) select 'w' as project, 'p' || page_id || '.md' as path, case k when 0 then 'top' || chr(10) || chr(10) || 'part ' || page_id || chr(10) || 'end'
    when 1 then 'x' || chr(10) || chr(10) || '```' || chr(10) || 'two' || chr(10) || '```' when 2 then 'loop' || chr(10) else 'y' || chr(10) || chr(10) end as text,
    case k when 2 then 'cycle' when 3 then 'missing' end as problem from p"""
)
def t9_includes(spark, sf_dir):
    n = F.col("page_id")
    path = F.concat(F.lit("p"), n, F.lit(".md"))
    text = _case(n, F.concat(F.lit("top\n\n{{< include parts/q"), n, F.lit(".md >}}")), F.lit("x\n\n{{< code /code.py#L2-L2 >}}"), F.concat(F.lit("loop\n\n{{< include p"), n, F.lit(".md >}}")), F.lit("y\n\n{{< include gone.md >}}\n"))
    pages = read(spark, sf_dir, "pages").select(F.lit("w").alias("project"), path.alias("path"), text.alias("text"))
    parts = read(spark, sf_dir, "pages").select(F.lit("w").alias("project"), F.concat(F.lit("parts/q"), n, F.lit(".md")).alias("path"), F.concat(F.lit("part "), n, F.lit("\nend")).alias("text"))
    code = spark.range(1).select(F.lit("w").alias("project"), F.lit("code.py").alias("path"), F.lit("one\ntwo\nthree\n").alias("text"))
    found = markup.expand_includes(pages.unionAll(parts).unionAll(code), pages.select("project", "path"))
    return found.select("project", "path", "text", F.split_part(F.get("problems", F.lit(0)), F.lit(": "), F.lit(2)).alias("problem"))


@query(
    """with r as (select c_custkey as ref, c_custkey % 7 as k, c_nationkey as n from customer)
    select ref, case k when 0 then 'external' when 2 then 'anchor' when 4 then case when n < 20 then 'page' end when 5 then 'asset' end as kind,
    case k when 1 then 'unsafe-url' when 3 then 'missing-anchor' when 4 then case when n >= 20 then 'ambiguous-page' end when 6 then 'missing-target' end as problem from r"""
)
def j4_resolve_links(spark, sf_dir):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    none = F.lit(None).cast("string")
    refs = read(spark, sf_dir, "customer").select(
        c.alias("ref"), F.lit("d").alias("doc"), _case(c, F.lit("https://x/"), F.lit("data:x"), F.lit("#a"), F.lit("#zz"), F.concat(F.lit("n"), n, F.lit(".md")), F.lit("i.png"), F.lit("gone")).alias("spelling"),
        _case(c, none, none, none, none, F.concat(F.lit("n"), n, F.lit(".md")), F.lit("i.png"), F.lit("gone")).alias("path"), _case(c, none, none, F.lit("a"), F.lit("zz"), none, none, none).alias("fragment"),
    )
    anchors = spark.createDataFrame([("d", "a")], "doc string, anchor string")
    nations = read(spark, sf_dir, "nation")
    page = nations.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".md")).alias("path"), F.concat(F.lit("n"), "n_nationkey").alias("page"))
    pages = page.unionAll(page.where("cast(substring(page, 2) as int) >= 20").withColumn("page", F.concat("page", F.lit("b"))))
    found = links.resolve_links(refs, anchors, pages, spark.createDataFrame([("i.png", "9")], "path string, digest string"), spark.createDataFrame([("s.c",)], "path string"))
    return found.select("ref", "kind", "problem")


@query("select c_custkey as ref, case when c_custkey % 3 = 0 then '#f' when c_nationkey = 3 then '' else '../' || 'n' || c_nationkey || '/index.html' end || case when c_custkey % 3 = 1 then '#f' else '' end as url from customer where not (c_custkey % 3 = 0 and c_nationkey <> 3)")
def m4_target_urls(spark, sf_dir):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    route = F.concat(F.lit("n"), "n_nationkey", F.lit("/index.html"))
    routes = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("page"), route.alias("route"))
    rows = read(spark, sf_dir, "customer").where("not (c_custkey % 3 = 0 and c_nationkey <> 3)")
    refs = rows.select(c.alias("ref"), F.lit("n3/index.html").alias("from_route"), F.concat(F.lit("n"), n).alias("page"), F.when(c % 3 < 2, "f").alias("fragment"))
    return links.target_urls(refs, routes).select("ref", "url")


@query(
    """with e as (select case when page_id % 2 = 0 then 'documents' else 'assets' end as section, 'k' || page_id as key, case page_id % 5 when 0 then '/same' when 1 then 'x y' else 'https://h/' || page_id end as d, page_id % 7 = 0 as unknown from pages)
    select 'unknown-key' as code, key from e where unknown union all select 'shared-destination', key from e where d in (select d from e group by d having count(*) > 1) union all select 'bad-destination', key from e where d = 'x y'"""
)
def c10_url_map_violations(spark, sf_dir):
    n = F.col("page_id")
    pages = read(spark, sf_dir, "pages")
    section, key = F.when(n % 2 == 0, "documents").otherwise("assets").alias("section"), F.concat(F.lit("k"), n).alias("key")
    entries = pages.select(section, key, F.when(n % 5 == 0, "/same").when(n % 5 == 1, "x y").otherwise(F.concat(F.lit("https://h/"), n)).alias("destination"))
    return links.url_map_violations(entries, pages.where("page_id % 7 <> 0").select(section, key))


@query(
    """with l as (select c_custkey as text, c_custkey % 5 as k, c_nationkey as n from customer) select 'empty-text' as code, ' ' as text, 'n' || n as target from l where k = 0
    union all select 'too-deep', 't' || text, 'n' || n from l where k = 1 union all select 'missing-page', case when k = 0 then ' ' else 't' || text end, 'n' || n from l where n % 3 = 0"""
)
def c14_sidebar_violations(spark, sf_dir):
    c = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(F.when(c % 5 == 0, " ").otherwise(F.concat(F.lit("t"), c)).alias("text"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.when(c % 5 == 1, 7).otherwise(6).alias("depth"))
    pages = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("route"), (F.col("n_nationkey") % 3 != 0).alias("visible"))
    return links.sidebar_violations(rows, pages)


@query("select p_partkey as part, p_size % 3 = 0 or p_size % 5 = 0 as reserved from part")
def f8_reserved_paths(spark, sf_dir):
    size = F.col("p_size")
    path = F.concat(F.when(size % 3 == 0, "a/.git/").when(size % 5 == 0, "gen/out/").otherwise("general/"), "p_partkey")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), links.reserved(path, [".git"], "gen/out").alias("reserved"))


@query(
    """with c as (select conv_id, turn, role, coalesce(text, '') as text, max(turn) over (partition by conv_id) as last from conversations),
    b as (select conv_id, max(turn) as b from c where turn % 5 = 4 and (turn % 2 <> 0 or turn < last) group by conv_id),
    s as (select c.*, row_number() over (partition by c.conv_id order by turn) - row_number() over (partition by c.conv_id, role order by turn) as g from c left join b using (conv_id) where turn % 5 <> 4 and turn > coalesce(b, -1)),
    o as (select conv_id, role, min(turn) as first, string_agg(text, '' order by turn) as payload from s group by conv_id, role, g)
    select 'p' || conv_id % 50 as page, conv_id as cell, cast(row_number() over (partition by conv_id order by first) - 1 as varchar) as position, role as name, payload, cast(null as varchar) as problem from o
    union all select 'p' || conv_id % 50, conv_id, null, null, 'd' || conv_id, 'unknown-display' from c where turn = 0"""
)
def w6_reduced_outputs(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    page, cell = F.concat(F.lit("p"), F.col("conv_id") % 50).alias("page"), F.col("conv_id").alias("cell")
    none = F.lit(None).cast("string")
    events = turns.select(
        page, (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), cell, F.when(F.col("turn") % 5 == 4, "clear").otherwise("stream").alias("kind"), F.col("role").alias("name"),
        F.coalesce("text", F.lit("")).alias("payload"), none.alias("display_id"), (F.col("turn") % 2 == 0).alias("wait"),
    )
    lost = turns.where("turn = 0").select(page, (F.col("conv_id") * 1000 + 999).alias("seq"), cell, F.lit("update").alias("kind"), none.alias("name"), F.lit("x").alias("payload"), F.concat(F.lit("d"), "conv_id").alias("display_id"), F.lit(False).alias("wait"))
    return outputs.reduce_outputs(events.unionAll(lost)).select("page", "cell", F.col("position").cast("string").alias("position"), "name", "payload", "problem")


@query(
    """with e as (select user_id, ts, lag(ts) over (order by ts) as before from events), s as (select *, sum(case when before is null or ts > before + interval 60 seconds then 1 else 0 end) over (order by ts rows unbounded preceding) as g from e)
    select min(ts) as start, array_to_string(list_sort(list(distinct 'u' || user_id)), ',') as paths from s group by g"""
)
def w1_settled_changes(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.lit("s").alias("state"), F.col("ts").alias("at"))
    return debounce.settled_changes(log, 60_000).select("start", F.array_join("paths", ",").alias("paths"))


@query(
    """with e as (select 'u' || user_id as path, event_type || value as state, ts, ts > lag(ts) over (partition by user_id order by ts) + interval 1 hour as apart from events),
    s as (select *, sum(case when coalesce(apart, true) then 1 else 0 end) over (partition by path order by ts) as g from e)
    select path, min(ts) as start, max(ts) as last, count(*) as changes, max_by(state, ts) as state from s group by path, g"""
)
def w1_path_bursts(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.concat("event_type", F.col("value").cast("string")).alias("state"), F.col("ts").alias("at"))
    return debounce.path_bursts(log, 3_600_000)


@query(
    """with e as (select event_id as seq, 'p' || user_id % 20 as page, event_id % 7 as cell, 'd' || user_id % 90 as display_id, case event_id % 5 when 0 then 'update' when 4 then 'clear' else 'display' end as kind, value as v, event_id % 3 = 0 as wait from events),
    o as (select *, max(seq) over (partition by page, cell) as final from e where kind = 'display'),
    c as (select e.page, e.cell, max(e.seq) as cleared from e left join (select page, cell, max(seq) as final from o group by all) f using (page, cell) where kind = 'clear' and (not wait or e.seq < f.final) group by all),
    u as (select page, display_id, max(seq) as seq, max_by(v, seq) as v from e where kind = 'update' group by all),
    kept as (select o.*, row_number() over (partition by o.page, o.cell order by o.seq) - 1 as position from o left join c using (page, cell) where o.seq > coalesce(cleared, -1)),
    births as (select o.page, o.display_id, o.seq, min(k.at) as gone from o left join (select x.page, x.cell, x.seq as clear, case when x.wait then (select min(y.seq) from o y where y.page = x.page and y.cell = x.cell and y.seq > x.seq) else x.seq end as at
      from e x where x.kind = 'clear') k on k.page = o.page and k.cell = o.cell and k.clear > o.seq group by o.page, o.display_id, o.seq)
    select k.page, cast(k.cell as bigint) as cell, cast(position as integer) as position, cast(case when u.seq > k.seq then u.v else k.v end as varchar) as payload, cast(null as varchar) as problem from kept k left join u using (page, display_id)
    union all select page, cell, null, display_id, 'unknown-display' from e where kind = 'update' and not exists (select 1 from births b where b.page = e.page and b.display_id = e.display_id and b.seq < e.seq and (b.gone is null or b.gone > e.seq))"""
)
def j17_display_updates(spark, sf_dir):
    i, none = F.col("event_id"), F.lit(None).cast("string")
    events = read(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), F.col("user_id") % 20).alias("page"), i.alias("seq"), (i % 7).alias("cell"), F.when(i % 5 == 0, "update").when(i % 5 == 4, "clear").otherwise("display").alias("kind"), none.alias("name"),
        F.col("value").cast("string").alias("payload"), F.concat(F.lit("d"), F.col("user_id") % 90).alias("display_id"), (i % 3 == 0).alias("wait"),
    )
    return outputs.reduce_outputs(events).select("page", "cell", "position", "payload", "problem")


@query(
    """select 'd' || d.doc_id as path, case when l.doc_id is null then 'missing' else sha256(cast(l.toxic as varchar)) end as state from documents d left join labels l using (doc_id)"""
)
def w4_observe(spark, sf_dir):
    path = F.concat(F.lit("d"), "doc_id").alias("path")
    files = read(spark, sf_dir, "labels").select(path, F.col("toxic").cast("string").cast("binary").alias("content"))
    return watch.observe(files, read(spark, sf_dir, "documents").select(path))


@query("select l.doc_id as path, l.toxic::varchar as stamp, case when d.doc_id is not null then 'd' || d.n_chars end as digest from labels l left join documents d on d.doc_id = l.doc_id and d.n_chars % 2 = l.toxic")
def w5_reuse_digests(spark, sf_dir):
    listing = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("toxic").cast("string").alias("stamp"))
    known = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), (F.col("n_chars") % 2).cast("string").alias("stamp"), F.concat(F.lit("d"), "n_chars").alias("digest"))
    return watch.reuse_digests(listing, known).select("path", "stamp", "digest")


@query("select doc_id as path, case when doc_id % 4 = 0 then 'added' else 'modified' end as change from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id and l.quality = documents.n_chars % 2)")
def w2_unacknowledged(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    changes = docs.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 4 == 0, "added").otherwise("modified").alias("change"))
    now = docs.select(F.col("doc_id").alias("path"), (F.col("n_chars") % 2).cast("string").alias("state"))
    written = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("quality").cast("string").alias("state"))
    return watch.unacknowledged(changes, now, written)


@query(
    """select l.doc_id, cast(row_number() over (partition by l.quality order by d.lang nulls last, d.n_chars nulls last, l.doc_id) as bigint) as position
    from labels l left join (select doc_id + 50 as doc_id, lang, n_chars from documents) d using (doc_id)"""
)
def o2_missing_last(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") + 50).alias("doc_id"), "lang", "n_chars")
    rows = read(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id", "left")
    w = Window.partitionBy("quality").orderBy(*tables.missing_last("lang", "n_chars", "doc_id"))
    return rows.select("doc_id", F.row_number().over(w).cast("bigint").alias("position"))


@query(
    """with p as (select page_id, regexp_replace(url, '^https?://', '') || case when page_id % 3 = 0 then '/index.html' else '' end as path from pages)
    select case when contains(path, '/') then split_part(path, '/', 1) else '' end as grp, path, row_number() over (partition by case when contains(path, '/') then split_part(path, '/', 1) else '' end order by not ends_with(path, 'index.html'), path) - 1 as position from p"""
)
def a3_navigation_groups(spark, sf_dir):
    end = F.when(F.col("page_id") % 3 == 0, "/index.html").otherwise("")
    pages = read(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "^https?://", ""), end).alias("path"))
    return tables.navigation_groups(pages)


@query(
    """with t as (select regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') as title, lpad(cast(doc_id as varchar), 8, '0') as route from documents)
    select title, count(*) as n, string_agg(route, ', ' order by route) as routes from t group by title having count(*) > 1"""
)
def a1_duplicate_titles(spark, sf_dir):
    return tables.duplicate_titles(read(spark, sf_dir, "documents").select(F.col("text").alias("title"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("route")))


@query(
    """with t as (select s_suppkey as id, case s_suppkey % 6 when 0 then 'x' || s_suppkey when 1 then '' when 2 then 'index' when 3 then 'a--b' || s_suppkey when 4 then 'n' || s_nationkey else 'Z.y_z' || s_suppkey end as s from supplier)
    select id, case when s in ('', 'index') or count(*) over (partition by s) > 1 then case when s = '' then 'topic' else s end || '-' || sha256(cast(id as varchar)) else s end as file from t"""
)
def m10_topic_routes(spark, sf_dir):
    s = F.col("s_suppkey")
    stem = _case(s, F.concat(F.lit("-.x"), s, F.lit("-.")), F.lit("-()"), F.lit("index"), F.concat(F.lit("a()b"), s), F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("Z.y_z"), s, F.lit("é")))
    topics = read(spark, sf_dir, "supplier").select(s.cast("string").alias("id"), stem.alias("stem"))
    return site.topic_routes(topics).select(F.col("id").cast("bigint").alias("id"), "file")


@query("select c_nationkey as package, c_custkey as item, c_mktsegment as name, row_number() over (partition by c_nationkey order by c_mktsegment, c_custkey) - 1 as position from customer where c_custkey % 3 <> 0 and c_custkey % 5 <> 0")
def o5_topic_index(spark, sf_dir):
    c = F.col("c_custkey")
    items = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("package"), c.alias("item"), F.col("c_mktsegment").alias("name"), (c % 3 != 0).alias("discoverable"), F.when(c % 5 == 0, c + 1).when(c % 2 == 0, c).alias("primary"))
    return site.topic_index(items).select("package", "item", "name", F.col("position").cast("bigint").alias("position"))


@query("select 'old/' || c_custkey as source, '/docs/old/' || c_custkey || ' /docs/' || c_mktsegment || '.html 301' as line from customer")
def k6_redirect_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("old/"), "c_custkey").alias("source"), F.concat("c_mktsegment", F.lit(".html")).alias("target"))
    return site.redirect_lines(rows, "/docs/")


@query("""select 'c' || c_custkey as path, '{"title":"' || c_mktsegment || '","path":"c' || c_custkey || '","package":"' || c_nationkey || '","ecosystem":' || case when c_nationkey % 2 = 0 then '"r"' else 'null' end || ',"api":false,"text":"t"}' as line from customer""")
def k4_search_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("title"), F.concat(F.lit("c"), "c_custkey").alias("path"), F.col("c_nationkey").cast("string").alias("package"), F.when(F.col("c_nationkey") % 2 == 0, "r").alias("ecosystem"), F.lit(False).alias("api"), F.lit("t").alias("text")
    )
    return site.search_lines(rows)


@query(
    """with h as (select c_nationkey as n, '[' || string_agg('{"level":2,"anchor":"a' || c_custkey || '","text":"' || c_mktsegment || '"}', ',' order by c_custkey) || ']' as hs from customer where c_custkey % 10 = 0 group by c_nationkey)
    select 'n' || n_nationkey || '.html' as path, '{"path":"n' || n_nationkey || '.html","markdown_path":"n' || n_nationkey || '.md","url":"' || case when n_nationkey < 3 then '/mapped' || n_nationkey else '/n' || n_nationkey end || '","title":"' || n_name || '","package":"r' || n_regionkey
    || '","package_version":' || case when n_regionkey < 4 then '"1.' || n_regionkey || '"' else 'null' end || ',"qualified_name":null,"public_name":null,"visible":true,"identities":["page:n' || n_nationkey || '"],"headings":' || coalesce(hs, 'null') || '}' as document from nation left join h on n = n_nationkey"""
)
def k7_fragment_index(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    route, none = F.concat(F.lit("n"), "n_nationkey", F.lit(".html")).alias("route"), F.lit(None).cast("string")
    pages = n.select(route, F.concat(F.lit("/n"), "n_nationkey").alias("url"), F.col("n_name").alias("title"), F.concat(F.lit("r"), "n_regionkey").alias("package"), none.alias("qualified_name"), none.alias("public_name"), F.lit(True).alias("visible"))
    packages = read(spark, sf_dir, "region").where("r_regionkey < 4").select(F.concat(F.lit("r"), "r_regionkey").alias("package"), F.concat(F.lit("1."), "r_regionkey").alias("version"))
    heads = read(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("n"), "c_nationkey", F.lit(".html")).alias("route"), F.col("c_custkey").alias("ord"), F.lit(2).alias("level"), F.concat(F.lit("a"), "c_custkey").alias("anchor"), F.col("c_mktsegment").alias("text"))
    mapped = n.where("n_nationkey < 3").select(F.lit("documents").alias("section"), route.alias("key"), F.concat(F.lit("/mapped"), "n_nationkey").alias("destination"))
    return site.fragment_index(pages, packages, heads, n.select(route, F.concat(F.lit("page:n"), "n_nationkey").alias("identity")), mapped)


@query("select c_nationkey as route, 'old' || c_custkey as alias, c_mktsegment as target from customer where c_mktsegment <> 'BUILDING' and c_custkey % 4 <> 0")
def m7_fragment_targets(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    aliases = c.select(F.col("c_nationkey").alias("route"), F.concat(F.lit("old"), "c_custkey").alias("alias"), F.col("c_mktsegment").alias("target"))
    present = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_nationkey").alias("route"), F.col("c_mktsegment").alias("identifier"))
    taken = c.where("c_custkey % 4 = 0").select(F.col("c_nationkey").alias("route"), F.concat(F.lit("old"), "c_custkey").alias("identifier"))
    return site.fragment_targets(aliases, present.unionAll(taken))


@query(
    """with m as (select s_suppkey % 8 as concept, s_suppkey as item, 's' || s_suppkey // 2 || '.html' as route from supplier)
    select distinct a.route, a.concept, b.route as target, 'P: q' || b.item as text, case when a.concept % 2 = 0 then 'Same API in' else 'Related API' end as label from m a join m b using (concept) where a.route <> b.route"""
)
def j20_concept_links(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier")
    concepts = rows.select((s % 8).alias("concept"), F.when(s % 2 == 0, "equivalent").otherwise("related").alias("kind"), F.lit("p").alias("package"), s.alias("item"))
    routes = rows.select(F.lit("p").alias("package"), s.alias("item"), F.concat(F.lit("s"), (s / 2).cast("int"), F.lit(".html")).alias("route"), F.lit("P").alias("package_name"), F.concat(F.lit("q"), s).alias("name"))
    return site.concept_links(concepts, routes)


@query(
    """with p as (select c_custkey as route, c_mktsegment as title, '/c' || c_custkey as url, case when c_custkey % 2 = 0 then 'd' end as d from customer)
    select route, 'og:type' as property, 'website' as content from p union all select route, 'og:title', title from p union all select route, 'og:site_name', 'S' from p union all select route, 'og:url', url from p
    union all select route, 'og:image', '/i.png' from p union all select route, 'og:image:type', 'image/png' from p union all select route, 'og:image:width', '1200' from p union all select route, 'og:image:height', '630' from p
    union all select route, 'og:image:alt', 'A' from p union all select route, 'og:description', d from p where d is not null"""
)
def m9_social_metadata(spark, sf_dir):
    pages = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route"), F.col("c_mktsegment").alias("title"), F.concat(F.lit("/c"), "c_custkey").alias("url"), F.when(F.col("c_custkey") % 2 == 0, "d").alias("description"))
    return site.social_metadata(pages, "S", "/i.png", "image/png", 1200, 630, "A").select("route", "property", "content")


@query(
    """with p as (select s_suppkey as k, ['r', 'python', 'julia', 'rust', 'cpp', 'other'][s_suppkey % 6 + 1] as e from supplier)
    select 'p' || k as package, 'Package=N' || k || ';Language=' || case e when 'r' then 'R' when 'python' then 'Python' when 'julia' then 'Julia' when 'rust' then 'Rust' when 'cpp' then 'C++' else e end || case when k % 2 = 0 then ';Version=1.' || k else '' end as fields from p"""
)
def m11_package_overview(spark, sf_dir):
    s, none = F.col("s_suppkey"), F.lit(None).cast("string")
    rows = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("p"), s).alias("package"), F.concat(F.lit("N"), s).alias("name"), _case(s, *map(F.lit, ("r", "python", "julia", "rust", "cpp", "other"))).alias("ecosystem"),
        F.when(s % 2 == 0, F.concat(F.lit("1."), s)).alias("version"), none.alias("license"), none.alias("description"), none.alias("authors"),
    )
    shown = F.array_join(F.transform("fields", lambda f: F.concat(f["label"], F.lit("="), f["value"])), ";")
    return site.package_overview(rows).select("package", shown.alias("fields"))


@query(
    """with p as (select s_suppkey as k, ['r', 'python', 'julia', 'rust', 'cpp'][s_suppkey % 5 + 1] as e from supplier)
    select k as package, 'n' || k as name, 'v' || k as version, case e when 'r' then case when k % 2 = 0 then 'd' else 't' || k end when 'julia' then 'j' else 'p' end as description, case e when 'cpp' then null when 'julia' then 'jl' else 'l' end as license from p"""
)
def x28_common_metadata(spark, sf_dir):
    s = F.col("s_suppkey")
    name, version = F.concat(F.lit("n"), s).alias("name"), F.concat(F.lit("v"), s).alias("version")
    plain = F.to_json(F.struct(name, version, F.lit("p").alias("description"), F.lit("l").alias("license")))
    r = F.to_json(F.struct(F.struct(name, version, F.concat(F.lit("t"), s).alias("title"), F.when(s % 2 == 0, "d").alias("description"), F.lit("l").alias("license")).alias("description")))
    julia = F.to_json(F.struct(name, version, F.struct(F.struct(F.lit("j").alias("value")).alias("description"), F.struct(F.lit("jl").alias("value")).alias("license")).alias("fields")))
    rows = read(spark, sf_dir, "supplier").select(s.alias("package"), _case(s, *map(F.lit, ("r", "python", "julia", "rust", "cpp"))).alias("ecosystem"), _case(s, r, plain, julia, plain, plain).alias("metadata"))
    return records.common_metadata(rows)


@query("select c_custkey as path, c_custkey % 3 = 0 and c_custkey % 2 = 0 as generated from customer")
def q8_generated_files(spark, sf_dir):
    from ..sources.database import BUNDLE_ID

    c = F.col("c_custkey")
    held = F.when(c % 2 == 0, F.array(F.lit("records"), F.lit("assets"), F.lit("manifest"))).otherwise(F.array(F.lit("records")))
    return records.generated_files(read(spark, sf_dir, "customer").select(c.alias("path"), F.when(c % 3 == 0, BUNDLE_ID).when(c % 3 == 1, 7).alias("application_id"), held.alias("tables")))


@query(
    """with o as (select r_name as output from region), i as (select r_name || '/' || n_name as path from nation join region on r_regionkey = n_regionkey where n_nationkey % 2 = 0 union select 'ASIA' union select 'cache'),
    k as (select 'AFRICA/cache/x' as path union select 'cache')
    select output, path from o join (select path from i union select path from k) p on p.path = o.output or starts_with(p.path, o.output || '/')"""
)
def k13_output_overlaps(spark, sf_dir):
    region = read(spark, sf_dir, "region")
    nations = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"))
    inputs = nations.unionAll(spark.createDataFrame([("ASIA",), ("cache",)], "path string"))
    return site.output_overlaps(region.select(F.col("r_name").alias("path")), inputs, spark.createDataFrame([("AFRICA/cache/x",), ("cache",)], "path string"))


@query("select 'https://x/n' || c_nationkey as url, string_agg(route, ',' order by route) as routes from (select c_nationkey, case when c_custkey % 2 = 0 then 'n' || c_nationkey || '.html' else 'n' || c_nationkey end as route, c_custkey from customer) group by c_nationkey having count(*) > 1")
def c8_canonical_violations(spark, sf_dir):
    n = F.concat(F.lit("n"), "c_nationkey")
    pages = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(n, F.lit(".html"))).otherwise(n).alias("route"))
    return site.canonical_violations(site.canonical_urls(pages, "https://x/")).select("url", F.array_join("routes", ",").alias("routes"))


@query("select s_suppkey as page, s_nationkey as owner, s_nationkey % 3 <> 0 as visible from supplier")
def f3_visible_pages(spark, sf_dir):
    packages = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("package"), F.when(F.col("n_nationkey") % 3 == 0, "hidden").otherwise("shown").alias("visibility"))
    return site.visible_pages(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_nationkey").alias("owner")), packages)


@query("select c_custkey as id, case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then 'https://x/' || c_custkey || '/' when c_custkey % 4 = 2 then 'http://x/' else null end as site, case when c_custkey % 2 = 0 then 'python' else 'r' end as language from customer")
def x25_site_urls(spark, sf_dir):
    c = F.col("c_custkey")
    url = _case(c, F.lit("https://u@x/"), F.concat(F.lit("https://x/"), c), F.lit("http://x/"), F.lit("https://x/?q"))
    return read(spark, sf_dir, "customer").select(c.alias("id"), X.site_url(url).alias("site"), X.kernel_language(F.when(c % 2 == 0, "Python3").otherwise("R")).alias("language"))


@query("select p_partkey, ['image/png', 'application/manifest+json', 'text/plain; charset=utf-8', 'text/javascript; charset=utf-8', 'application/octet-stream'][p_partkey % 5 + 1] as media_type from part")
def x24_media_types(spark, sf_dir):
    names = _case(F.col("p_partkey"), *map(F.lit, ("a/b.png", "x.webmanifest", "t.txt", "m.mjs", "a.b/noext")))
    return read(spark, sf_dir, "part").select("p_partkey", X.media_type(names).alias("media_type"))
