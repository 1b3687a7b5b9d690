"""Queries of scalar functions, published files and caches, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.canonical import restricted_json
from ..operators import graphs, links, records, selection, site, tables
from ..sources import commits, database, files
from ..streaming import watch
from .documents import _case
from .lineage import shared_path
from .queries import query, read, record_table


@query(
    """select p_partkey, case p_partkey % 4 when 0 then '../b/x' || p_size || '.html' when 1 then 'x.html' when 2 then '../../c.html' else 'c/y.html' end as url from part"""
)
def x10_relative_url(spark, sf_dir):
    n = F.col("p_partkey")
    base = _case(n, F.lit("a/p.html"), F.lit("a/p.html"), F.lit("a/b/p.html"), F.lit("p.html"))
    target = _case(n, F.concat(F.lit("b/x"), "p_size", F.lit(".html")), F.lit("a/x.html"), F.lit("c.html"), F.lit("c/y.html"))
    return read(spark, sf_dir, "part").select("p_partkey", X.relative_url(base, target).alias("url"))


@query("select p_partkey, case p_partkey % 6 when 0 then 'a/c' || p_size when 1 then 'b' when 5 then 'x/y' end as path from part")
def x12_normal_path(spark, sf_dir):
    spelled = _case(F.col("p_partkey"), F.concat(F.lit("a/./b/../c"), "p_size"), F.lit("a/../b/"), F.lit("../a"), F.lit("/a"), F.lit("a\\b"), F.lit("x//y"))
    return read(spark, sf_dir, "part").select("p_partkey", X.normal_path(spelled).alias("path"))


@query("select p_partkey, 'x\\*\\[' || replace(p_brand, '#', '\\#') || '\\]\\(' || p_size || '\\)\\!' as escaped from part")
def x16_markdown_escape(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.markdown_escape(F.concat(F.lit("x*["), "p_brand", F.lit("]("), "p_size", F.lit(")!"))).alias("escaped"))


@query("select p_partkey, 'a�b' || chr(9) || p_size || '��' || chr(10) as safe, 'ab' || chr(9) || p_size || chr(10) as stripped from part")
def x17_control_characters(spark, sf_dir):
    raw = F.concat(F.lit("a\x07b\t"), "p_size", F.lit("\x1b\x9f\n"))
    coded = F.concat(F.lit("a\x1b[31m\x07b\t"), "p_size", F.lit("\x1b]0;title\x07\x9b1m\n"))
    return read(spark, sf_dir, "part").select("p_partkey", X.terminal_safe(raw).alias("safe"), X.strip_control_codes(coded).alias("stripped"))


@query("select p_partkey, p_partkey % 3 = 0 as valid from part")
def x22_valid_label(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.valid_label(_case(F.col("p_partkey"), F.lit("fig-1.a:b"), F.lit("1a"), F.lit("a b"))).alias("valid"))


@query("select p_partkey, case p_partkey % 4 when 0 then '{\"a\":' || p_size || ',\"b\":[null,true]}' when 3 then '-' || p_size end as json from part")
def x6_restricted_json(spark, sf_dir):
    size = F.col("p_size")
    text = _case(F.col("p_partkey"), F.concat(F.lit('{"a":'), size, F.lit(',"b":[null,true]}')), F.concat(F.lit('{"b":1,"a":'), size, F.lit("}")), F.concat(F.lit('{"a":'), size, F.lit(".5}")), F.concat(F.lit("-"), size))
    return read(spark, sf_dir, "part").select("p_partkey", restricted_json(text).alias("json"))


@query("select doc_id, case when lines >= 3 then list_extract(parts, 2) || chr(10) || list_extract(parts, 3) end as slice from (select doc_id, string_split(text, chr(10)) as parts, len(string_split(text, chr(10))) as lines from documents)")
def o13_line_slice(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("slice"))


@query("select c_custkey as id, case when c_nationkey % 2 = 0 then 'r' || c_nationkey || '/' else '' end || case when c_custkey % 3 = 0 then 'm/' else '' end || 's' || c_custkey || '.html' as route from customer")
def x13_routes(spark, sf_dir):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = read(spark, sf_dir, "customer").select(c.alias("id"), F.when(n % 2 == 0, F.concat(F.lit("r"), n)).otherwise("").alias("root"), F.when(c % 3 == 0, "m").otherwise("").alias("mount"), F.concat(F.lit("s"), c).alias("stem"))
    return site.routes(rows).select("id", "route")


@query("select case when c_custkey % 2 = 0 then 'page' else 'item' end as kind, cast(c_custkey as varchar) as id, case when c_custkey % 2 = 0 then 'pages/' else 'r' || c_nationkey || '/reference/' end || sha256(cast(c_custkey as varchar)) || '.html' as route from customer")
def m1_identity_routes(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "page").otherwise("item").alias("kind"), F.concat(F.lit("r"), "c_nationkey").alias("root"), F.col("c_custkey").cast("string").alias("id"))
    return site.identity_routes(rows).select("kind", "id", "route")


@query(
    """with a as (select case when s_suppkey % 3 = 0 then 'n' || s_nationkey || '/x' || s_suppkey when s_suppkey % 3 = 1 then 'free' || s_suppkey % 40 else 'top' end as path from supplier), t as (select 'n' || n_nationkey as path from nation where n_nationkey < 10 union select 'top/deep/page.html')
    select distinct 'occupied' as code, a.path from a join t on a.path = t.path or starts_with(a.path, t.path || '/') or starts_with(t.path, a.path || '/') union all select 'repeated', path from a group by path having count(*) > 1"""
)
def c13_asset_violations(spark, sf_dir):
    s = F.col("s_suppkey")
    assets = read(spark, sf_dir, "supplier").select(_case(s, F.concat(F.lit("n"), "s_nationkey", F.lit("/x"), s), F.concat(F.lit("free"), s % 40), F.lit("top")).alias("path"))
    taken = read(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.concat(F.lit("n"), "n_nationkey").alias("path")).unionAll(spark.range(1).select(F.lit("top/deep/page.html").alias("path")))
    return links.asset_violations(assets, taken)


@query(
    """with a as (select c_nationkey as route, 'a' || c_custkey as alias, c_custkey % 3 as n from customer) select route, alias, n from a where n <> 1"""
)
def c15_fragment_aliases(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    aliases = c.select(F.col("c_nationkey").alias("route"), F.concat(F.lit("a"), "c_custkey").alias("alias"))
    ids = c.where("c_custkey % 3 > 0").select(F.col("c_nationkey").alias("route"), F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 3).cast("int"))).alias("_n"), F.concat(F.lit("a"), "c_custkey").alias("identifier"))
    return links.fragment_alias_violations(aliases, ids.drop("_n"))


@query(
    """with k as (select c_custkey as key, c_custkey % 6 as k from customer) select key, k = 0 as hit, case k when 0 then null when 1 then 'no-entry' when 2 then 'no-inputs' when 3 then 'inputs-changed' when 4 then 'inputs-changed' else 'broken-payload' end as reason from k"""
)
def w7_cache_hits(spark, sf_dir):
    c = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer")
    entries = rows.where("c_custkey % 6 <> 1").select(c.alias("key"), F.when(c % 6 == 5, "{").otherwise(F.concat(F.lit('{"n":'), c, F.lit("}"))).alias("payload"))
    some = rows.where("c_custkey % 6 not in (1, 2)")
    here = some.select(c.alias("key"), F.concat(F.lit("n"), "c_nationkey").alias("path"), F.when(c % 6 == 3, "old").otherwise("now").alias("state"))
    gone = some.select(c.alias("key"), F.lit("gone").alias("path"), F.when(c % 6 == 4, "was").alias("state"))
    current = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("path"), F.lit("now").alias("state"))
    return watch.cache_hits(rows.select(c.alias("key")), entries, here.unionAll(gone), current).select("key", "hit", "reason")


@query("""select c_nationkey as page, sha256('recordloom/page-v1' || chr(0) || '{' || string_agg('"' || lpad(cast(c_custkey as varchar), 6, '0') || '":' || case when c_custkey % 4 = 0 then 'null' else '"' || c_mktsegment || '"' end, ',' order by c_custkey) || '}') as key from customer group by c_nationkey""")
def w8_page_keys(spark, sf_dir):
    parts = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("value"))
    return watch.page_keys(parts)


@query("select count(*) = 0 as ok from labels l left join documents d on d.doc_id = l.doc_id where l.quality is distinct from d.n_chars % 2")
def j18_inputs_match(spark, sf_dir):
    recorded = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("quality").cast("string").alias("state"))
    current = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), (F.col("n_chars") % 2).cast("string").alias("state"))
    return watch.inputs_match(recorded, current.join(recorded.select("path"), "path", "left_semi"))


@query(
    """with m as (select l_orderkey as owner, l_linenumber as id, case l_linenumber % 5 when 0 then 'field' when 1 then 'enumerator' when 2 then 'type-alias' else 'function' end as kind, l_linenumber % 7 as f, l_returnflag as name from lineitem),
    t as (select *, case when f = 0 then 'Overloads' else case kind when 'field' then 'Fields' when 'enumerator' then 'Values' when 'type-alias' then 'Types' else 'Methods' end end as title from m where f <> 6)
    select owner, title, id, row_number() over (partition by owner order by title, name, id) - 1 as position from t"""
)
def a5_titled_members(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("owner"), n.alias("id"), F.when(n % 5 == 0, "field").when(n % 5 == 1, "enumerator").when(n % 5 == 2, "type-alias").otherwise("function").alias("kind"),
        F.when(n % 7 == 0, F.col("l_orderkey").cast("string")).when(n % 7 == 6, "other").alias("family"), F.col("l_returnflag").alias("name"),
    )
    return tables.titled_members(rows).select(F.col("owner").cast("bigint").alias("owner"), "title", "id", F.col("position").cast("bigint").alias("position"))


@query(
    """with i as (select s_suppkey as k, 'p' as package, 'q' || s_suppkey as q, case when s_suppkey % 4 = 0 then 'r' else 'julia' end as e, s_suppkey % 5 <> 0 as documented from supplier), b as (select c_custkey as ordinal, c_custkey % 130 as k from customer)
    select ordinal, case when i.k is not null then 'i' || i.k end as item, case when i.k is null then 'unresolved' when e = 'r' then 'other-language' when not documented then 'undocumented' end as problem from b left join i using (k)"""
)
def f7_documentation_list(spark, sf_dir):
    s = F.col("s_suppkey")
    items = read(spark, sf_dir, "supplier").select(
        F.lit("p").alias("package"), F.concat(F.lit("i"), s).alias("item"), F.concat(F.lit("q"), s).alias("qualified_name"), F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("secondary"),
        F.when(s % 4 == 0, "r").otherwise("julia").alias("ecosystem"), (s % 5 != 0).alias("documented"),
    )
    entries = read(spark, sf_dir, "customer").select(F.lit("b").alias("block"), F.col("c_custkey").alias("ordinal"), F.lit("p").alias("owner"), F.lit("julia").alias("language"), F.concat(F.lit("q"), F.col("c_custkey") % 130).alias("target"))
    return selection.documentation_list(entries, items).select("ordinal", "item", "problem")


@query("select distinct 'n' || c_nationkey || '/c' || c_custkey as path, case when c_nationkey % 2 = 0 then 'n' || c_nationkey end as sidebar from customer")
def m6_sidebars(spark, sf_dir):
    pages = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey", F.lit("/c"), "c_custkey").alias("path"))
    roots = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("root"))
    return links.sidebar_for(pages.withColumnRenamed("path", "route"), roots.withColumnRenamed("root", "prefix")).select(F.col("route").alias("path"), F.col("prefix").alias("sidebar"))


@query("select case when page_id % 5 = 0 then 'src' else '' end as root, 'm' || page_id as module, page_id % 2 = 0 as stub from pages where page_id % 3 <> 0 union all select 'src', 'pkg' || page_id, false from pages where page_id % 3 = 0")
def s10_python_sources(spark, sf_dir):
    n = F.col("page_id")
    plain = F.concat(F.when(n % 5 == 0, "src/").otherwise(""), F.lit("m"), n, F.when(n % 2 == 0, ".pyi").otherwise(".py"))
    rows = read(spark, sf_dir, "pages").select(F.when(n % 3 != 0, plain).otherwise(F.concat(F.lit("src/pkg"), n, F.lit("/__init__.py"))).alias("relative"))
    return files.python_sources(rows, ["", "src"]).select("root", "module", "stub")


@query("select 'p' || s_nationkey as package, 'source' as kind, count(*) as n from supplier group by all union all select 'p' || s_nationkey, 'description', 1 from supplier group by s_nationkey")
def s11_r_sources(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    package = F.concat(F.lit("p"), "s_nationkey")
    rows = s.select(F.concat(package, F.lit("/R/f"), "s_suppkey", F.lit(".R")).alias("relative")).unionAll(s.select(F.concat(package, F.lit("/DESCRIPTION"))).distinct())
    lost = read(spark, sf_dir, "customer").select(F.concat(F.lit("none/R/f"), "c_custkey", F.lit(".R")).alias("relative"))
    return files.r_sources(rows.unionAll(lost)).groupBy("package", "kind").agg(F.count("*").alias("n"))


@query("select 'd' || d.doc_id as path, case when l.doc_id is not null then sha256(cast(l.quality as varchar)) end as digest from documents d left join labels l using (doc_id)")
def s14_manifest(spark, sf_dir):
    path = F.concat(F.lit("d"), "doc_id").alias("path")
    held = read(spark, sf_dir, "labels").select(path, F.col("quality").cast("string").cast("binary").alias("content"))
    return files.manifest(held, read(spark, sf_dir, "documents").select(path))


@query("select c_nationkey as folder, case when bool_or(c_mktsegment = 'BUILDING') then 'BUILDING' else 'MACHINERY' end as name from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by c_nationkey")
def s9_first_files(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("folder"), F.col("c_mktsegment").alias("name"), F.lit("x").alias("content")).distinct()
    return files.first_of(rows, ["BUILDING", "MACHINERY"]).select("folder", "name")


_ITEM = {"item": "lang string, n_chars bigint"}


@query("select source as owner, cast(doc_id as varchar) as id, lang, n_chars from documents")
def s3_decoded_items(spark, sf_dir):
    return records.decode(record_table(spark, sf_dir), _ITEM)["item"]


@query(
    """select case doc_id % 7 when 0 then 'no-object' when 1 then 'missing-field' else 'wrong-type' end as code, 'item' as kind, source as owner, cast(doc_id as varchar) as id from documents where doc_id % 7 < 3"""
)
def s3_decode_violations(spark, sf_dir):
    n = F.col("id").cast("bigint") % 7
    items = record_table(spark, sf_dir).where("kind = 'item'")
    spoiled = F.when(n == 0, F.lit("[1]")).when(n == 1, F.lit('{"lang":"x"}')).when(n == 2, F.lit('{"lang":"x","n_chars":"many"}')).otherwise(F.col("content"))
    return records.decode_violations(items.withColumn("content", spoiled), _ITEM, {"item": ["lang", "n_chars"]})


@query(
    """select 'p' || c_nationkey || '.f' || c_custkey as name, case when c_nationkey < 5 then 'x.y.n' || c_nationkey || '.f' || c_custkey when c_nationkey = 5 then 'end.f' || c_custkey else 'p' || c_nationkey || '.f' || c_custkey end as target from customer where c_nationkey <> 6
    union all select 'p5.f' || c_custkey, 'other.f' || c_custkey from customer where c_nationkey = 5"""
)
def g10_rewritten_names(spark, sf_dir):
    n = read(spark, sf_dir, "nation").where("n_nationkey < 5")
    p = F.concat(F.lit("p"), "n_nationkey")
    aliases = n.select(p.alias("alias"), F.concat(F.lit("q.n"), "n_nationkey").alias("target"))
    more = spark.createDataFrame([("q", "x.y"), ("p5", "end"), ("p5", "other"), ("p6", "r"), ("r", "p6")], "alias string, target string")
    names = read(spark, sf_dir, "customer").select(F.concat(F.lit("p"), "c_nationkey", F.lit(".f"), "c_custkey").alias("name"))
    return graphs.rewrite_names(names, aliases.unionAll(more))


@query("select source as owner, cast(doc_id as varchar) as id, '{\"lang\":\"' || lang || '\",\"digest\":\"' || sha256(text) || '\"}' as content from documents where source >= 'src3' and source < 'src8'")
def s2_snapshot_round_trip(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    records = docs.select(
        F.lit("item").alias("kind"), F.col("source").alias("owner"), F.col("doc_id").cast("string").alias("id"),
        F.to_json(F.struct("lang", F.sha2("text", 256).alias("digest"))).alias("content"), F.lit("").alias("fingerprint"),
    )
    path = shared_path(spark, "snapshot")
    database.write_snapshot({"records": records}, path, "recordloom")
    found = database.lookup(spark, path, slices=8, kind="item", owner_from="src3", owner_to="src8")
    return found.select("owner", "id", "content")


@query("select 'k' || c_custkey as key, c_mktsegment as payload from customer")
def k10_write_once(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("key"), F.col("c_mktsegment").alias("payload"))
    path, third = shared_path(spark, "cache"), F.pmod(F.xxhash64("key"), F.lit(3))
    for part in (third == 0, third <= 1, third >= 0):  # what is there already is not written again
        commits.put_once(rows.where(part), path)
    return commits.once(spark, path, rows.schema)
