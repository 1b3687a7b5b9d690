"""Queries of orders, names and versions at scale: cycles, frequent names, cascading suffixes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graphs, records, resolve, site, tables
from .queries import query, read, record_table


#: Customers in groups of ten. The first few of a group need each other in a ring (none, or two to five); the others
#: need the first; the first needs the last of a group with a tenth of the number.
_RINGS = """c as (select c_custkey as k, c_custkey // 10 as g, c_custkey % 10 as i, c_custkey // 10 % 5 + 1 as s from customer),
    e as (select k as src, g * 10 + (i + 1) % s as dst from c where i < s and s > 1 union all select k, g * 10 from c where i >= s union all select g * 10, g // 10 * 10 + 9 from c where i = 0 and g > 0)"""


def _rings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k.alias("k"), F.floor(k / 10).alias("g"), (k % 10).alias("i"), (F.floor(k / 10) % 5 + 1).alias("s"))
    ring = c.where("i < s and s > 1").select(F.col("k").alias("src"), F.expr("g * 10 + (i + 1) % s").alias("dst"))
    rest = c.where("i >= s").select(F.col("k").alias("src"), F.expr("g * 10").alias("dst"))
    up = c.where("i = 0 and g > 0").select(F.col("k").alias("src"), F.expr("g div 10 * 10 + 9").alias("dst"))
    return ring.unionAll(rest).unionAll(up), c.select(F.col("k").alias("node"), (-F.col("k")).alias("ord"))


@query(
    f"""with recursive {_RINGS}, both_ways as (select e.src, e.dst from e join c a on a.k = src join c b on b.k = dst), reach(src, dst) as (select src, dst from both_ways union select r.src, b.dst from reach r join both_ways b on b.src = r.dst),
    part as (select c.k, least(c.k, coalesce(min(r.dst), c.k)) as component from c left join (select x.src, x.dst from reach x join reach y on y.src = x.dst and y.dst = x.src) r on r.src = c.k group by c.k),
    up(component, level) as (select distinct component, 0 from part union select distinct p.component, up.level + 1 from both_ways b join part p on p.k = b.src join part q on q.k = b.dst join up on up.component = q.component where p.component <> q.component),
    high as (select component, max(level) as level from up group by component), first as (select component, min(-k) as f from part group by component)
    select k as node, component, level, row_number() over (order by level, f, component, -k) - 1 as position from part join high using (component) join first using (component)"""
)
def g5_order_with_cycles(spark, sf_dir):
    return graphs.order_with_cycles(*_rings(spark, sf_dir))


@query(
    """with items as (select 'p' || o_custkey % 50 as package, 'i' || o_orderkey as item, o_orderpriority as name from orders), known as (select package, name, case when count(distinct item) = 1 then min(item) end as item from items group by package, name),
    refs as (select event_id as ref, 'p' || user_id % 60 as owner, case event_id % 3 when 0 then '1-URGENT' when 1 then '5-LOW' else 'p' || event_id % 60 || '::2-HIGH' end as target from events),
    pk as (select distinct package from items), e as (select ref, split_part(target, '::', 1) as package, split_part(target, '::', 2) as name from refs where contains(target, '::') and split_part(target, '::', 1) in (select package from pk)),
    t0 as (select e.ref, k.item, k.name is not null as there from e left join known k using (package, name)), t1 as (select r.ref, k.item from refs r join known k on k.package = r.owner and k.name = r.target where r.ref not in (select ref from t0)),
    w as (select name, count(*) as n, min(item) as item from known group by name)
    select r.ref, coalesce(t0.item, t1.item, case when t0.ref is null and t1.ref is null and w.n = 1 then w.item end) as item,
      case when coalesce(t0.item, t1.item, case when t0.ref is null and t1.ref is null and w.n = 1 then w.item end) is not null then 'resolved' when coalesce(t0.there, false) or t1.ref is not null or (t0.ref is null and w.n >= 1) then 'ambiguous' else 'unresolved' end as status
    from refs r left join t0 using (ref) left join t1 using (ref) left join w on w.name = r.target"""
)
def j1_frequent_names(spark, sf_dir):
    o, e = read(spark, sf_dir, "orders"), read(spark, sf_dir, "events")
    items = o.select(
        F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("package"), F.concat(F.lit("i"), "o_orderkey").alias("item"), F.col("o_orderpriority").alias("qualified_name"),
        F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("secondary"),
    )
    n = F.col("event_id") % 3
    target = F.when(n == 0, "1-URGENT").when(n == 1, "5-LOW").otherwise(F.concat(F.lit("p"), F.col("event_id") % 60, F.lit("::2-HIGH")))
    refs = e.select(F.col("event_id").alias("ref"), F.concat(F.lit("p"), F.col("user_id") % 60).alias("owner"), target.alias("target"))
    return resolve.resolve_items(refs, items).select("ref", "item", "status")


@query(
    """with c as (select event_type as name, event_id // 10 as target, event_id % 4 as priority from events), b as (select name, min(priority) as p from c group by name), t as (select name, count(distinct target) as n, min(target) as target from c join b using (name) where priority = p group by name)
    select event_id as ref, case when n = 1 then target end as target, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unresolved' end as status from (select event_id, case when event_id % 3 = 0 then 'none' else event_type end as name from events) left join t using (name)"""
)
def j1_prioritised_frequent_names(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    candidates = e.select(F.col("event_type").alias("name"), F.expr("event_id div 10").alias("target"), (F.col("event_id") % 4).alias("priority"))
    refs = e.select(F.col("event_id").alias("ref"), F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.col("event_type")).alias("name"))
    return resolve.resolve_prioritised(refs, candidates)


@query(
    """with h as (select event_type as doc, event_id as ordinal from events), n as (select *, row_number() over (partition by doc order by ordinal) as i, count(*) over (partition by doc) as m from h)
    select doc, ordinal, case when i in (1, m) then 'a-2' else 'a' end as slug, case when i = 1 then 'a-2' when i = m then 'a-2-2' when i = 2 then 'a' else 'a-' || i end as identifier from n"""
)
def o10_slug_cascades(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("doc"), F.col("event_id").alias("ordinal"))
    ends = rows.groupBy("doc").agg(F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))
    slug = F.when(F.col("ordinal").isin(F.col("low"), F.col("high")), "a-2").otherwise("a")
    return tables.unique_slugs(rows.join(ends, "doc").select("doc", "ordinal", slug.alias("slug")))


@query(
    """with d as (select event_id, case when event_id % 4 > 0 then 'u' || user_id end as source, case when event_id % 3 > 0 then user_id % 10 end as span, event_type as code, case when value > 50 then 'error' end as severity from events)
    select event_id, row_number() over (order by source nulls last, span nulls last, code nulls last, severity nulls last, event_id) - 1 as position from d"""
)
def o2_diagnostic_order(spark, sf_dir):
    i, none = F.col("event_id"), F.lit(None).cast("string")
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.when(i % 4 > 0, F.concat(F.lit("u"), "user_id")).alias("source"), F.when(i % 3 > 0, F.col("user_id") % 10).alias("span"), F.col("event_type").alias("code"),
        F.when(F.col("value") > 50, "error").alias("severity"), i.alias("entity"), none.alias("message"), none.alias("related_spans"),
    )
    return tables.order_diagnostics(rows).select("event_id", "position")


@query(
    """with p as (select c_custkey as id, c_mktsegment as name, c_nationkey as n, case c_nationkey % 4 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end as rank from customer)
    select id, rank, row_number() over (order by rank, name, id) - 1 as position from p"""
)
def o3_package_order(spark, sf_dir):
    n = F.col("c_nationkey") % 4
    language = F.when(n == 0, "python").when(n == 1, "r").when(n == 2, "julia").otherwise("other")
    packages = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), language.alias("language"))
    return site.package_order(packages, ["python", "r", "julia"]).select("id", "rank", "position")


@query(
    """with r as (select 'document' as kind, '' as owner, '{"kind":"item","item":{"package":"' || source || '","item":"' || doc_id || '"}}' as id from documents union all select 'item', source, cast(doc_id as varchar) from documents union all select distinct 'package', '', source from documents)
    select kind, owner, id, row_number() over (order by kind, owner, id) - 1 as position from r"""
)
def o6_keyed_order(spark, sf_dir):
    return records.keyed_order(record_table(spark, sf_dir)).select("kind", "owner", "id", "position")


def _places(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    top = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), (-F.col("n_nationkey")).cast("long").alias("ord"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    edges = top.unionAll(c.select(F.concat(F.lit("n"), "c_nationkey"), "c_custkey", F.concat(F.lit("c"), "c_custkey")))
    return edges, read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_regionkey").alias("ord"))


@query(
    """with t as (select 'r' || r_regionkey as node, cast(null as varchar) as parent, 0 as depth, r_regionkey as a, null as b, null as c from region
      union all select 'n' || n_nationkey, 'r' || n_regionkey, 1, n_regionkey, -n_nationkey, null from nation union all select 'c' || c_custkey, 'n' || n_nationkey, 2, n_regionkey, -n_nationkey, c_custkey from customer join nation on n_nationkey = c_nationkey)
    select node, parent, depth, row_number() over (order by a, b nulls first, c nulls first) - 1 as position from t"""
)
def g8_tree_order(spark, sf_dir):
    return graphs.tree_order(*_places(spark, sf_dir))


@query(
    """select 'r' || n_regionkey as owner, 'n' || n_nationkey as member, 1 as depth from nation union all select case when n_nationkey % 3 = 0 then 'n' || n_nationkey else 'r' || n_regionkey end, 'c' || c_custkey, case when n_nationkey % 3 = 0 then 1 else 2 end
    from customer join nation on n_nationkey = c_nationkey"""
)
def g4_members_below(spark, sf_dir):
    edges, roots = _places(spark, sf_dir)
    inner = read(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graphs.members_below(edges, roots.select("node").unionAll(inner))
