"""Queries of constraints, resolution, reconciliation and graph walks, with the SQL they are held against.

Customers, suppliers, nations and regions play items, packages and their relations; every rule is broken by some rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.canonical import canonical_json, inputs_fingerprint
from ..operators import graphs, integrity, links, records, resolve, selection, tables
from .queries import query, read, record_table


def _rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _record(df: DataFrame, kind: str, owner, id_, content=None) -> DataFrame:
    text = F.lit("{}") if content is None else F.to_json(content)
    return df.select(F.lit(kind).alias("kind"), owner.alias("owner"), id_.cast("string").alias("id"), text.alias("content"))


@query(
    """select doc_id, sha256('["recordloom/record-v1",{"id":"' || doc_id || '","kind":"item","owner":"' || source || '"},{"lang":"' || lang || '","n_chars":' || n_chars || '}]') as fingerprint
    from documents"""
)
def c5_record_fingerprints(spark, sf_dir):
    signed = records.with_fingerprints(record_table(spark, sf_dir).where("kind = 'item'"))
    return signed.select(F.col("id").cast("bigint").alias("doc_id"), "fingerprint")


@query("select 'item' as kind, source as owner, cast(doc_id as varchar) as id from documents where doc_id % 7 = 0 or lang = 'fr'")
def c6_fingerprint_violations(spark, sf_dir):
    signed = records.with_fingerprints(record_table(spark, sf_dir).where("kind = 'item'"))
    bad = F.when(F.col("id").cast("bigint") % 7 == 0, "0").otherwise(F.col("fingerprint"))
    loose = F.when(F.get_json_object("content", "$.lang") == "fr", F.concat(F.lit(" "), "content")).otherwise(F.col("content"))
    return records.fingerprint_violations(signed.withColumn("fingerprint", bad).withColumn("content", loose)).select("kind", "owner", "id")


@query(
    """select source as repository, sha256('recordloom/declared-inputs-v1' || chr(0) || '[' || string_agg('{"digest":"' || sha256(text) || '","path":"' || lpad(cast(doc_id as varchar), 9, '0')
    || '","repository":"' || source || '"}', ',' order by doc_id) || ']') as fingerprint from documents group by source"""
)
def a10_declared_inputs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    inputs = F.collect_list(F.struct(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.sha2("text", 256).alias("digest")))
    return docs.groupBy(F.col("source").alias("repository")).agg(inputs.alias("inputs")).select("repository", inputs_fingerprint(F.col("repository"), F.col("inputs")).alias("fingerprint"))


@query(
    """with i as (select 'item' as kind, r_name as owner, n_name as id, n_nationkey as n from nation join region on r_regionkey = n_regionkey)
    select 'unknown-kind' as code, 'odd' as kind, '' as owner, 'o' || s_suppkey as id from supplier where s_suppkey % 3 = 0
    union all select 'owner-not-empty', 'page', 'x', 'p' || s_suppkey from supplier where s_suppkey % 5 = 0
    union all select 'id-not-empty', 'workspace', '', 'x' union all select 'id-empty', 'concept', '', ''
    union all select 'duplicate-key', kind, owner, id from i where n % 4 = 0
    union all select 'orphan-owner', 'item', 'nowhere', 's' || s_suppkey from supplier where s_suppkey % 2 = 1
    union all select 'missing-child', kind, owner, 'gone' || n from i where n % 10 = 0 union all select 'missing-child', kind, owner, 'gone' || n from i where n % 20 = 0
    union all select 'duplicate-slug', 'package', '', r_name from region where r_regionkey < 2
    union all select 'missing-repository', 'package', '', r_name from region where r_regionkey % 2 = 1"""
)
def c1_record_violations(spark, sf_dir):
    region, supplier = read(spark, sf_dir, "region"), read(spark, sf_dir, "supplier")
    nation = read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    none, key, one = F.lit(""), F.col("n_nationkey"), spark.range(1)
    children = F.when(key % 10 == 0, F.array(F.col("n_name"), F.concat(F.lit("gone"), key))).otherwise(F.array("n_name"))
    items = _record(nation, "item", F.col("r_name"), F.col("n_name"), F.struct(children.alias("children")))
    slug = F.when(F.col("r_regionkey") < 2, "same").otherwise(F.col("r_name")).alias("slug")
    repository = F.when(F.col("r_regionkey") % 2 == 0, "repo").otherwise("none").alias("repository")
    small = F.col("s_suppkey")
    return records.record_violations(
        _rows(
            _record(region, "package", none, F.col("r_name"), F.struct(slug, repository)), _record(one, "repository", none, F.lit("repo")),
            items, items.join(nation.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("id")), "id", "left_semi").select(items.columns),
            _record(supplier.where("s_suppkey % 3 = 0"), "odd", none, F.concat(F.lit("o"), small)), _record(supplier.where("s_suppkey % 5 = 0"), "page", F.lit("x"), F.concat(F.lit("p"), small)),
            _record(one, "workspace", none, F.lit("x")), _record(one, "concept", none, none),
            _record(supplier.where("s_suppkey % 2 = 1"), "item", F.lit("nowhere"), F.concat(F.lit("s"), small)),
        )
    )


def _workspace(spark, sf_dir) -> DataFrame:
    """Packages are regions, items nations; pages, groups and documents are suppliers and customers, some of them wrong."""
    region, supplier, customer = (read(spark, sf_dir, t) for t in ("region", "supplier", "customer"))
    nation = read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    none, one, s = F.lit(""), spark.range(1), F.col("s_suppkey")
    item = F.struct(F.when(s % 10 == 3, "LOST").otherwise("ASIA").alias("package"), F.lit("NATION_2").alias("item"))
    project, owned = F.lit('{"kind":"project"}'), F.when(s % 10 == 4, '{"kind":"package","package":"LOST"}').otherwise('{"kind":"package","package":"ASIA"}')
    kinds = (
        F.when(s % 3 == 0, F.to_json(F.struct(F.lit("authored").alias("kind"), F.when(s % 2 == 0, "guide").otherwise("none").alias("collection"))))
        .when(s % 3 == 1, F.to_json(F.struct(F.lit("api").alias("kind"), item.alias("item")))).otherwise(F.lit('{"kind":"overview"}'))
    )
    page = F.concat(F.lit('{"owner":'), F.when(s % 2 == 0, project).otherwise(owned), F.lit(',"kind":'), kinds, F.lit("}"))
    pages = supplier.select(F.lit("page").alias("kind"), none.alias("owner"), F.concat(F.lit("s"), s).alias("id"), page.alias("content"))
    documents = _record(supplier.where("s_suppkey % 9 <> 0"), "document", none, F.to_json(F.struct(F.lit("page").alias("kind"), F.concat(F.lit("s"), s).alias("page"))))
    members = F.array(F.struct(F.lit("ASIA").alias("package"), F.when(F.col("c_custkey") % 100 == 0, "gone").otherwise("NATION_2").alias("item")))
    ends = F.lit('{"relationships":[{"from":{"kind":"workspace","package":"ASIA"},"to":{"kind":"workspace","package":"LOST"}},{"from":{"kind":"external"},"to":{"kind":"workspace","package":"ASIA"}}],"diagnostics":[{"severity":"warning"},{"severity":"error"}]}')
    return _rows(
        _record(region, "package", none, F.col("r_name")), _record(nation, "item", F.col("r_name"), F.col("n_name"), F.struct(F.struct(F.lit("repo").alias("repository")).alias("source_location"))),
        _record(one, "repository", none, F.lit("repo")), one.select(F.lit("collection").alias("kind"), none.alias("owner"), F.lit("guide").alias("id"), F.lit('{"owner":{"kind":"project"},"repository":"repo"}').alias("content")),
        pages, documents, _record(one, "document", none, F.lit('{"kind":"page","page":"nobody"}')),
        _record(customer, "concept", none, F.concat(F.lit("c"), "c_custkey"), F.struct(members.alias("members"))),
        _record(supplier.where("s_suppkey in (1, 2)"), "execution", none, F.concat(F.lit("s"), s)), _record(one, "execution", none, F.lit("nobody")),
        one.select(F.lit("workspace").alias("kind"), none.alias("owner"), none.alias("id"), ends.alias("content")),
    )


@query(
    """with p as (select s_suppkey as s, 's' || s_suppkey as id from supplier)
    select 'missing-owner' as code, 'page' as kind, '' as owner, id from p where s % 2 = 1 and s % 10 = 4
    union all select 'page-collection', 'page', '', id from p where s % 6 = 3
    union all select 'page-item', 'page', '', id from p where s % 3 = 1 and s % 10 = 3
    union all select 'concept-member', 'concept', '', 'c' || c_custkey from customer where c_custkey % 100 = 0
    union all select 'relationship-end', 'workspace', '', '' union all select 'error-diagnostic', 'workspace', '', ''
    union all select 'execution-page', 'execution', '', 'nobody' union all select 'document-missing', 'page', '', id from p where s % 9 = 0
    union all select 'document-of-nothing', 'document', '', '{"kind":"page","page":"nobody"}'"""
)
def j12_reference_violations(spark, sf_dir):
    return integrity.reference_violations(_workspace(spark, sf_dir))


@query("select 'package' as kind, '' as owner, source as id, 'name' as key from documents group by source")
def c1_closed_keys(spark, sf_dir):
    return integrity.closed_keys(record_table(spark, sf_dir), {"package": ["version"], "item": ["lang", "n_chars"]})


def _language_items(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), F.col("c_nationkey") % 3).alias("package"), F.concat(F.lit("i"), c).alias("item"), F.when(F.col("c_nationkey") % 3 == 0, "r").otherwise("python").alias("ecosystem"),
        F.when(c % 50 == 0, "cpp").when(F.col("c_nationkey") % 3 == 0, "r").otherwise("python").alias("language"),
        F.when(c % 4 == 1, "overload").when(c % 4 == 2, "field").otherwise("plain").alias("role"), F.when(c % 8 == 2, F.concat(F.lit("i"), c)).otherwise("none").alias("parent"),
        F.when(c % 8 == 1, F.concat(F.lit("i"), c)).when(c % 8 == 5, "none").alias("family"), F.when(c % 10 == 7, F.concat(F.lit("i"), c)).when(c % 10 == 8, "none").alias("primary"), F.lit(True).alias("exported"),
    )


@query(
    """with i as (select 'p' || c_nationkey % 3 as package, 'i' || c_custkey as item, c_custkey as c from customer)
    select 'family-missing' as code, package, item from i where c % 8 = 5 union all select 'family-is-member', package, item from i where c % 8 = 1
    union all select 'field-without-type', package, item from i where c % 8 = 6 union all select 'topic-missing', package, item from i where c % 10 = 8
    union all select 'language-mismatch', package, item from i where c % 50 = 0"""
)
def c12_language_violations(spark, sf_dir):
    return integrity.language_violations(_language_items(spark, sf_dir))


@query(
    """with s as (select event_id as doc, user_id % 7 as k, event_id % 3 as v, event_type = 'click' as run from events)
    select case when k = 6 then 'merge-key' when (k = 0 and v = 0 or k in (1, 2, 3)) and not run then 'not-authorized' when k = 0 and v = 2 then 'not-a-flag' end as code, doc,
    ['execute', 'kernel', 'execute.engine', 'jupyter', 'title', 'execute.echo', 'execute.<<'][k + 1] as key from s where code is not null"""
)
def c11_execution_violations(spark, sf_dir):
    keys = ["execute", "kernel", "execute.engine", "jupyter", "title", "execute.echo", "execute.<<"]
    key = F.element_at(F.array(*map(F.lit, keys)), (F.col("user_id") % 7 + 1).cast("int"))
    value = F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("maybe")), (F.col("event_id") % 3 + 1).cast("int"))
    mode = F.when(F.col("event_type") == "click", "execute").otherwise("never")
    return integrity.execution_violations(read(spark, sf_dir, "events").select(F.col("event_id").alias("doc"), mode.alias("mode"), key.alias("key"), value.alias("value")))


@query(
    """select coalesce(l.doc_id, d.doc_id) as doc_id, case when l.doc_id is null then 'added' when d.doc_id is null then 'removed' else 'modified' end as change
    from labels l full join (select doc_id + 50 as doc_id, n_chars from documents) d on l.doc_id = d.doc_id where l.toxic is distinct from cast(d.n_chars % 2 as integer) or l.doc_id is null or d.doc_id is null"""
)
def u1_changed(spark, sf_dir):
    before = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("v"))
    after = read(spark, sf_dir, "documents").select((F.col("doc_id") + 50).alias("doc_id"), (F.col("n_chars") % 2).cast("int").alias("v"))
    return tables.changed(before, after, "doc_id", "v")


@query("select doc_id from labels except select doc_id + 50 from documents")
def u2_difference(spark, sf_dir):
    return tables.difference(read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select((F.col("doc_id") + 50).alias("doc_id")), "doc_id")


@query("select 'r' || r_regionkey as node from region union all select 'c' || c_custkey from customer where c_custkey % 5 = 0")
def u5_roots(spark, sf_dir):
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    nations, customers = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node")), c.select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    edges = nations.unionAll(customers.where("cast(substring(node, 2) as int) % 5 <> 0")).withColumnRenamed("node", "child")
    return tables.roots(edges, region.unionAll(nations).unionAll(customers))


@query(
    """select doc_id, case when action is null then 'delete' else action end as action from (select coalesce(l.doc_id, d.doc_id) as doc_id,
    case when d.doc_id is null then 'delete' when l.doc_id is null or l.quality <> d.n_chars % 2 then 'write' else 'keep' end as action
    from labels l full join (select doc_id + 50 as doc_id, n_chars from documents) d on l.doc_id = d.doc_id) where action <> 'keep'"""
)
def u6_replacement(spark, sf_dir):
    before = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("v"))
    return tables.replacement(before, read(spark, sf_dir, "documents").select((F.col("doc_id") + 50).alias("doc_id"), (F.col("n_chars") % 2).cast("int").alias("v")), "doc_id", "v")


@query("select distinct p_brand as code, p_type as severity, p_size % 3 as span from part")
def a9_diagnostics_set(spark, sf_dir):
    return tables.diagnostics_set(read(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("severity"), (F.col("p_size") % 3).alias("span")))


@query(
    """select p_brand as digest, min(p_type) as media_type, count(distinct p_partkey % 40) as uses, count(distinct (p_type, p_size % 2)) > 1 as conflict from part group by p_brand"""
)
def a8_retained_assets(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return tables.retained_assets(p.select((F.col("p_partkey") % 40).alias("slot"), F.col("p_brand").alias("digest"), F.col("p_type").alias("media_type"), (F.col("p_size") % 2).alias("byte_size")))


@query("select event_type, array_to_string(list_sort(list(distinct json_extract_string(props, '$.k'))), ',') as ks from events group by event_type")
def a15_observed_values(spark, sf_dir):
    found = tables.observed_values(read(spark, sf_dir, "events"), ["event_type"], "props", {"ks": "$.k"})
    return found.select("event_type", F.array_join("ks", ",").alias("ks"))


@query(
    """with m as (select l_orderkey as owner, l_linenumber as ord, case when l_linenumber % 3 = 0 then 'Methods' else 'Fields' end as section, case when l_linenumber % 5 <> 0 and l_linenumber % 3 <> 0 then l_partkey end as start,
    l_suppkey from lineitem)
    select owner, section, ord as item, row_number() over (partition by owner, section order by start nulls first, ord) - 1 as position from m"""
)
def a6_sections(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    n = F.col("l_linenumber")
    rows = l.select(F.col("l_orderkey").alias("owner"), F.when(n % 3 == 0, "method").otherwise("field").alias("role"), n.alias("item"), F.when(n % 5 != 0, F.col("l_partkey")).alias("start"), n.alias("ord"))
    return tables.sections(rows).select("owner", "section", "item", F.col("position").cast("bigint").alias("position"))


@query("select l_orderkey as owner, l_linenumber as ord, row_number() over (partition by l_orderkey order by l_returnflag = 'R', l_linenumber) - 1 as position from lineitem")
def o7_keyword_only_last(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("ord"), (F.col("l_returnflag") == "R").alias("keyword_only"))
    return tables.keyword_only_last(rows).select("owner", "ord", F.col("position").cast("bigint").alias("position"))


@query(
    """with p as (select distinct p_brand || '/' || p_type || '/' || case when p_size % 4 = 0 then 'build/x' when p_size % 4 = 1 then 'y' else 'z/' || p_size end as path from part union select 'Brand#1' union select 'Brand#2/' || p_type from part)
    select path from p where not exists (select 1 from p q where starts_with(p.path, q.path || '/') and not contains('/' || substr(p.path, length(q.path) + 2) || '/', '/build/'))"""
)
def a17_minimal_roots(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    end = F.when(F.col("p_size") % 4 == 0, "build/x").when(F.col("p_size") % 4 == 1, "y").otherwise(F.concat(F.lit("z/"), "p_size"))
    paths = part.select(F.concat_ws("/", "p_brand", "p_type", end).alias("path")).unionAll(spark.range(1).select(F.lit("Brand#1").alias("path"))).unionAll(part.select(F.concat(F.lit("Brand#2/"), "p_type").alias("path")))
    return tables.minimal_roots(paths, ["build"])


def _items(spark, sf_dir) -> DataFrame:
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("p"), s % 5).alias("package"), F.concat(F.lit("i"), s).alias("item"), F.concat(F.lit("m::q"), (s / 3).cast("int")).alias("qualified_name"),
        F.array(F.concat(F.lit("a"), s)).alias("aliases"), (s % 11 == 0).alias("secondary"), F.when(s % 5 < 2, "rust").otherwise("python").alias("ecosystem"),
    )


_KNOWN = """items as (select 'p' || s_suppkey % 5 as package, 'i' || s_suppkey as item, 'm::q' || s_suppkey // 3 as q, 'a' || s_suppkey as a, s_suppkey % 11 = 0 as secondary, s_suppkey % 5 < 2 as rust from supplier),
    spelled as (select package, item as name, item, true as exact from items union all select package, q, item, false from items where not secondary union all select package, a, item, false from items where not secondary
      union all select package, split_part(q, '::', 2), item, false from items where not secondary and rust),
    known as (select package, name, case when max(exact::int) = 1 then max(case when exact then item end) when count(distinct item) = 1 then max(item) end as item from spelled group by package, name)"""


@query(
    f"""with {_KNOWN}, refs as (select c_custkey as ref, case when c_custkey % 4 <> 0 then 'p' || c_nationkey % 5 end as owner,
      case c_custkey % 6 when 0 then 'm::q' || c_custkey % 40 when 1 then 'p1::q' || c_custkey % 40 when 2 then 'p0::i' || c_custkey % 120 when 3 then 'a' || c_custkey % 120 when 4 then 'q' || c_custkey % 40 else 'p3::zz' end as target from customer),
    e as (select ref, split_part(target, '::', 1) as package, substr(target, strpos(target, '::') + 2) as name, target from refs where contains(target, '::') and split_part(target, '::', 1) in (select package from items)),
    e2 as (select e.ref, e.package, case when k.name is null and e.package in ('p0', 'p1') then e.target else e.name end as name from e left join known k on k.package = e.package and k.name = e.name),
    t0 as (select e2.ref, k.package, k.item, k.name is not null as there from e2 left join known k using (package, name)),
    t1 as (select r.ref, k.package, k.item from refs r join known k on k.package = r.owner and k.name = r.target where r.ref not in (select ref from t0)),
    t2 as (select r.ref, count(*) as n, min(k.package) as package, min(k.item) as item from refs r join known k on k.name = r.target where r.ref not in (select ref from t0) and r.ref not in (select ref from t1) group by r.ref)
    select r.ref, coalesce(t0.item, t1.item, case when t2.n = 1 then t2.item end) as item,
      case when coalesce(t0.item, t1.item, case when t2.n = 1 then t2.item end) is not null then 'resolved' when t0.ref is not null then case when t0.there then 'ambiguous' else 'unresolved' end
      when t1.ref is not null or t2.n >= 1 then 'ambiguous' else 'unresolved' end as status
    from refs r left join t0 using (ref) left join t1 using (ref) left join t2 using (ref)"""
)
def j1_resolve_items(spark, sf_dir):
    c = F.col("c_custkey")
    target = (
        F.when(c % 6 == 0, F.concat(F.lit("m::q"), c % 40)).when(c % 6 == 1, F.concat(F.lit("p1::q"), c % 40)).when(c % 6 == 2, F.concat(F.lit("p0::i"), c % 120))
        .when(c % 6 == 3, F.concat(F.lit("a"), c % 120)).when(c % 6 == 4, F.concat(F.lit("q"), c % 40)).otherwise("p3::zz")
    )
    refs = read(spark, sf_dir, "customer").select(c.alias("ref"), F.when(c % 4 != 0, F.concat(F.lit("p"), F.col("c_nationkey") % 5)).alias("owner"), target.alias("target"))
    return resolve.resolve_items(refs, _items(spark, sf_dir)).select("ref", "item", "status")


@query(f"with {_KNOWN} select package, name, item from known")
def j2_in_package(spark, sf_dir):
    return resolve._in_package(resolve.lookup_names(_items(spark, sf_dir)))


@query(
    f"""with {_KNOWN}, m as (select c_custkey % 9 as concept, 'p' || c_nationkey % 5 as package, 'q' || c_custkey % 40 as name from customer)
    select concept, package, m.name, k.item, case when k.item is null then case when k.name is null then 'unresolved' else 'ambiguous' end end as problem from m left join known k using (package, name)"""
)
def j10_concept_members(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    members = c.select((F.col("c_custkey") % 9).alias("concept"), F.concat(F.lit("p"), F.col("c_nationkey") % 5).alias("package"), F.concat(F.lit("q"), F.col("c_custkey") % 40).alias("name"))
    return resolve.concept_members(members, _items(spark, sf_dir))


@query(
    """with d as (select 'm' || s_nationkey as module, case when s_suppkey % 3 = 0 then '_n' else 'n' end || s_suppkey % 7 as name, case when s_suppkey % 2 = 0 then 'stub' else 'source' end as origin, s_suppkey as s from supplier),
    x as (select distinct 'm' || c_nationkey as module, 'n' || c_custkey % 9 as name from customer where c_nationkey < 10),
    b as (select module, name, max(origin) as origin from d group by all), bad as (select module from d group by module, origin having count(distinct s % 4) > 1)
    select coalesce(b.module, x.module) as module, coalesce(b.name, x.name) as name, b.origin, case when coalesce(b.module, x.module) in (select module from x) then x.name is not null else not starts_with(coalesce(b.name, x.name), '_') end as public,
    case when coalesce(b.module, x.module) in (select module from bad) then 'several-files' end as problem from b full join x on b.module = x.module and b.name = x.name"""
)
def j13_reconcile_modules(spark, sf_dir):
    s = F.col("s_suppkey")
    d = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), "s_nationkey").alias("module"), F.concat(F.when(s % 3 == 0, "_n").otherwise("n"), s % 7).alias("name"), F.when(s % 2 == 0, "stub").otherwise("source").alias("origin"),
        (s % 4).alias("file"), s.alias("facts"),
    )
    exports = read(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.concat(F.lit("m"), "c_nationkey").alias("module"), F.concat(F.lit("n"), F.col("c_custkey") % 9).alias("name"))
    return resolve.reconcile_modules(d, exports).select("module", "name", "origin", "public", "problem")


@query(
    """with e as (select distinct c_nationkey as package, c_custkey % 20 as name from customer where c_custkey % 3 = 0), h as (select s_nationkey as package, s_suppkey % 20 as name, count(distinct s_suppkey % 6) as n, min(s_suppkey % 6) as topic from supplier group by all),
    f as (select c_nationkey as package, c_custkey % 20 as name, min(c_mktsegment) as source from customer where c_custkey % 2 = 0 group by all),
    r as (select coalesce(e.package, h.package) as package, coalesce(e.name, h.name) as name, e.name is not null as out, h.n, h.topic from e full join h on e.package = h.package and e.name = h.name)
    select coalesce(r.package, f.package) as package, coalesce(r.name, f.name) as name, cast(case when n = 1 then topic end as varchar) as topic, source,
    case when n > 1 then 'conflict' when out and topic is not null then 'documented' when out then 'undocumented' when topic is not null then 'internal' else 'private' end as status
    from r full join f on r.package = f.package and r.name = f.name"""
)
def j14_reconcile_help(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    name = (F.col("c_custkey") % 20).alias("name")
    exports = c.where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("package"), name)
    topics = s.select(F.col("s_nationkey").alias("package"), (F.col("s_suppkey") % 20).alias("name"), (F.col("s_suppkey") % 6).alias("topic"))
    found = resolve.reconcile_help(exports, topics, c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("package"), name, F.col("c_mktsegment").alias("source")))
    return found.withColumn("topic", F.col("topic").cast("string"))


@query(
    """with r as (select distinct c_nationkey as f, c_custkey % 12 as s from customer where c_custkey % 3 <> 0), d as (select s_nationkey as f, s_suppkey % 12 as s, max((cast(s_suppkey % 3 as varchar), cast(s_suppkey as varchar))) as m from supplier group by all)
    select coalesce(r.f, d.f) as function, coalesce(r.s, d.s) as signature, cast(case when d.f is not null then d.m[1] end as varchar) as file, cast(case when d.f is not null then d.m[2] end as varchar) as line,
    case when r.f is not null and d.f is not null then 'both' when r.f is not null then 'runtime' else 'source' end as origin from r full join d on r.f = d.f and r.s = d.s"""
)
def j15_reconcile_methods(spark, sf_dir):
    runtime = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("function"), (F.col("c_custkey") % 12).alias("signature"))
    s = F.col("s_suppkey")
    return resolve.reconcile_methods(runtime, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("function"), (s % 12).alias("signature"), (s % 3).cast("string").alias("file"), s.cast("string").alias("line")))


@query("select o_custkey as key, min_by(o_orderstatus, o_orderkey) as flag, string_agg(o_orderpriority, ',' order by p) as orders from (select o_custkey, o_orderstatus, o_orderkey, o_orderpriority, p from (select *, min(o_orderkey) over (partition by o_custkey, o_orderpriority) as p from orders) where p = o_orderkey or true) t where p = o_orderkey group by o_custkey")
def j16_merge_by_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("rank"), F.col("o_orderstatus").alias("flag"), F.array("o_orderpriority").alias("orders")
    )
    return resolve.merge_by_rank(rows, ["key"], "rank", ["flag"], ["orders"]).select("key", "flag", F.array_join("orders", ",").alias("orders"))


@query(
    """with c as (select n_name as name, 'n' || n_nationkey as target, 0 as priority from nation
      union all select r_name, 'r' || r_regionkey, 1 from region union all select c_mktsegment, 'c' || c_nationkey, 2 from customer),
    r as (select distinct name from c union select 'NOWHERE'), m as (select r.name, c.priority, c.target from r join c using (name)),
    b as (select name, min(priority) as priority from m group by name), t as (select name, count(distinct target) as n, min(target) as target from m join b using (name, priority) group by name)
    select r.name, case when n = 1 then target end as target, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unresolved' end as status from r left join t using (name)"""
)
def j1_resolve_prioritised(spark, sf_dir):
    n, r, c = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    tiers = [(n, "n_name", "n", "n_nationkey"), (r, "r_name", "r", "r_regionkey"), (c, "c_mktsegment", "c", "c_nationkey")]
    parts = [t.select(F.col(name).alias("name"), F.concat(F.lit(p), key).alias("target"), F.lit(i).alias("priority")) for i, (t, name, p, key) in enumerate(tiers)]
    candidates = parts[0].unionAll(parts[1]).unionAll(parts[2])
    refs = candidates.select("name").unionAll(spark.range(1).select(F.lit("NOWHERE").alias("name"))).distinct().withColumn("ref", F.col("name"))
    return resolve.resolve_prioritised(refs, candidates).withColumnRenamed("ref", "name")


@query(
    """with t as (select 'p' || s_nationkey % 4 as package, 't' || s_suppkey % 25 as topic, 'i' || s_suppkey as item from supplier),
    r as (select c_custkey as ref, 'p' || c_nationkey % 4 as owner, case c_custkey % 3 when 1 then 'p' || c_custkey % 6 end as package, 't' || c_custkey % 40 as topic from customer),
    inst as (select 't' || n_nationkey + 20 as topic, 'https://h/' || n_nationkey as url from nation),
    m as (select ref, 0 as tier, t.package || '/' || item as target from r join t on r.package is null and t.package = r.owner and t.topic = r.topic
      union all select ref, 1, t.package || '/' || item from r join t on t.topic = r.topic and (r.package is null or t.package = r.package)
      union all select ref, 2, url from r join inst i on i.topic = r.topic where r.package is null or r.package not in (select package from t)),
    b as (select ref, min(tier) as tier from m group by ref), n as (select ref, count(distinct target) as n, min(target) as target from m join b using (ref, tier) group by ref)
    select r.ref, case when n = 1 then target end as target, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unresolved' end as status from r left join n using (ref)"""
)
def j3_resolve_topics(spark, sf_dir):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    topics = read(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_nationkey") % 4).alias("package"), F.concat(F.lit("t"), s % 25).alias("topic"), F.concat(F.lit("i"), s).alias("item"))
    refs = read(spark, sf_dir, "customer").select(c.alias("ref"), F.concat(F.lit("p"), F.col("c_nationkey") % 4).alias("owner"), F.when(c % 3 == 1, F.concat(F.lit("p"), c % 6)).alias("package"), F.concat(F.lit("t"), c % 40).alias("topic"))
    installed = read(spark, sf_dir, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey") + 20).alias("topic"), F.concat(F.lit("https://h/"), "n_nationkey").alias("url"))
    return links.resolve_topics(refs, topics, installed)


@query(
    """with v as (select p_partkey as package, '1.' || p_size || '.0' as version, case when p_partkey % 2 = 0 then 'r' else 'other' end as ecosystem from part)
    select l.event_id as "from", v.package as "to", case when v.ecosystem = 'other' then 'unknown' when cast(split_part(v.version, '.', 2) as integer) >= 20 then 'ok' else 'mismatch' end as outcome
    from events l join v on v.package = l.event_id % 3000"""
)
def c7_relationship_checks(spark, sf_dir):
    versions = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("package"), F.concat(F.lit("1."), "p_size", F.lit(".0")).alias("version"), F.when(F.col("p_partkey") % 2 == 0, "r").otherwise("other").alias("ecosystem"))
    rel = read(spark, sf_dir, "events").select(F.col("event_id").alias("from"), (F.col("event_id") % 3000).alias("to"), F.lit(">= 1.20").alias("constraint"))
    return tables.relationship_checks(rel, versions).select("from", "to", "outcome")


def _tree(spark, sf_dir) -> DataFrame:
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    top = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    return top.unionAll(c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child")))


@query(
    """with e as (select 'r' || n_regionkey as p, 'n' || n_nationkey as c from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer),
    a as (select 'c' || c_custkey as node, c_nationkey from customer where c_mktsegment = 'BUILDING' and c_nationkey in (3, 4)),
    hit as (select node from a union select 'n' || c_nationkey from a union select 'r' || n_regionkey from a join nation on n_nationkey = c_nationkey)
    select node, node in (select node from hit) as active from (select p as node from e union select c from e)"""
)
def g8_active_tree(spark, sf_dir):
    active = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_nationkey in (3, 4)").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return selection.active_tree(_tree(spark, sf_dir), active)


@query(
    """with s as (select 'c' || c_custkey as item, c_nationkey from customer where c_custkey % 3 = 0)
    select 'p' as package, item from s union select 'p', 'n' || c_nationkey from s union select 'p', 'r' || n_regionkey from s join nation on n_nationkey = c_nationkey"""
)
def f2_discoverable_set(spark, sf_dir):
    none = F.lit(None).cast("string")
    edges = _tree(spark, sf_dir).select(F.lit("p").alias("package"), "parent", "child")
    items = read(spark, sf_dir, "customer").select(
        F.lit("p").alias("package"), F.concat(F.lit("c"), "c_custkey").alias("item"), F.when(F.col("c_custkey") % 3 == 0, "rust").otherwise("python").alias("language"), none.alias("family"),
        F.lit(False).alias("internal"), F.when(F.col("c_custkey") % 3 != 0, "private").alias("visibility"), none.alias("role"), none.alias("method_of"),
    )
    return selection.discoverable_set(items, edges)


@query("select n_name as cls, n_name || ',r' || n_regionkey || ',r' || (n_regionkey + 1) % 5 || ',root' as mro from nation union all select 'r' || r_regionkey, 'r' || r_regionkey || ',root' from region union all select 'root', 'root'")
def g1_c3_order(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    regions = n.select(F.lit("p").alias("package"), F.concat(F.lit("r"), "n_regionkey").alias("cls"), F.array(F.lit("root")).alias("bases")).distinct()
    top = spark.range(1).select(F.lit("p").alias("package"), F.lit("root").alias("cls"), F.array().cast("array<string>").alias("bases"))
    nations = n.select(F.lit("p").alias("package"), "n_name", F.array(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("r"), (F.col("n_regionkey") + 1) % 5)).alias("bases"))
    found = graphs.c3_order(nations.withColumnRenamed("n_name", "cls").unionByName(regions).unionByName(top))
    return found.select("cls", F.array_join("mro", ",").alias("mro"))


@query(
    """select 'c' || c_custkey as item, 'crate::r' || n_regionkey || '::n' || n_nationkey || '::c' || c_custkey as path from customer join nation on n_nationkey = c_nationkey
    union all select 'c' || c_custkey, 'crate::top::c' || c_custkey from customer where c_custkey < 20"""
)
def g2_public_paths(spark, sf_dir):
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    up = _tree(spark, sf_dir).select(F.col("parent").alias("module"), F.col("child").alias("name"), F.col("child").alias("target"))
    first = n.select(F.lit("root").alias("module"), F.concat(F.lit("r"), "n_regionkey").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("target")).distinct()
    back = n.select(F.concat(F.lit("n"), "n_nationkey").alias("module"), F.lit("back").alias("name"), F.lit("root").alias("target"))
    again = c.where("c_custkey < 20").select(F.lit("globbed").alias("module"), F.concat(F.lit("c"), "c_custkey").alias("name"), F.concat(F.lit("c"), "c_custkey").alias("target"))
    glob = spark.range(1).select(F.lit("top").alias("module"), F.lit(None).cast("string").alias("name"), F.lit("globbed").alias("target"))
    door = spark.range(1).select(F.lit("root").alias("module"), F.lit("top").alias("name"), F.lit("top").alias("target"))
    exports = _rows(up, first, back, again, glob, door)
    return selection.public_paths(exports, spark.range(1).select(F.lit("root").alias("module"), F.lit("crate").alias("path")))


@query(
    """select 'c' || c_custkey as node, 'root::r' || n_regionkey || '::n' || n_nationkey || '::c' || c_custkey as path from customer join nation on n_nationkey = c_nationkey
    union all select 'n' || n_nationkey, 'root::r' || n_regionkey || '::n' || n_nationkey from nation union all select 'r' || r_regionkey, 'root::r' || r_regionkey from region union all select 'root', 'root'"""
)
def g3_defining_paths(spark, sf_dir):
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")

    def edge(df, parent, ord_, child):
        return df.select(parent.alias("parent"), ord_.cast("int").alias("ord"), child.alias("child"), child.alias("name"))

    r, nn, cc = F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("c"), "c_custkey")
    late = edge(n, F.lit("root"), F.col("n_nationkey") + 100, nn)  # a later way to every nation, which loses
    back = edge(n, nn, F.lit(0), F.lit("root"))  # and a way back
    children = _rows(edge(n, F.lit("root"), F.col("n_regionkey"), r).distinct(), edge(n, r, F.col("n_nationkey"), nn), edge(c, F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey"), cc), late, back)
    return graphs.defining_paths(children, "root")


@query(
    """select s_nationkey as owner, s_suppkey as member, '' as context from supplier union select c_nationkey, c_custkey + 100000, c_mktsegment from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')"""
)
def g4_attached_members(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    impls = c.select(F.col("c_nationkey").alias("owner"), F.concat_ws(":", "c_nationkey", segment).alias("impl"), segment.alias("context"), (segment == "BUILDING").alias("blanket"), (segment == "MACHINERY").alias("hidden")).distinct()
    items = c.select(F.concat_ws(":", "c_nationkey", segment).alias("impl"), (F.col("c_custkey") + 100000).alias("member"))
    return graphs.attached_members(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("member")), impls, items)


@query(
    """with recursive a as (select 'a' || s_suppkey as alias, 'a' || s_suppkey // 2 as target from supplier where s_suppkey > 3 union all select 'a3', 'end' union all select 'x', 'y' union all select 'y', 'x'),
    t as (select alias as name, target, 1 as d from a union all select t.name, a.target, d + 1 from t join a on a.alias = t.target where d < 50)
    select distinct name, target from t where target not in (select alias from a) union all select 'plain', 'plain'"""
)
def g10_resolve_aliases(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").where("s_suppkey > 3")
    chains = s.select(F.concat(F.lit("a"), "s_suppkey").alias("alias"), F.concat(F.lit("a"), (F.col("s_suppkey") / 2).cast("int")).alias("target"))
    extra = spark.createDataFrame([("a3", "end"), ("x", "y"), ("y", "x")], "alias string, target string")
    aliases = chains.unionAll(extra)
    names = aliases.select(F.col("alias").alias("name")).distinct().unionAll(spark.createDataFrame([("plain",)], "name string"))
    return graphs.resolve_aliases(aliases, names)


@query(
    """with m as (select conv_id as module, turn, row_number() over (partition by conv_id order by turn) - 1 as n from conversations), k as (select module, max(case when n % 4 = 3 then n end) as broken, max(case when n % 4 = 0 then n end) as assigned from m group by module)
    select m.module, case when k.broken is null or k.assigned > k.broken then string_agg('x' || m.turn, ',' order by m.n) filter (where m.n >= k.assigned) end as names, coalesce(k.broken > k.assigned, false) as dynamic
    from m join k using (module) group by m.module, k.broken, k.assigned"""
)
def g11_exported_names(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    op = F.when(n % 4 == 0, "assign").when(n % 4 == 1, "append").when(n % 4 == 2, "extend").otherwise("call")
    steps = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("module"), n.alias("ord"), op.alias("op"), F.array(F.concat(F.lit("x"), "turn")).alias("names"))
    return selection.exported_names(steps).select("module", F.array_join("names", ",").alias("names"), "dynamic")


@query("select l_orderkey as owner, l_linenumber as ord from lineitem where (l_returnflag <> 'R' or (l_linestatus = 'F')) and (l_linenumber % 2 = 0 or l_linenumber % 3 = 0)")
def f10_native_members(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("owner"), n.alias("ord"), F.when(F.col("l_returnflag") == "R", "private").otherwise("public").alias("protection"), (F.col("l_linestatus") == "F").alias("virtual"),
        (n % 2 == 1).alias("static"), (n % 3 == 0).alias("is_member"),
    )
    return selection.native_members(rows, extract_virtual=True).select("owner", "ord")


@query(
    """with i as (select p_partkey as item, p_brand as module, p_type as page, p_name as name, p_size % 3 as k, p_size % 2 = 0 as exported from part where p_partkey % 7 <> 0 and p_size % 4 not in (1, 2))
    select module, item, row_number() over (partition by module order by case page when 'ECONOMY' then 1 else 2 end, case k when 0 then 2 when 1 then 1 else 3 end, name, item) - 1 as position from i
    where page in ('ECONOMY', 'STANDARD') and exported"""
)
def f7_documentation_block(spark, sf_dir):
    size = F.col("p_size")
    part = read(spark, sf_dir, "part")
    items = part.select(
        F.col("p_partkey").alias("item"), F.col("p_brand").alias("module"), F.col("p_type").alias("page"), F.col("p_name").alias("name"), F.concat(F.lit("k"), size % 3).alias("kind"), (size % 2 == 0).alias("exported"),
        (F.col("p_partkey") % 7 != 0).alias("documented"), F.when(size % 4 == 1, "field").when(size % 4 == 2, "method").otherwise("plain").alias("role"),
    )
    blocks = part.select(F.col("p_brand").alias("block"), F.lit(0).alias("ordinal"), F.col("p_brand").alias("module"), F.array(F.lit("ECONOMY"), F.lit("STANDARD")).alias("pages"), F.lit(True).alias("public"), F.lit(False).alias("private")).distinct()
    return selection.documentation_block(items, blocks, ["k1", "k0"]).select(F.col("block").alias("module"), "item", F.col("position").cast("bigint").alias("position"))


@query(
    """with i as (select doc_id, '{"n_chars":' || n_chars || ',"lang":"' || lang || '"}' as t, lang, n_chars from documents) select doc_id, '{"lang":"' || lang || '","n_chars":' || n_chars || '}' as canonical from i"""
)
def x5_canonical_json(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", canonical_json(F.to_json(F.struct("n_chars", "lang"))).alias("canonical"))


@query("select page_id, '\"' || replace(replace(replace(replace(html, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\u000a'), chr(9), '\\u0009') || '\"' as json from pages")
def x7_json_string(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.json_string(F.col("html")).alias("json"))
