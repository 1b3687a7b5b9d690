"""Queries of trees of digests, closures kept up to date, version keys, searches of many queries and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.versions import pep440_satisfies, semver_satisfies
from ..operators import graphs, merkle, records, search, signatures
from .queries import asset_table, query, read, record_table


def _files(docs: DataFrame) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), "doc_id"))
    return docs.select(path.alias("path"), F.sha2("text", 256).alias("digest"), (420 + F.col("n_chars") % 2).cast("int").alias("mode"))


def _level(name: str, below: str) -> str:
    """Digests of the folders that the rows (parent, path, directory, mode, digest) of ``below`` lie in."""
    return f"""{name}_b as (select parent, substr(sha256(split_part(path, '/', -1)), 1, 2) as b, sha256(string_agg(l, chr(10) order by l)) as d
      from (select parent, path, coalesce(cast(mode as varchar), '-') || case when directory then ' folder ' else ' file ' end || digest || ' ' || split_part(path, '/', -1) as l from {below}) group by all),
    {name} as (select case when contains(parent, '/') then split_part(parent, '/', 1) when parent <> '' then '' end as parent, parent as path, true as directory, cast(null as integer) as mode, sha256(string_agg(d, chr(10) order by b)) as digest from {name}_b group by all)"""


@query(
    f"""with files as (select source || '/' || lang as parent, source || '/' || lang || '/d' || doc_id as path, false as directory, cast(420 + n_chars % 2 as integer) as mode, sha256(text) as digest from documents),
    {_level('inner2', 'files')}, {_level('inner1', 'inner2')}, {_level('root', 'inner1')}
    select path, directory, mode, digest from files union all select path, directory, mode, digest from inner2 union all select path, directory, mode, digest from inner1 union all select path, directory, mode, digest from root"""
)
def s14_merkle_tree(spark, sf_dir):
    return merkle.merkle_tree(_files(read(spark, sf_dir, "documents"))).select("path", "directory", "mode", "digest")


@query(
    """with b as (select source || '/' || lang || '/d' || doc_id as path, sha256(text) as digest, n_chars, doc_id from documents),
    a as (select b.path, case when l.toxic = 1 then sha256('x' || b.digest) else b.digest end as digest from b left join labels l using (doc_id) where not (coalesce(l.quality, 1) = 0 and coalesce(l.toxic, 0) = 0) union all select 'bench/b' || item_id, sha256(text) from benchmark),
    folders as (select 'b' as side, regexp_replace(path, '/[^/]*$', '') as path from b union select 'a', regexp_replace(path, '/[^/]*$', '') from a), uppers as (select side, path from folders union select side, regexp_replace(path, '/[^/]*$', '') from folders)
    select coalesce(b.path, a.path) as path, false as directory, case when b.path is null then 'added' when a.path is null then 'removed' else 'modified' end as change from b full join a on a.path = b.path where a.digest is distinct from b.digest
    union all select path, true, case when max(side) = 'a' then 'added' else 'removed' end from uppers group by path having count(*) = 1"""
)
def s14_merkle_changes(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    before = _files(docs)
    marked = docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left").where(~((F.coalesce("quality", F.lit(1)) == 0) & (F.coalesce("toxic", F.lit(0)) == 0)))
    digest = F.when(F.col("toxic") == 1, F.sha2(F.concat(F.lit("x"), F.sha2("text", 256)), 256)).otherwise(F.sha2("text", 256))
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), "doc_id"))
    new = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/b"), "item_id").alias("path"), F.sha2("text", 256).alias("digest"), F.lit(420).alias("mode"))
    after = marked.select(path.alias("path"), digest.alias("digest"), (420 + F.col("n_chars") % 2).cast("int").alias("mode")).unionAll(new)
    return merkle.tree_changes(merkle.merkle_tree(before), merkle.merkle_tree(after))


@query(
    """with r as (select 'record' || chr(0) || 'item' || chr(0) || source || chr(0) || doc_id || chr(0) || sha256('{"lang":"' || lang || '","n_chars":' || n_chars || '}') as row from documents
      union all select 'asset' || chr(0) || sha256(text) || chr(0) || case when lang = 'en' then 'text/plain' else 'application/octet-stream' end || chr(0) || strlen(text) from documents),
    d as (select sha256(row) as d from r), leaf as (select substr(d, 1, 4) as leaf, sha256(string_agg(d, '' order by d)) as d from d group by 1), bucket as (select substr(leaf, 1, 2) as bucket, sha256(string_agg(d, '' order by leaf)) as d from leaf group by 1)
    select sha256('recordloom/content-v1' || chr(0) || string_agg(d, '' order by bucket)) as fingerprint from bucket"""
)
def a11_content_fingerprint(spark, sf_dir):
    items = record_table(spark, sf_dir).where("kind = 'item'").withColumn("fingerprint", F.sha2("content", 256))
    return records.content_fingerprint(items, asset_table(spark, sf_dir))


_AFTER = """e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation where n_nationkey % 7 <> 0 union select 'n' || c_nationkey, 'c' || c_custkey from customer where c_nationkey % 5 <> 0
    union select 'n' || (c_nationkey + 1) % 25, 'c' || c_custkey from customer where c_nationkey % 5 = 0 union select 'r' || (n_regionkey + 1) % 5, 'n' || n_nationkey from nation where n_nationkey % 6 = 0)"""


@query(f"with recursive {_AFTER}, w as (select src as start, dst as node from e union select w.start, e.dst from w join e on e.src = w.node) select start, node from w")
def g6_maintained_closure(spark, sf_dir):
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    edge = lambda a, b: [F.concat(*a).alias("src"), F.concat(*b).alias("dst")]
    r, nn, cn = F.lit("r"), F.lit("n"), F.lit("c")
    edges = n.select(*edge((r, "n_regionkey"), (nn, "n_nationkey"))).unionAll(c.select(*edge((nn, "c_nationkey"), (cn, "c_custkey"))))
    removed = n.where("n_nationkey % 7 = 0").select(*edge((r, "n_regionkey"), (nn, "n_nationkey"))).unionAll(c.where("c_nationkey % 5 = 0").select(*edge((nn, "c_nationkey"), (cn, "c_custkey"))))
    added = c.where("c_nationkey % 5 = 0").select(*edge((nn, (F.col("c_nationkey") + 1) % 25), (cn, "c_custkey"))).unionAll(n.where("n_nationkey % 6 = 0").select(*edge((r, (F.col("n_regionkey") + 1) % 5), (nn, "n_nationkey"))))
    pairs = graphs.closure(edges).select("start", "node")
    return graphs.apply_changes(pairs, graphs.closure_changes(pairs, edges, added, removed))


@query(
    """with v as (select event_id, event_id % 3 as a, event_id % 5 as b, event_id % 7 as c, case when event_id % 4 = 0 then event_id % 6 end as pre, user_id % 7 as q from events), k as (select *, a * 10000 + b * 100 + c as n from v)
    select event_id, case q when 0 then pre is null and n >= 10200 and n < 20000 when 1 then pre is null and n >= 10203 and n < 10300 when 2 then pre is null and a = 1 when 3 then (n > 10203 and pre is null or n = 10203 and (pre is null or pre >= 2)) and n < 20000
      when 4 then pre is null and n < 20200 when 5 then pre is null and n >= 300 and n < 400 else null end as ok from k"""
)
def x1_semver_constraints(spark, sf_dir):
    i, q = F.col("event_id"), F.col("user_id") % 7
    version = F.concat(F.concat_ws(".", i % 3, i % 5, i % 7), F.when(i % 4 == 0, F.concat(F.lit("-alpha."), i % 6)).otherwise(""))
    wanted = ["^1.2", "~1.2.3", "1.*", ">=1.2.3-alpha.2, <2", "<=2.1", "=0.3", "latest"]
    requirement = F.element_at(F.array(*map(F.lit, wanted)), (q + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", semver_satisfies(version, requirement).alias("ok"))


@query(
    """with v as (select event_id, event_id % 4 as a, event_id % 5 as b, event_id % 3 as kind, user_id % 8 as q from events), k as (select *, a * 100 + b as n from v)
    select event_id, case q when 0 then n >= 102 and not (n = 102 and kind = 1) when 1 then n >= 103 and n < 200 and not (n = 103 and kind = 1) when 2 then a = 1 when 3 then n <> 102 and n < 300 and n >= 0 or n = 102 and kind <> 0
      when 4 then n > 102 when 5 then n < 201 when 6 then n = 203 and kind = 1 else null end as ok from k"""
)
def x1_python_constraints(spark, sf_dir):
    i, q = F.col("event_id"), F.col("user_id") % 8
    version = F.concat(F.concat_ws(".", i % 4, i % 5), F.when(i % 3 == 1, "rc1").when(i % 3 == 2, ".post2").otherwise(".0"))
    wanted = [">=1.2", "~=1.3", "==1.*", "!=1.2, <3", ">1.2", "< 2.1", "==2.3rc1", "newest"]
    requirement = F.element_at(F.array(*map(F.lit, wanted)), (q + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", pep440_satisfies(version, requirement).alias("ok"))


@query(
    """with q as (select 2 * item_id as query_id, lower(trim(regexp_extract(text, '^(\\S+\\s+\\S+)', 1))) as q from benchmark union all select 2 * item_id + 1, lower(trim(text)) from benchmark union all select -1, 'sr' union all select -2, 'q'),
    m as (select query_id, doc_id, case when lower(source) = q or ends_with(lower(source), '.' || q) or ends_with(lower(source), '::' || q) then 0 when contains(lower(source), q) then 1 else 2 end as rank from q join documents on contains(lower(source || ' ' || text || ' ' || lang), q) where q <> ''),
    n as (select *, row_number() over (partition by query_id order by rank, doc_id) as place from m) select query_id, doc_id, rank, place from n where place <= 12"""
)
def o1_search_many(spark, sf_dir):
    entries = read(spark, sf_dir, "documents").select(F.col("source").alias("title"), "text", F.col("lang").alias("package"), F.col("doc_id").alias("ordinal"))
    b, i = read(spark, sf_dir, "benchmark"), F.col("item_id")
    asked = b.select((2 * i).alias("query_id"), F.regexp_extract("text", r"^(\S+\s+\S+)", 1).alias("query")).unionAll(b.select(2 * i + 1, "text"))
    asked = asked.unionByName(spark.createDataFrame([(-1, "sr"), (-2, "q")], "query_id long, query string"))
    found = search.search_many(entries, search.build_index(entries), asked)
    return found.select("query_id", F.col("ordinal").alias("doc_id"), "rank", F.col("place").cast("bigint").alias("place"))


_BRACKETS = "case r % 3 when 0 then '[' when 1 then '<' else '(' end", "case r % 3 when 0 then ']' when 1 then '>' else ')' end"


@query(
    f"""with c as (select n_regionkey as r, n_nationkey as n, 'c' || c_custkey as t, row_number() over (partition by n_nationkey order by c_custkey) as i from customer join nation on n_nationkey = c_nationkey),
    f as (select r, n, case n % 3 when 0 then max(t) filter (where i = 1) || {_BRACKETS[0]} || coalesce(string_agg(t, ', ' order by i) filter (where i > 1), '') || {_BRACKETS[1]} when 1 then string_agg(t, ' | ' order by i) else string_agg(t, ', ' order by i) end as t from c group by r, n),
    g as (select n_regionkey as r, n_nationkey as n, coalesce(f.t, case when n_nationkey % 3 = 0 then {_BRACKETS[0].replace('r %', 'n_regionkey %')} || {_BRACKETS[1].replace('r %', 'n_regionkey %')} else '' end) as t from nation left join f on f.n = n_nationkey)
    select r as tree, 'R' || r || {_BRACKETS[0]} || string_agg(t, ', ' order by n) || {_BRACKETS[1]} as text from g group by r"""
)
def x23_expressions(spark, sf_dir):
    n, c, none = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer"), F.lit(None).cast("string")
    r = F.col("n_regionkey").alias("tree")
    eco = F.when(F.col("n_regionkey") % 3 == 0, "python").when(F.col("n_regionkey") % 3 == 1, "rust").otherwise("r").alias("ecosystem")
    place = (F.col("n_nationkey") + 1).cast("int")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "apply").when(F.col("n_nationkey") % 3 == 1, "union").otherwise("sequence")
    roots = n.select(r, F.array().cast("array<int>").alias("way"), F.lit("apply").alias("kind"), none.alias("text"), eco).distinct()
    names = n.select(r, F.array(F.lit(0)), F.lit("name"), F.concat(F.lit("R"), "n_regionkey"), eco).distinct()
    nations = n.select(r, F.array(place), kind, none, eco)
    leaves = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(r, F.array(place, F.col("c_custkey").cast("int")), F.lit("literal"), F.concat(F.lit("c"), "c_custkey"), eco)
    return signatures.fold_expressions(roots.unionAll(names).unionAll(nations).unionAll(leaves))


@query(
    """with p as (select c_custkey // 4 as g, c_custkey % 4 as i, c_custkey // 4 % 3 as eco, case c_custkey % 4 when 0 then 'po' when 1 then 'p' when 2 then case when c_custkey // 4 % 2 = 1 then 'ko' else 'vp' end else 'ko' end as kind,
      'p' || c_custkey % 4 as name, case when c_custkey % 3 > 0 then 'A' || repeat(c_mktsegment, c_nationkey % 4) end as ann, case when c_custkey % 5 = 0 then c_nationkey end as def from customer),
    m as (select *, min(i) filter (where kind = 'ko') over (partition by g) as k, min(i) filter (where kind = 'vp') over (partition by g) as v from p),
    t as (select *, case when eco = 1 then name || coalesce('::' || ann, '') || case when kind = 'vp' then '...' else '' end || coalesce(' = ' || def, '')
      else case when eco = 0 and kind = 'vp' then '*' else '' end || name || coalesce(': ' || ann, '') || coalesce(' = ' || def, '') end as part from m),
    s as (select g, eco, list(case when eco = 0 and kind = 'ko' and i = k and (v is null or v > k) then ['*', part] when eco = 0 and kind = 'po' then [part, '/'] else [part] end order by i) as ps,
      string_agg(part, ', ' order by i) filter (where kind <> 'ko') as pos, string_agg(part, ', ' order by i) filter (where kind = 'ko') as kw from t group by g, eco),
    l as (select *, 'f' || g || '(' || array_to_string(flatten(ps), ', ') || ')' || case when g % 5 = 0 then ' -> R' else '' end as short from s)
    select g as item, case when eco = 1 then 'f' || g || '(' || coalesce(pos, '') || coalesce('; ' || kw, '') || ')' || case when g % 5 = 0 then '::R' else '' end
      when length(short) > 80 then 'f' || g || '(' || chr(10) || '    ' || array_to_string(flatten(ps), ',' || chr(10) || '    ') || chr(10) || ')' || case when g % 5 = 0 then ' -> R' else '' end else short end as signature from l"""
)
def x23_signatures(spark, sf_dir):
    k = F.col("c_custkey")
    g, i = F.floor(k / 4), k % 4
    kind = F.when(i == 0, "positional-only").when(i == 1, "positional").when((i == 2) & (g % 2 == 0), "variadic-positional").otherwise("keyword-only")
    params = read(spark, sf_dir, "customer").select(
        g.alias("item"), k.alias("ord"), F.concat(F.lit("p"), i).alias("name"), kind.alias("kind"), F.when(k % 3 > 0, F.concat(F.lit("A"), F.expr("repeat(c_mktsegment, c_nationkey % 4)"))).alias("annotation"),
        F.when(k % 5 == 0, F.col("c_nationkey").cast("string")).alias("default"),
    )
    item = F.col("item")
    items = params.select("item").distinct().select("item", F.concat(F.lit("f"), item).alias("name"), F.when(item % 3 == 0, "python").when(item % 3 == 1, "julia").otherwise("r").alias("ecosystem"), F.when(item % 5 == 0, "R").alias("returns"))
    return signatures.callable_signatures(items, params)
