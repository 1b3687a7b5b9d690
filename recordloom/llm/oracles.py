"""DuckDB SQL for the corpus queries that SQL can express, and queries of laws that the others must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .privacy import KINDS, op5_personal_data
from .sharding import op1_sharding

#: Components of ``link(a, b)`` over ``node(id)``: every id with the least one that it reaches.
_COMPONENTS = """both_ways as (select a, b from link union all select b, a from link),
reach as (select id, id as least from node union select w.b, r.least from reach r join both_ways w on w.a = r.id),
part as (select id, min(least) as component_id from reach group by id)"""

OP3 = f"""with recursive word as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') as ws from documents),
place as (select id, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n from word),
five as (select id, i, n, w || coalesce(' ' || lead(w, 1) over p, '') || coalesce(' ' || lead(w, 2) over p, '') || coalesce(' ' || lead(w, 3) over p, '') || coalesce(' ' || lead(w, 4) over p, '') as g
  from place window p as (partition by id order by i)),
one as (select distinct id, g from five where i = 1 or i <= n - 4),
node as (select w.id, count(o.g) as n from word w left join one o on o.id = w.id group by w.id),
shared as (select x.id as a, y.id as b, count(*) as c from one x join one y on x.g = y.g and x.id < y.id group by all),
link as (select a, b from shared join node m on m.id = a join node n on n.id = b where 100 * c >= 85 * (m.n + n.n - c)),
{_COMPONENTS}
select id as doc_id, n as n_shingles, component_id, id = component_id as kept from node join part using (id)"""

OP9 = f"""with recursive vec as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
node as (select id from vec),
scaled as (select id, v, len(v) as dim, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from vec
  where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
fine as (select id, dim, list_transform(v, lambda x: x / norm) as u from scaled where norm > 0),
link as (select x.id as a, y.id as b from fine x join fine y on x.id < y.id and x.dim = y.dim where list_dot_product(x.u, y.u) >= 0.95),
{_COMPONENTS},
degree as (select a as id, count(*) as n from both_ways group by a)
select id as vec_id, coalesce(n, 0) as n_links, component_id, id = component_id as kept from node join part using (id) left join degree using (id)"""


def sharding_laws(spark, sf_dir: str) -> DataFrame:
    """For each shard what ``op1_sharding`` put there: rows, bytes, slots, and rows that one more shard would take."""
    r = op1_sharding(spark, sf_dir)
    return r.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"),
        F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"),
        F.count_if(F.col("grown_shard") == 8).alias("moved"), F.count_if((F.col("grown_shard") != 8) & (F.col("grown_shard") != F.col("shard"))).alias("misplaced"),
    )


_SHARD = "list_max([{{'h': md5(doc_id || ':20240607:' || i), 'i': i}} for i in range({n})]).i"
SHARDING_LAWS = f"""with s as (select doc_id, strlen(coalesce(text, '')) + 1 as size, {_SHARD.format(n=8)} as shard, {_SHARD.format(n=9)} as grown from documents)
select cast(shard as integer) as shard, count(*) as rows, cast(sum(size) as bigint) as bytes, cast(0 as bigint) as first_slot, count(*) - 1 as last_slot, count(*) as slots,
  count(*) filter (where grown = 8) as moved, count(*) filter (where grown <> 8 and grown <> shard) as misplaced from s group by shard"""


def base_personal_data(spark, sf_dir: str) -> DataFrame:
    """The part of ``op5_personal_data`` that patterns decide."""
    return op5_personal_data(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256")


BASE_PERSONAL_DATA = """with kinds(kind, ord, pattern) as (values ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+'),
  ('ip', 1, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), ('card', 2, '[0-9]([\\x20-]?[0-9])+'), ('phone', 3, '\\+[0-9][\\x20().0-9-]+[0-9]')),
cut as (select doc_id, kind, ord, string_split(regexp_replace(coalesce(text, ''), '(' || pattern || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as parts from documents, kinds),
part as (select doc_id, kind, ord, unnest(parts) as p, generate_subscripts(parts, 1) as i from cut where len(parts) > 1),
hit as (select doc_id, kind, ord, i, split_part(p, chr(2), 1) as t,
  cast(sum(length(replace(p, chr(2), ''))) over (partition by doc_id, kind order by i) - length(replace(p, chr(2), '')) as bigint) as start from part),
digits as (select *, regexp_replace(t, '[^0-9]', '', 'g') as d from hit where i > 1),
fine as (select * from digits where case kind when 'email' then true
  when 'ip' then len(list_filter(string_split(t, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as integer), 0) > 255)) = 0
  when 'phone' then length(d) between 9 and 15
  else length(d) between 12 and 19 and list_sum(list_transform(string_split(reverse(d), ''), lambda c, j:
    case when j % 2 = 1 then cast(c as integer) else cast(c as integer) * 2 - case when cast(c as integer) > 4 then 9 else 0 end end)) % 10 = 0 end),
found as (select doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card,
  count(*) filter (where kind = 'phone') as n_phone, string_agg(kind || ':' || start || ':' || (start + length(t)), ',' order by start, ord) as spans from fine group by doc_id)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(spans, '')) as base_sha256
  from documents left join found using (doc_id)"""

def _op11(k: int = 40, rounds: int = 5) -> str:
    """Rounds of plain assignment, written out; equal components are added up as whole numbers."""
    near = """a{n} as (select id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)) as best from q, c{n} group by id, v)"""
    move = """s{n} as (select best.c as c, i, sum(x) as s, count(*) as m from (select best, unnest(v) as x, generate_subscripts(v, 1) as i from a{n}) group by 1, 2),
t{n} as (select c, list((s - ((s % m) + m) % m) // m order by i) as w from s{n} group by c),
c{o} as (select c, coalesce(t{n}.w, c{n}.w) as w from c{n} left join t{n} using (c))"""
    steps = [f"{near.format(n=n)},\n{move.format(n=n, o=n + 1)}" for n in range(rounds)] + [near.format(n=rounds)]
    body = ",\n".join(steps)
    return f"""with q as (select vec_id as id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by sha256('2:' || id)) - 1 as c, v as w from q order by sha256('2:' || id) limit {k}),
{body},
part as (select best.c as c, sum(best.d) as s from a{rounds} group by 1)
select id as vec_id, cast(best.c as integer) as cluster, cast(best.d as bigint) as distance, cast(part.s as bigint) as cluster_inertia,
  cast((select sum(s) from part) as bigint) as inertia, sha256(array_to_string(c{rounds}.w, ',')) as centroid_sha256
from a{rounds} join part on part.c = best.c join c{rounds} on c{rounds}.c = best.c"""


OP11 = _op11()

#: Every turn after at most two insertions, by four states of the roles so far: nothing, a system turn, a user's, an assistant's.
OP13 = """with recursive raw as (select conv_id as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
hashed as (select *, xor(list_reduce(list_transform(string_split(key, ''), lambda x: cast(ord(x) as bigint)),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: case when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end, xor(c, b)), 4294967295), 4294967295) % 20 as h from raw),
damage as (select conv, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case when h = 3 then [0, 1] else [0] end) as copy from hashed where h <> 0),
placed as (select *, row_number() over (partition by conv order by turn nulls first, role, sha256(text), copy) as i, substr(role, 1, 1) as letter,
  trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as seen from damage),
tok as (select *, case when seen = '' then 'blank' when row_number() over (partition by conv, role, text order by i) > 1 then 'duplicate' when not (right(seen, 1) in ('.', '!', '?')) then 'truncated' end as fault,
  lag(letter) over (partition by conv order by i) as before from placed),
facts as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where before is not null and not (before || letter in ('su', 'ua', 'au'))) as illegal, max(i) as n from tok group by conv),
ins(p, q, k) as (values (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
op(q, r, edit, letter, price) as (values (0, 0, 'D', null, 3), (1, 1, 'D', null, 3), (2, 2, 'D', null, 3), (3, 3, 'D', null, 3), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0),
  (2, 3, 'K', 'a', 0), (0, 2, 'R', null, 2), (1, 2, 'R', null, 2), (3, 2, 'R', null, 2), (2, 3, 'R', null, 2)),
step as (select conv, cast(0 as bigint) as i, 0 as state, struct_pack(c := cast(0 as bigint), a := '') as best from facts union all
  select t.conv, t.i, o.r, min(struct_pack(c := s.best.c + 2 * n.k + o.price + case when o.edit <> 'D' and t.fault = 'truncated' then 1 else 0 end, a := s.best.a || repeat('I', n.k) || o.edit))
  from step s join tok t on t.conv is not distinct from s.conv and t.i = s.i + 1 join ins n on n.p = s.state join op o on o.q = n.q and (o.letter is null or o.letter = t.letter)
  where o.edit = 'D' or t.fault is null or t.fault = 'truncated' group by t.conv, t.i, o.r),
done as (select f.conv, min(struct_pack(c := s.best.c + 2 * n.k, a := s.best.a || repeat('I', n.k))) as best from step s join facts f on f.conv is not distinct from s.conv and f.n = s.i
  join ins n on n.p = s.state and n.q in (0, 3) group by f.conv),
edit as (select conv, unnest(string_split(best.a, '')) as e, generate_subscripts(string_split(best.a, ''), 1) as p from done where best.a <> ''),
spot as (select *, count(*) filter (where e <> 'I') over (partition by conv order by p) as i from edit),
kept as (select x.conv, x.p, x.e, t.role, t.text, t.letter = 's' and x.e = 'K' as opening from spot x left join tok t on t.conv is not distinct from x.conv and t.i = x.i and x.e <> 'I' where x.e <> 'D'),
named as (select conv, p, case when e = 'K' then role when count(*) filter (where opening is distinct from true) over (partition by conv order by p) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, '') as line from kept),
hash as (select conv, string_agg(line, chr(10) order by p) as lines from named group by conv)
select c.conv as conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(d.best.c, 0) as cost, coalesce(d.best.a, '') as audit, sha256(coalesce(lines, '')) as repaired_sha256
from (select distinct conv from raw) c left join facts f on f.conv is not distinct from c.conv left join done d on d.conv is not distinct from c.conv left join hash h on h.conv is not distinct from c.conv"""

QUERIES = {"sharding_laws": sharding_laws, "base_personal_data": base_personal_data}
ORACLES = {"op3_minhash": OP3, "op9_embedding_dedup": OP9, "op11_centroids": OP11, "op13_conversation_repair": OP13, "sharding_laws": SHARDING_LAWS, "base_personal_data": BASE_PERSONAL_DATA}
