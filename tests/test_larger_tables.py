"""Queries and operators on tables that are larger, or laid out otherwise, than the driver's small ones."""

import random
import time

from pyspark.sql import functions as F

from recordloom.operators import graphs, search, site, tables
from recordloom.plans import queries
from recordloom.streaming import outputs


def test_redirects_beyond_the_limit_of_a_file(spark, tmp_path):
    n = site.MAX_REDIRECTS + 100
    spark.range(n).withColumnRenamed("id", "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["j19_redirect_violations"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(("missing-target", f"old{i}") for i in range(1, n, 2))
    rules = spark.range(n).select(F.concat(F.lit("old"), "id").alias("source"), F.lit("a").alias("target"))
    pages = spark.createDataFrame([("a", True)], "route string, visible boolean")
    assert [tuple(r) for r in site.redirect_violations(rules, pages).collect()] == [("too-many-rules", "")]


def test_slugs_after_a_join_by_document(spark):
    """A join that turns out small keeps its rows where the mappers left them, if nothing asks for more."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60_000, 1, 8).select(F.concat(F.lit("d"), F.col("id") % 3).alias("doc"), F.col("id").alias("ordinal"))
        ends = rows.groupBy("doc").agg(F.max("ordinal").alias("high"))
        slug = F.when(F.col("ordinal") == F.col("high"), "a-2").otherwise("a")
        got = tables.unique_slugs(rows.join(ends, "doc").select("doc", "ordinal", slug.alias("slug"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for r in got:
        i = r.ordinal // 3
        assert r.identifier == ("a" if i == 0 else "a-2-2" if i == 19_999 else f"a-{i + 1}"), r
    assert len(got) == 60_000


def test_outputs_of_a_long_cell_take_linear_time(spark):
    n, i = 160_000, F.col("id")
    events = spark.range(n).select(
        F.lit("p").alias("page"), i.alias("seq"), F.lit(1).cast("long").alias("cell"), F.when(i == 5, "clear").when(i % 2 == 0, "display").otherwise("update").alias("kind"), F.lit(None).cast("string").alias("name"),
        i.cast("string").alias("payload"), F.concat(F.lit("d"), F.floor(i / 2)).alias("display_id"), F.lit(False).alias("wait"),
    )
    began = time.time()
    got = outputs.reduce_outputs(events).agg(F.count("*"), F.sum(F.col("payload").cast("long")), F.count("problem")).first()
    assert got == (n // 2 - 3, sum(range(7, n, 2)), 0)
    assert time.time() - began < 30


def test_cycles_of_neighbours_take_few_rounds(spark, monkeypatch):
    """Rings of five, each in need of the one with half its number: 300 cycles in a tree."""
    made, settle = [], graphs.settle
    monkeypatch.setattr(graphs, "settle", lambda df: made.append(1) or settle(df))
    i = F.col("id")
    nodes = spark.range(1500).select(i.alias("node"))
    ring = nodes.select(F.col("node").alias("src"), F.expr("node - node % 5 + (node + 1) % 5").alias("dst"))
    edges = ring.unionAll(nodes.where("node % 5 = 0 and node > 0").select("node", F.expr("node div 10 * 5 + 4")))
    got = {r.node: r.component for r in graphs.strong_components(edges, nodes).collect()}
    assert got == {n: n - n % 5 for n in range(1500)} and len(made) < 20


def test_components_whatever_the_runs_of_edges(spark, monkeypatch):
    rng = random.Random(11)
    near = graphs._near_cycles
    for most in (1, 3, 1000):
        monkeypatch.setattr(graphs, "_near_cycles", lambda edges: near(edges, most))  # noqa: B023
        for _ in range(2):
            n = rng.randrange(5, 40)
            pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randrange(2 * n))]
            reach = {f"n{i}": {f"n{i}"} for i in range(n)}
            for _ in range(n):
                for a, b in pairs:
                    reach[a] |= reach[b]
            want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
            edges = spark.createDataFrame(pairs, "src string, dst string")
            got = graphs.strong_components(edges, spark.createDataFrame([(x,) for x in reach], "node string")).collect()
            assert {r.node: r.component for r in got} == want, (most, pairs)


def test_links_of_a_large_concept_are_the_work_of_several_tasks(spark):
    members = [("big", "related", "p", i) for i in range(60)] + [("small", "equivalent", "p", i) for i in (1, 2, 3)]
    concepts = spark.createDataFrame(members, "concept string, kind string, package string, item long")
    routes = spark.createDataFrame([("p", i, f"r{i // 2}", "P", f"q{i}") for i in range(60)], "package string, item long, route string, package_name string, name string")
    links = site.concept_links(concepts, routes, 5)
    want = {(f"r{a // 2}", c, f"r{b // 2}", f"P: q{b}", "Same API in" if k == "equivalent" else "Related API") for c, k, _, a in members for d, _, _, b in members if c == d and a // 2 != b // 2}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert links.where("concept = 'big'").select(F.spark_partition_id()).distinct().count() > 1


def test_an_index_is_made_without_a_shuffle(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "x.run", "é", "😀 ok", "\n", "ab"]
    data = [(rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randrange(9))) if i % 9 else None, "p", i) for i in range(200)] + [("lost", "alpha", "p", None)]
    entries = spark.createDataFrame(data, "title string, text string, package string, ordinal long")
    index = search.build_index(entries, 64, 50)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    full = {i: f"{a} {b or ''} {p}".lower() + "\0\0" for a, b, p, i in data if i is not None}
    want = {(t[k : k + 3], i // 64, i) for i, t in full.items() for k in range(len(t) - 2)}
    rows = index.collect()
    assert sorted((r.gram, r.block, o) for r in rows for o in r.ordinals) == sorted(want) and all(r.n == len(r.ordinals) for r in rows)
    found = search.search_many(entries, index, spark.createDataFrame([(1, "beta"), (2, "é")], "query_id long, query string"), 5)
    for i, q in ((1, "beta"), (2, "é")):
        assert [r.ordinal for r in found.where(F.col("query_id") == i).orderBy("place").collect()] == [r.ordinal for r in search.search(entries.where("ordinal is not null"), q, 5).collect()]
