"""Trees of digests, maintained closures, version keys, searches of many queries and signatures against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import versions
from recordloom.operators import graphs, merkle, search, signatures

FILE = "path string, digest string, mode int"


def test_digests_follow_every_change(spark):
    base = [("a/b/x", "1", 420), ("a/b/y", "2", 420), ("a/z", "3", 420), ("c/d/e/f", "4", 493), ("top", "5", None)]
    tree = {r.path: r for r in merkle.merkle_tree(spark.createDataFrame(base, FILE)).collect()}
    assert set(tree) == {"", "a", "a/b", "a/b/x", "a/b/y", "a/z", "c", "c/d", "c/d/e", "c/d/e/f", "top"} and tree["c/d/e"].depth == 3 and tree[""].parent is None
    for change, touched in ((("a/b/x", "9", 420), {"", "a", "a/b"}), (("a/z", "3", 493), {"", "a"}), (("c/d/e/f", None, 493), {"", "c", "c/d", "c/d/e"})):
        other = {r.path: r.digest for r in merkle.merkle_tree(spark.createDataFrame([change if f[0] == change[0] else f for f in base], FILE)).collect()}
        assert {p for p in tree if tree[p].directory and other[p] != tree[p].digest} == touched
    folders = spark.createDataFrame([("a", 448), ("empty", 448), ("", 493)], "path string, mode int")
    more = {r.path: r for r in merkle.merkle_tree(spark.createDataFrame(base, FILE), folders).collect()}
    assert more["a"].mode == 448 and more["a"].digest == tree["a"].digest and more["empty"].digest == hashlib.sha256(b"").hexdigest() and more[""].mode == 493
    assert merkle.merkle_tree(spark.createDataFrame([], FILE)).count() == 0


def test_differences_open_only_what_differs(spark):
    rng = random.Random(4)
    paths = [f"d{rng.randrange(4)}/e{rng.randrange(4)}/f{i}" for i in range(60)] + [f"quiet/{i}" for i in range(5)]
    before = [(p, str(rng.random()), 420) for p in paths]
    after = [(p, d if rng.random() < 0.8 or p.startswith("quiet") else "new", m if rng.random() < 0.9 or p.startswith("quiet") else 493) for p, d, m in before if p.startswith("quiet") or rng.random() < 0.9] + [("n/o/p", "1", 420), ("d0/e0/new", "2", 420)]
    after = [f for f in after if not f[0].startswith("d3/")] + [("d3", "a file now", 420)]
    x, y = (merkle.merkle_tree(spark.createDataFrame(f, FILE)) for f in (before, after))
    # What lies under folders of equal digests is not looked at: nonsense there changes nothing.
    y = y.withColumn("digest", F.when(F.col("path").startswith("quiet/"), F.lit("nonsense")).otherwise(F.col("digest")))
    got = sorted((r.path, r.directory, r.change) for r in merkle.tree_changes(x, y).collect())
    a, b = dict((p, (d, m)) for p, d, m in before), dict((p, (d, m)) for p, d, m in after)
    upper = lambda fs: {"/".join(p.split("/")[:n]) for p in fs for n in range(1, p.count("/") + 1)}
    want = [(p, False, "removed") for p in a.keys() - b.keys()] + [(p, False, "added") for p in b.keys() - a.keys()] + [(p, False, "modified") for p in a.keys() & b.keys() if a[p] != b[p]]
    want += [(p, True, "removed") for p in upper(a) - upper(b)] + [(p, True, "added") for p in upper(b) - upper(a)]
    assert got == sorted(want) and merkle.tree_changes(x, x).count() == 0
    empty = spark.createDataFrame([], x.schema)
    assert merkle.tree_changes(empty, x).where("change <> 'added'").count() == 0 and merkle.tree_changes(empty, x).count() == x.count()


def closed(edges):
    pairs = set(edges)
    while more := {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs:
        pairs |= more
    return pairs


def test_closures_kept_up_to_date_equal_fresh_ones(spark):
    rng = random.Random(12)
    frame = lambda es, a, b: spark.createDataFrame(sorted(es), f"{a} long, {b} long")
    for n, m in ((8, 12), (14, 18), (14, 26)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        removed = {e for e in edges if rng.random() < 0.25} | {(99, 98)}
        added = {(rng.randrange(n), rng.randrange(n)) for _ in range(3)} | set(rng.sample(sorted(removed), 1)) | {(n, n + 1)}
        changes = graphs.closure_changes(frame(closed(edges), "start", "node"), frame(edges, "src", "dst"), frame(added, "src", "dst"), frame(removed, "src", "dst"))
        old, new = closed(edges), closed(edges - removed | added)
        assert sorted(map(tuple, changes.collect())) == sorted([(*p, "added") for p in new - old] + [(*p, "removed") for p in old - new])
    none = frame([], "src", "dst")
    assert graphs.closure_changes(frame([(1, 2)], "start", "node"), frame([(1, 2)], "src", "dst"), none, none).count() == 0


def test_version_keys_sort_like_versions(spark):
    semver = ["0.0.9", "1.0.0-0", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0", "1.0.10", "1.2.0", "1.10.0", "10.0.0", "123456789012345678901.0.0"]
    python = ["0.9", "1.dev1", "1a1.dev2", "1a1", "1a2", "1b1", "1rc1", "1", "1+a", "1+1", "1.post1.dev1", "1.post1", "1.0.1", "1.10", "2", "1!0"]
    for names, key in ((semver, versions.semver_key), (python, versions.pep440_key)):
        mixed = names[1::2] + names[::2]
        df = spark.createDataFrame([(v,) for v in mixed], "v string")
        assert [r.v for r in df.orderBy(key(F.col("v"))).collect()] == names
    odd = spark.createDataFrame([("1.2",), ("01.2.3",), ("1.2.3-01",), ("",), (None,)], "v string")
    assert odd.where(versions.semver_key(F.col("v")).isNotNull()).count() == 0
    same = spark.createDataFrame([("1.0", "1"), ("1.0-alpha.3", "1a3"), ("V1-2", "1.0.post2"), ("1c4", "1rc4")], "a string, b string")
    assert same.where(versions.pep440_key(F.col("a")) == versions.pep440_key(F.col("b"))).count() == 4


def test_constraints(spark):
    rows = [
        ("r", "1.8-1", ">= 1.8.0, < 2.0", True), ("r", "1.8.1", ">= 2.0", False), ("r", "1.8", "== 1.8.0", True), ("r", "1.8.0", "^2.0", False), ("r", "1.8-1", "^1.8", None),
        ("python", "1.9rc1", ">=1.9", False), ("python", "1.9.post1", ">=1.9, <2", True), ("python", "1.9", "~=1.8", True), ("unknown", "1.9.0", ">=1.0", None),
        ("cargo", "0.3.5", "^0.3", True), ("cargo", "0.4.0", "^0.3", False), ("cargo", "0.0.4", "^0.0.3", False), ("cargo", "1.9.9", "~1.9", True), ("cargo", "1.10.0", "~1.9", False), ("cargo", "2.5.0", "2.*", True),
        ("cargo", "2.0.0-rc.1", "2.*", False), ("cargo", "2.0.0-rc.1", "<2", False), ("cargo", "2.0.0-rc.2", ">=2.0.0-rc.1", True), ("cargo", "2.0.1-rc.2", ">=2.0.0-rc.1", False), ("cargo", "3.0.0", "*", True),
        ("cargo", "1.2.3+build", "=1.2.3", True), ("cargo", "1.2.3", ">1.2", False), ("cargo", "1.3.0", ">1.2", True), ("cargo", "1.2.9", "<=1.2", True), ("cargo", "1.2.3", "what", None), ("cargo", "x", "1", None), ("cargo", None, "1", None),
        ("python", "1!1", ">5", True), ("python", "1.1+local", "==1.1", True), ("python", "1.1", "==1.1+local", False), ("python", "2.0.post1", ">2", False), ("python", "2.0rc1", "<2", False), ("python", "1.4.9", "==1.4.*", True),
        ("python", "1.4.9", "!=1.4.*", False), ("python", "1", "~=1", None), ("python", "1", ">=1.*", None), ("python", "1.0", "===1.0", True), ("python", "1.0", "===1", False),
    ]
    df = spark.createDataFrame(rows, "e string, v string, r string, want boolean")
    assert df.where(~versions.satisfies(F.col("e"), F.col("v"), F.col("r")).eqNullSafe(F.col("want"))).collect() == []


def test_python_constraints_equal_packaging(spark):
    specifiers = pytest.importorskip("packaging.specifiers")
    rng, rows = random.Random(2), []
    pick = lambda: rng.choice(["", "", "1!"]) + ".".join(rng.choice("012") for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "a1", "rc2"]) + rng.choice(["", "", ".post1"]) + rng.choice(["", "", ".dev3"]) + rng.choice(["", "", "+ab.1"])
    for _ in range(2500):
        version, op, wanted = pick(), rng.choice(["==", "!=", ">=", "<=", ">", "<", "~="]), pick()
        if op in "<>" and any(x in wanted for x in ("post", "dev", "a1", "rc")):
            continue  # here packaging has another reading of "of the given version"
        try:
            want = specifiers.SpecifierSet(op + wanted).contains(version, prereleases=True)
        except specifiers.InvalidSpecifier:
            want = None
        rows.append((version, op + wanted, want))
    df = spark.createDataFrame(rows, "v string, r string, want boolean")
    assert df.where(~versions.pep440_satisfies(F.col("v"), F.col("r")).eqNullSafe(F.col("want"))).limit(5).collect() == []


def test_many_searches_equal_single_ones(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "a::b", "x.run", "é", "run", "😀 ok", "\n", "ab", "%_"]
    entries = spark.createDataFrame([(rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randrange(12))) if i % 9 else None, rng.choice(["p", None]), i) for i in range(300)], "title string, text string, package string, ordinal long")
    asked = [" RUN ", "a", "b", "ab", "::", "beta x", "zzz", "alpha alpha", "é", "😀", "", "  ", "%", "\n", "p", None]
    got = search.search_many(entries, search.build_index(entries, 64), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), 7)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.place, r.ordinal, r.rank))
    for i, q in enumerate(asked):
        want = [(n, r.ordinal, r.rank) for n, r in enumerate(search.search(entries, q or "", 7).orderBy("rank", "ordinal").collect(), 1)]
        assert sorted(found.get(i, [])) == want, q


def test_expressions_and_calls(spark):
    node = "tree long, way array<int>, kind string, text string, ecosystem string"
    deep = [(2, [0] * d, "sequence" if d < 60 else "literal", None if d < 60 else "end", "r") for d in range(61)]
    rows = [
        (1, [], "union", None, "rust"), (1, [0], "apply", None, "rust"), (1, [0, 0], "name", "Vec", "rust"), (1, [0, 10], "tokens", None, "rust"), (1, [0, 10, 0], "literal", "&", "rust"), (1, [0, 10, 1], "name", "T", "rust"),
        (1, [0, 9], "name", "U", "rust"), (1, [1], "special", None, "rust"), (1, [1, 0], "literal", "dyn", "rust"), (1, [1, 1], "name", "Any", "rust"), (1, [2], "special", "as written", "rust"), (1, [2, 0], "name", "hidden", "rust"), (3, [], "apply", None, "python"),
    ]
    got = {r.tree: r.text for r in signatures.fold_expressions(spark.createDataFrame(rows + deep, node)).collect()}
    assert got == {1: "Vec<U, &T> | dyn Any | as written", 2: "end", 3: "[]"}
    assert signatures.fold_expressions(spark.createDataFrame([], node)).count() == 0
    parameter = "item string, ord int, name string, kind string, annotation string, default string"
    params = [("f", 0, "a", "positional-only", "int", None), ("f", 1, "b", "positional-only", None, "1"), ("f", 2, "args", "variadic-positional", None, None), ("f", 3, "k", "keyword-only", None, None), ("f", 4, "kw", "variadic-keyword", None, None)]
    params += [("g", 0, "a", "positional", None, None), ("g", 1, "k", "keyword-only", None, "2"), ("h", 0, "x", "positional", "Int", None), ("h", 1, "k", "keyword-only", None, "3"), ("h", 2, "rest", "variadic-keyword", None, None)]
    params += [("l", i, f"parameter{i}", "positional", "SomeType", None) for i in range(4)]
    items = spark.createDataFrame([("f", "f", "python", "str"), ("g", "g", "python", None), ("h", "M.h", "julia", "T"), ("l", "long", "rust", "R"), ("n", "none", "r", None)], "item string, name string, ecosystem string, returns string")
    got = {r.item: r.signature for r in signatures.callable_signatures(items, spark.createDataFrame(params, parameter)).collect()}
    assert got == {
        "f": "f(a: int, b = 1, /, *args, k, **kw) -> str", "g": "g(a, *, k = 2)", "h": "M.h(x::Int; k = 3, rest...)::T",
        "l": "long(\n    parameter0: SomeType,\n    parameter1: SomeType,\n    parameter2: SomeType,\n    parameter3: SomeType\n) -> R", "n": "none()",
    }
