from pyspark.sql import functions as F

from recordloom.operators import links, selection, site, tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_links(spark):
    refs = spark.createDataFrame(
        [
            (1, "d", "https://x/y", None, None), (2, "d", "javascript:x", None, None), (3, "d", "#a", None, "a"), (4, "d", "#zz", None, "zz"),
            (5, "d", "e.md", "e.md", None), (6, "d", "e.md#b", "e.md", "b"), (7, "d", "e.md#q", "e.md", "q"), (8, "d", "two.md", "two.md", None),
            (9, "d", "i.png", "i.png", None), (10, "d", "src/x.c", "src/x.c", None), (11, "d", "gone", "gone", None),
        ],
        "ref int, doc string, spelling string, path string, fragment string",
    )
    anchors = spark.createDataFrame([("d", "a"), ("e", "b")], "doc string, anchor string")
    pages = spark.createDataFrame([("e.md", "e"), ("two.md", "f"), ("two.md", "g")], "path string, page string")
    assets = spark.createDataFrame([("i.png", "99")], "path string, digest string")
    repo = spark.createDataFrame([("src/x.c",)], "path string")
    got = {r.ref: r.kind or r.problem for r in links.resolve_links(refs, anchors, pages, assets, repo).collect()}
    assert got == {
        1: "external", 2: "unsafe-url", 3: "anchor", 4: "missing-anchor", 5: "page", 6: "page", 7: "missing-anchor", 8: "ambiguous-page",
        9: "asset", 10: "repository", 11: "missing-target",
    }


def test_asset_overlaps_either_way(spark):
    assets = spark.createDataFrame([("a/b",), ("c",), ("x",), ("x",)], "path string")
    taken = spark.createDataFrame([("a",), ("c/d.html",)], "path string")
    assert rows(links.asset_violations(assets, taken), "code", "path") == [("occupied", "a/b"), ("occupied", "c"), ("repeated", "x")]


def test_fragment_aliases_occur_once(spark):
    aliases = spark.createDataFrame([("r", "one"), ("r", "two"), ("r", "none")], "route string, alias string")
    ids = spark.createDataFrame([("r", "one"), ("r", "two"), ("r", "two")], "route string, identifier string")
    assert rows(links.fragment_alias_violations(aliases, ids), "alias", "n") == [("none", 0), ("two", 2)]


def test_exports_fold(spark):
    steps = [
        ("m", 0, "assign", ["a"]), ("m", 1, "extend", ["b", "a"]), ("n", 0, "assign", ["x"]), ("n", 1, "call", []), ("again", 0, "call", []), ("again", 1, "assign", ["y"]),
        ("early", 0, "extend", ["z"]), ("two", 0, "assign", ["a"]), ("two", 1, "append", ["b", "c"]), ("one", 0, "assign", ["a"]), ("one", 1, "append", ["b"]), ("lost", 0, "assign", ["a"]), ("lost", 1, "assign", None),
    ]
    got = {r.module: (r.names, r.dynamic) for r in selection.exported_names(spark.createDataFrame(steps, "module string, ord int, op string, names array<string>")).collect()}
    assert got == {
        "m": (["a", "b", "a"], False), "n": (None, True), "again": (["y"], False), "early": (None, True), "two": (None, True), "one": (["a", "b"], False), "lost": (None, True),
    }


def test_public_paths_end_on_cycles(spark):
    exports = spark.createDataFrame([("root", "m", "mod"), ("mod", "f", "item"), ("mod", "back", "root"), ("root", "g", "item")], "module string, name string, target string")
    roots = spark.createDataFrame([("root", "crate")], "module string, path string")
    assert rows(selection.public_paths(exports, roots), "item", "path") == [("item", "crate::g"), ("item", "crate::m::f")]
    deep = spark.createDataFrame([(f"m{i}", f"n{i + 1}", f"m{i + 1}") for i in range(70)] + [("m0", None, "m69")], "module string, name string, target string")
    found = rows(selection.public_paths(deep, spark.createDataFrame([("m0", "c")], "module string, path string")), "item", "path")
    assert found == [("m70", "c::" + "::".join(f"n{i}" for i in range(1, 71))), ("m70", "c::n70")]


def test_active_tree(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "parent string, child string")
    got = rows(selection.active_tree(edges, spark.createDataFrame([("c",)], "node string")), "node", F.col("active"))
    assert got == [("a", True), ("b", True), ("c", True), ("d", False)]


def test_documentation_lists(spark):
    items = spark.createDataFrame(
        [("p", "i1", "M.f", ["g"], False, "julia", True), ("p", "i2", "M.h", None, False, "julia", False), ("q", "i3", "only", None, False, "r", True)],
        "package string, item string, qualified_name string, aliases array<string>, secondary boolean, ecosystem string, documented boolean",
    )
    entries = spark.createDataFrame([("b", n, "p", "julia", t) for n, t in enumerate(["f", "M.h", "only", "none", "g"])], "block string, ordinal int, owner string, language string, target string")
    got = rows(selection.documentation_list(entries, items), "ordinal", F.coalesce("item", F.lit("-")), F.coalesce("problem", F.lit("-")))
    assert got == [(0, "i1", "-"), (1, "i2", "undocumented"), (2, "i3", "other-language"), (3, "-", "unresolved"), (4, "i1", "-")]


def test_titled_members_and_routes(spark):
    members = spark.createDataFrame(
        [("o", "function", None, "z", "1"), ("o", "field", None, "b", "2"), ("o", "function", "o", "y", "3"), ("o", "function", "other", "x", "4"), ("o", "enumerator", None, "a", "5"), ("o", "variable", None, "a", "6")],
        "owner string, kind string, family string, name string, id string",
    )
    got = rows(tables.titled_members(members), "position", "title", "id")
    assert got == [(0, "Fields", "6"), (1, "Fields", "2"), (2, "Methods", "1"), (3, "Overloads", "3"), (4, "Values", "5")]
    import hashlib

    digest = hashlib.sha256(b"x").hexdigest()
    made = rows(site.identity_routes(spark.createDataFrame([("page", "", "x"), ("item", "pkg", "x")], "kind string, root string, id string")), "kind", "route")
    assert made == [("item", f"pkg/reference/{digest}.html"), ("page", f"pages/{digest}.html")]
