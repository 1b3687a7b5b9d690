import json

import pytest
from pyspark.sql import functions as F

from recordloom.operators import graphs, markup, records, resolve, search, site, tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_search_ranks_and_keeps_order(spark):
    entries = spark.createDataFrame(
        [("x.fit", "", "p", 0), ("fit", "", "p", 1), ("fitting", "", "p", 2), ("other", "to fit", None, 3), ("none", "", "p", 4)],
        "title string, text string, package string, ordinal int",
    )
    found = search.search(entries, " FIT ")
    assert [(r.title, r["rank"]) for r in found.collect()] == [("x.fit", 0), ("fit", 0), ("fitting", 1), ("other", 2)]
    assert search.search(entries, "  ").count() == 0


def test_resolution_tiers(spark):
    items = spark.createDataFrame(
        [
            ("a", "a1", "m.f", ["f"], False), ("a", "a2", "m.g", None, False), ("b", "b1", "m.f", None, False),
            ("b", "b2", "only", None, False), ("a", "a3", "twice", None, False), ("a", "a4", "twice", None, False), ("a", "a5", "hidden", None, True),
        ],
        "package string, item string, qualified_name string, aliases array<string>, secondary boolean",
    )
    refs = spark.createDataFrame(
        [
            (1, "a", "m.f"), (2, None, "m.f"), (3, "a", "only"), (4, "a", "b::m.f"), (5, "a", "twice"), (6, None, "nothing"),
            (7, "a", "f"), (8, "a", "a5"), (9, None, "hidden"), (10, "a", "b::zzz"),
        ],
        "ref int, owner string, target string",
    )
    got = {r.ref: (r.status, r.item) for r in resolve.resolve_items(refs, items).collect()}
    assert got == {
        1: ("resolved", "a1"), 2: ("ambiguous", None), 3: ("resolved", "b2"), 4: ("resolved", "b1"), 5: ("ambiguous", None),
        6: ("unresolved", None), 7: ("resolved", "a1"), 8: ("resolved", "a5"), 9: ("unresolved", None), 10: ("unresolved", None),
    }


def test_range_lookup_takes_last_range_at_its_end(spark):
    ranges = spark.createDataFrame([("d", 0, 10, "x"), ("d", 10, 3000, "y")], "doc string, start long, stop long, source string")
    points = spark.createDataFrame([("d", 0), ("d", 10), ("d", 2500), ("d", 3000), ("d", 3001)], "doc string, pos long")
    assert rows(resolve.range_lookup(points, ranges), "pos", F.coalesce("source", F.lit("-"))) == [(0, "x"), (10, "y"), (2500, "y"), (3000, "y"), (3001, "-")]


def test_longest_prefix(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/x",), ("q",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",), ("a/bb",)], "root string")
    assert rows(resolve.longest_prefix(paths, roots), "path", F.coalesce("root", F.lit("-"))) == [("a/b/c", "a/b"), ("a/x", "a"), ("q", "-")]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    got = rows(graphs.closure(edges), "start", "node", "depth")
    assert ("d", "c", 3) in got and ("a", "a", 3) in got and len(got) == 12


def test_levels_and_cycles(spark):
    edges = spark.createDataFrame([("first", "second"), ("second", "first"), ("third", "first"), ("x", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in ("first", "second", "third", "x", "y")], "node string")
    assert rows(graphs.levels(edges, nodes), "node", F.coalesce("level", F.lit(-1))) == [("first", -1), ("second", -1), ("third", -1), ("x", 1), ("y", 0)]


def test_c3(spark):
    classes = spark.createDataFrame(
        [("p", "O", []), ("p", "A", ["O"]), ("p", "B", ["O"]), ("p", "C", ["A", "B"]), ("p", "L", ["L"])], "package string, cls string, bases array<string>"
    )
    got = {r.cls: r.mro for r in graphs.c3_order(classes).collect()}
    assert got["C"] == ["C", "A", "B", "O"] and got["O"] == ["O"]


def test_unique_slugs_cascade(spark):
    heads = spark.createDataFrame([("d", 0, "a"), ("d", 1, "a"), ("d", 2, "a-2"), ("d", 3, "a")], "doc string, ordinal long, slug string")
    assert [r[2] for r in rows(tables.unique_slugs(heads), "doc", "ordinal", "identifier")] == ["a", "a-2", "a-2-2", "a-3"]


def test_changed_keeps_null_values(spark):
    before = spark.createDataFrame([("a", "1"), ("b", None), ("c", "1")], "k string, v string")
    after = spark.createDataFrame([("a", "2"), ("b", None), ("d", None)], "k string, v string")
    assert rows(tables.changed(before, after, "k", "v"), "k", "change") == [("a", "modified"), ("c", "removed"), ("d", "added")]


def test_minimal_roots(spark):
    paths = spark.createDataFrame([("a",), ("a/b/c",), ("ab",), ("x/y",)], "path string")
    assert rows(tables.minimal_roots(paths), "path") == [("a",), ("ab",), ("x/y",)]


def test_assets_merge(spark):
    assets = spark.createDataFrame(
        [("1", "application/octet-stream", 3), ("1", "image/png", 3), ("2", "image/png", 1), ("2", "image/gif", 1)], "digest string, media_type string, byte_size long"
    )
    assert rows(tables.merge_assets(assets), "digest", "conflict") == [("1", False), ("2", True)]


def test_violations(spark):
    table = spark.createDataFrame(
        [
            ("package", "", "p", json.dumps({"slug": "s", "repository": "r"})), ("package", "", "q", json.dumps({"slug": "s"})),
            ("item", "p", "i", json.dumps({"children": ["j", "k"]})), ("item", "p", "j", "{}"), ("item", "zz", "k", "{}"), ("odd", "", "x", "{}"),
            ("page", "o", "x", "{}"), ("item", "p", "j", "{}"),
        ],
        "kind string, owner string, id string, content string",
    )
    codes = sorted({r.code for r in records.record_violations(table).collect()})
    assert codes == ["duplicate-key", "duplicate-slug", "missing-child", "missing-repository", "orphan-owner", "owner-not-empty", "unknown-kind"]


def test_content_fingerprint_ignores_order(spark):
    data = [("item", "p", str(i), str(i)) for i in range(50)]
    schema = "kind string, owner string, id string, fingerprint string"
    assets = spark.createDataFrame([("d", "text/plain", bytearray(b"x"))], "digest string, media_type string, bytes binary")
    a = records.content_fingerprint(spark.createDataFrame(data, schema), assets).first()[0]
    b = records.content_fingerprint(spark.createDataFrame(data[::-1], schema).repartition(3), assets).first()[0]
    c = records.content_fingerprint(spark.createDataFrame(data[1:], schema), assets).first()[0]
    assert a == b != c


def test_sitemap_limits(spark):
    urls = spark.createDataFrame([("https://x/" + "a" * (site.MAX_URL - 11),), ("https://x/" + "b" * site.MAX_URL,), ("https://x/" + "b" * site.MAX_URL,)], "url string")
    assert rows(site.sitemap_violations(urls), "code", "n") == [("url-too-long", 1)]


TEXT = """---
title: Front
---

# First {#one}

Some *text* with [a link](b.md#x) and `code`, $x^2$ and ![alt](i.png).

# First

| a | b |
|---|---|
| 1 | 2 |

- item one
  continued

```python
# no heading
```
"""


def test_document_tree(spark):
    docs = spark.createDataFrame([("d", TEXT), ("e", None)], "doc string, text string")
    tree = markup.flatten(docs)
    assert rows(markup.references(tree), "kind", "target") == [("image", "i.png"), ("link", "b.md#x")]
    assert rows(markup.anchors(tree), "anchor") == [("first",), ("one",)]
    assert rows(markup.titles(docs, tree), "doc", F.coalesce("title", F.lit("-"))) == [("d", "Front"), ("e", "-")]
    assert [r.kind for r in tree.where("doc = 'd' and path not like '%.%'").orderBy("ord").collect()] == ["heading", "paragraph", "heading", "table", "item", "code-block"]
    assert markup.has_math(tree).first().math


def test_front_matter_of_mappings_in_mappings():
    text = "---\ntitle: 'T'\nexecute:\n  echo: false\n  deep:\n    x: 1\n  eval: true\n# note: no\ntags:\n  - a\n  - b\nlast: z\nlast: y\n---\nbody"
    assert markup.front_matter(text) == (
        [("title", "T"), ("execute.echo", "false"), ("execute.deep.x", "1"), ("execute.eval", "true"), ("tags", "a"), ("tags", "b"), ("last", "z"), ("last", "y")], "body"
    )
    assert markup.front_matter("no --- here") == ([], "no --- here")


def test_inline_links():
    text = "[a [b] c](x.md) [![alt](i.png)](y.md) [ref][Key  One] [short] <https://z/> <me@x.org> `[no](code)` [plain] [t](<a b.md>) [q](e(1).md 'title')"
    defined, rest = markup.definitions(["[key one]: r.md", "[short]: <s.md> \"t\"", "```", "[in]: code.md", "```", "[key one]: later.md"])
    assert rest == ["```", "[in]: code.md", "```"] and defined == {"key one": "r.md", "short": "s.md"}
    got = [(k, to) for k, _, to in markup.inlines(text, defined) if k != "code"]
    assert got == [
        ("link", "x.md"), ("link", "y.md"), ("image", "i.png"), ("link", "r.md"), ("link", "s.md"), ("link", "https://z/"), ("link", "mailto:me@x.org"), ("link", "a b.md"), ("link", "e(1).md"),
    ]
    assert markup.plain("see [a [b] c](x.md), [none] and ![i](p.png)") == "see a [b] c, [none] and i"


def test_nested_items_and_aligned_tables(spark):
    text = "- one\n  - two [l](x.md)\n    - three\n- four\n\n| a | b | c |\n|:--|--:|---|\n| [k](y.md) | 2 | 3 |\n"
    tree = [r for r in markup.flatten(spark.createDataFrame([("d", text)], "doc string, text string")).orderBy("ord").collect()]
    items = [(r.path, r.level, r.text) for r in tree if r.kind == "item"]
    assert items == [("000000", 0, "one"), ("000000.i0000", 1, "two l"), ("000000.i0000.i0000", 2, "three"), ("000001", 0, "four")]
    assert [(r.text, r.target) for r in tree if r.kind == "cell"] == [("k", "left"), ("2", "right"), ("3", None)]
    assert [r.target for r in tree if r.kind == "link"] == ["x.md", "y.md"]


def test_code_includes():
    files = {"a.md": "x\n\n  {{< code s/f.py#L2-L3 >}}\n\n{{< code s/f.py#L9-L9 >}}\n\n{{< code ../out.py >}}", "s/f.py": "one\ntwo ```` x\nthree\n"}
    rows, problems = markup.expand("a.md", files)
    assert [r[0] for r in rows] == ["x", "", "  `````", "  two ```` x", "  three", "  `````", "", ""]
    assert rows[3][1:] == ("s/f.py", 2) and rows[2][1:] == ("a.md", 3)
    assert [p.split(": ")[1] for p in problems] == ["no-such-lines", "outside"]


def test_chunks(spark):
    text = "---\ntitle: T\n---\n\n```{r plot, echo=FALSE, fig.cap=\"a, b\"}\n#| eval: false\n#| label: 'it''s'\nx <- 1\n```\n\n```{python}\npass\n```\n\n```python\nno chunk\n```\n"
    got = markup.cells(spark.createDataFrame([("d", text), ("e", None)], "doc string, text string")).orderBy("cell").collect()
    assert [(r.doc, r.cell, r.language, r.label, r.source) for r in got] == [("d", 0, "r", "it's", "x <- 1"), ("d", 1, "python", "", "pass")]
    assert [tuple(o) for o in got[0].options] == [("echo", "FALSE", 1), ("fig.cap", "a, b", 1), ("eval", "false", 2), ("label", "it's", 2)]


def test_generated_references(spark):
    docs = spark.createDataFrame([("d", "![a](k.png) ![b](z.png) ![c](https://x/y.png) [l](javascript:x) [m](https://x/) [n](b.md)\n\n<div>x</div>")], "doc string, text string")
    got = markup.generated_references(docs, spark.createDataFrame([("d", "k.png"), ("e", "z.png")], "doc string, target string"))
    assert rows(got, F.coalesce("target", F.lit("-")), F.coalesce("problem", F.lit("-"))) == [
        ("-", "raw-html"), ("b.md", "-"), ("https://x/", "-"), ("https://x/y.png", "remote-image"), ("javascript:x", "unsafe-url"), ("k.png", "-"), ("z.png", "unbound-image"),
    ]


def test_includes(spark):
    files = {"a.md": "top\n\n{{< include sub/p.md >}}\n\nend", "sub/p.md": "part\n\n{{< include q.md >}}", "sub/q.md": "deep", "loop.md": "{{< include loop.md >}}"}
    table = spark.createDataFrame([("w", k, v) for k, v in files.items()], "project string, path string, text string")
    pages = spark.createDataFrame([("w", "a.md"), ("w", "loop.md"), ("w", "gone.md")], "project string, path string")
    got = {r.path: r for r in markup.expand_includes(table, pages).collect()}
    assert got["a.md"].text == "top\n\npart\n\ndeep\n\nend" and got["a.md"].problems == []
    assert (got["a.md"].origins[4].file, got["a.md"].origins[4].line) == ("sub/q.md", 1)
    assert "cycle" in got["loop.md"].problems[0] and got["gone.md"].text is None


@pytest.mark.parametrize(
    "fragment, safe, reason",
    [
        ('<p class="x" title="t">a &amp; b<br></p>', '<p title="t">a &amp; b<br></p>', None),
        ("<script>x</script>", None, "element"),
        ('<a href="javascript:x">y</a>', None, "url"),
        ('<td colspan="03">x', '<td colspan="3">x</td>', None),
        ('<td colspan="0">x</td>', None, "attribute"),
        ('<p onclick="x">y</p>', None, "attribute"),
        ("<img alt='x'>", None, "structure"),
        ("<!DOCTYPE html><p>x", None, "structure"),
        ('<td colspan="' + "9" * 5000 + '">x</td>', None, "attribute"),
        ('<td colspan="18446744073709551615">x</td>', '<td colspan="18446744073709551615">x</td>', None),
        ('<td colspan="18446744073709551616">x</td>', None, "attribute"),
        ('<ol start="-9223372036854775808"></ol>', '<ol start="-9223372036854775808"></ol>', None),
        ('<ol start="+07"></ol>', '<ol start="7"></ol>', None),
        ('<ol start="9223372036854775808"></ol>', None, "attribute"),
        ('<img src="javascript:x">', None, "remote-image"),
        ('<img src="a/b.png" width="010">', '<img src="a/b.png" width="10">', None),
        ('<a href="//host/x">y</a>', None, "url"),
        ('<a href="https:/u:p@h/">y</a>', None, "url"),
        ('<a href="../b.html#c">y</a>', '<a href="../b.html#c">y</a>', None),
        ('<p title="a" title="b">y</p>', None, "structure"),
        ("a<!-- c -->b", "ab", None),
        (None, "", None),
    ],
)
def test_html_policy(fragment, safe, reason):
    assert markup.html_policy(fragment) == (safe, reason)
