"""Texts and trees that used to cost more than their length."""

import re
import time

import pytest
from pyspark.sql import functions as F

from recordloom.functions import canonical
from recordloom.operators import markup, tables
from recordloom.sources import files


def by_pattern(text):
    """The marks of emphasis by one pattern, which takes quadratic time where marks are not closed."""
    return re.sub(r"(\*\*|__|\*|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)


def test_emphasis_equals_the_pattern():
    import random

    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices(["*", "**", "_", "__", "~~", "a", "b ", " ", "\n", "é"], k=rng.randrange(12)))
        assert markup._unmarked(text) == by_pattern(text), repr(text)


def test_unclosed_marks_and_blank_headings_take_linear_time():
    began = time.process_time()
    for text in ("**a " * 50_000, "*a\n" * 50_000, "~~" * 60_000, "_" * 100_000):
        markup._unmarked(text)
    for line in ("# " + " " * 100_000 + "x", "#" + " " * 100_000, "# a" + " #" * 50_000):
        assert markup._HEADING.match(line)
    assert time.process_time() - began < 10


@pytest.mark.parametrize("line, title", [("# a b", "a b"), ("## a #", "a"), ("### a ###  ", "a"), ("# a#", "a#"), ("#", ""), ("# ", ""), ("#  a  ", "a"), ("# a # b", "a # b")])
def test_headings(spark, line, title):
    rows = markup.flatten(spark.createDataFrame([("d", line)], "doc string, text string")).where("kind = 'heading'").collect()
    assert [r.text for r in rows] == [title]


def test_includes_that_double_are_bounded(monkeypatch):
    monkeypatch.setattr(markup, "MAX_LINES", 5_000)
    texts = {f"f{i}": f"line\n\n{{{{< include f{i + 1} >}}}}\n\n{{{{< include f{i + 1} >}}}}\n" for i in range(40)} | {"f40": "end"}
    began = time.process_time()
    rows, problems = markup.expand("f0", texts, (), markup.MAX_LINES)
    assert len(rows) <= 5_000 and problems and all("too-long" in p for p in problems) and time.process_time() - began < 5
    small, none = markup.expand("f35", texts)
    assert not none and sum(r[0] == "end" for r in small) == 32


def test_canonical_json_refuses_what_json_lacks(spark):
    texts = ['{"b":1,"a":[1.5,null]}', '{"a":1,"a":2}', '{"x":{"a":1,"a":1}}', "NaN", "[Infinity]", "[-Infinity]", "{", None]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", canonical.canonical_json("t").alias("c")).orderBy("i").collect()]
    assert got == ['{"a":[1.5,null],"b":1}', *[None] * 7]


def test_roots_with_marks_of_patterns(spark, tmp_path):
    root = tmp_path / "a+b (1).x"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "p.md").write_text("x")
    assert [r.relative for r in files.file_tree(spark, str(root)).collect()] == ["sub/p.md"]
    assert spark.range(1).select(F.regexp_replace(F.lit("x\\Ey.z"), files.java_quoted("\\Ey."), "-")).first()[0] == "x-z"


def test_navigation_places(spark):
    pages = spark.createDataFrame([("b/x",), ("b/index.html",), ("a",), ("b/a",), ("c/z",)], "path string")
    assert sorted(map(tuple, tables.navigation_groups(pages).collect())) == [("", "a", 0), ("b", "b/a", 1), ("b", "b/index.html", 0), ("b", "b/x", 2), ("c", "c/z", 0)]
