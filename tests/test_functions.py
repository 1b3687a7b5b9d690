from datetime import datetime  # noqa: F401

import pytest
from pyspark.sql import functions as F

from recordloom.functions import canonical as C
from recordloom.functions import text as X
from recordloom.functions import versions as V


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, value, wanted",
    [
        (X.html_escape, "<a href=\"x\">'&", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;"),
        (X.slugify, "  Hello, Wörld! ", "hello-wörld"),
        (X.slugify, "!!", "section"),
        (X.label, "data-frame_api", "Data frame api"),
        (X.clean_route, "index.html", ""),
        (X.clean_route, "a/index.html", "a/"),
        (X.clean_route, "a/b.html", "a/b"),
        (X.atom, "a b/é", "a%20b%2F%C3%A9"),
        (X.json_string, 'a"\\\t', '"a\\"\\\\\\u0009"'),
        (X.normal_path, "a/./b/../c", "a/c"),
        (X.normal_path, "../a", None),
        (X.normal_path, "/a", None),
        (X.strip_control_codes, "\x1b[31mred\x1b[0m\x07!\n", "red!\n"),
        (X.strip_control_codes, "a\x1b]0;title", "a"),
        (X.url_allowed, "https://x/y?z=1+2", True),
        (X.url_allowed, "javascript:alert(1)", False),
        (X.url_allowed, "https://u:p@x/", False),
        (X.url_allowed, "https://x/%0a", False),
        (X.url_allowed, "https:/u:p@x/", False),
        (X.url_allowed, "https:u@x", False),
        (X.url_allowed, "https://", False),
        (X.url_allowed, "https://x/%C2%85", False),
        (X.url_allowed, "mailto:a@b.c", True),
        (X.url_allowed, "http://x?q=a@b", True),
        (X.site_url, "https://x.org/docs", "https://x.org/docs/"),
        (X.site_url, "http://x.org/", "http://x.org/"),
        (X.site_url, "https://u@x.org/", None),
        (X.site_url, "https://x.org/?q", None),
        (X.site_url, "/docs", None),
        (X.kernel_language, "Python3", "python"),
        (X.kernel_language, "R", "r"),
        (X.media_type, "a/B.png", "image/png"),
        (X.media_type, "a/B.PNG", "application/octet-stream"),
        (X.media_type, "x.webmanifest", "application/manifest+json"),
        (X.media_type, "a/.css", "application/octet-stream"),
        (X.media_type, "a/b", "application/octet-stream"),
        (X.valid_label, "fig-1.a", True),
        (X.valid_label, "1a", False),
    ],
)
def test_text(spark, make, value, wanted):
    assert one(spark, make(F.col("v")), v=value) == wanted


@pytest.mark.parametrize("base, target, wanted", [("a/b/c.html", "a/d.html", "../d.html"), ("x.html", "y/z.html", "y/z.html"), ("a/b.html", "a/c.html", "c.html"), ("a/b/c.html", "d/e.html", "../../d/e.html")])
def test_relative_url(spark, base, target, wanted):
    assert one(spark, X.relative_url(F.col("b"), F.col("t")), b=base, t=target) == wanted


def test_lines_count_bytes(spark):
    assert one(spark, X.line_number(F.col("t"), F.lit(4)), t="éa\nb") == 2
    assert one(spark, X.line_slice(F.col("t"), F.lit(2), F.lit(3)), t="a\nb\nc") == "b\nc"
    assert one(spark, X.line_slice(F.col("t"), F.lit(2), F.lit(4)), t="a\nb\nc") is None


@pytest.mark.parametrize(
    "ecosystem, version, constraint, wanted",
    [
        ("cargo", "1.2.3", "1.2", True),
        ("cargo", "2.0.0", "^1.2", False),
        ("cargo", "0.3.0", "^0.2.1", False),
        ("cargo", "1.0.0-beta", "^1", False),
        ("cargo", "1.2.0", "bad", None),
        ("python", "2.1", ">=2,<3", True),
        ("python", "3.0", ">=2,<3", False),
        ("python", "x", ">=2", None),
        ("r", "1.10", ">= 1.9", True),
        ("r", "1.2-0", "== 1.2", True),
        ("r", "1.2", "1.2", None),
        ("julia", "1.2", "1", None),
    ],
)
def test_satisfies(spark, ecosystem, version, constraint, wanted):
    assert one(spark, V.satisfies(F.col("e"), F.col("v"), F.col("c")), e=ecosystem, v=version, c=constraint) is wanted


def test_canonical_json_orders_by_bytes(spark):
    text = '{"\U0001f600": 1, "ｚ": {"b": 1.50, "a": [2, 1]}}'
    assert one(spark, C.canonical_json(F.col("t")), t=text) == '{"ｚ":{"a":[2,1],"b":1.5},"\U0001f600":1}'
    assert one(spark, C.canonical_json(F.col("t")), t="no json") is None


def test_fingerprints_do_not_depend_on_key_order(spark):
    f = C.record_fingerprint(F.lit("item"), F.lit("p"), F.lit("i"), F.col("c"))
    a, b = one(spark, f, c='{"a":1,"b":2}'), one(spark, f, c='{"b":2,"a":1}')
    assert a == b and len(a) == 64 and a != one(spark, f, c='{"a":1,"b":3}')


def test_empty_inputs_fingerprint(spark):
    import hashlib

    none = F.array().cast("array<struct<path:string,digest:string>>")
    wanted = hashlib.sha256(b"recordloom/declared-inputs-v1\0[]").hexdigest()
    assert one(spark, C.inputs_fingerprint(F.col("r"), none), r="repo") == wanted


@pytest.mark.parametrize(
    "text, fine",
    [
        ('{"a":[1,-2,null,true,"\u00e9"],"b":{}}', True), ('{"b":1,"a":2}', False), ('{"a": 1}', False), ('{"a":1.0}', False), ('{"a":1,"a":1}', False), ('{"\u00e9":1}', False),
        ("18446744073709551615", True), ("18446744073709551616", False), ("NaN", False), ("[" * 128 + "]" * 128, True), ("[" * 130 + "]" * 130, False), ("", False), (None, False),
    ],
)
def test_restricted_json(text, fine):
    assert C.restricted(text) == (text if fine else None)
