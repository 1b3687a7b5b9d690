"""Version constraints in built-in functions: versions become arrays of strings that compare in the order of versions.

So constraints are ranges of keys, which filters, sorts and joins understand. Numbers of any length compare by their
length and then their digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_version(col: Column) -> Column:
    """The parts of a version like ``1.2-3`` as an array of numbers; null for anything else."""
    parts = F.split(col, "[.-]")
    return F.when(F.forall(parts, lambda p: F.regexp_like(p, F.lit("^[0-9]+$"))), F.transform(parts, lambda p: p.cast("decimal(20,0)")))


def _padded(a: Column, width: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0).cast("decimal(20,0)"), width - F.size(a)))


def numeric_equal(a: Column, b: Column) -> Column:
    """Whether two numeric versions are equal, missing parts being zero; false if either is none."""
    x, y = numeric_version(a), numeric_version(b)
    width = F.greatest(F.size(x), F.size(y))
    return F.coalesce(_padded(x, width) == _padded(y, width), F.lit(False))


def numeric_satisfies(version: Column, requirement: Column) -> Column:
    """A conjunction like ``>= 1.2, < 2``; null if a part cannot be read."""
    actual = numeric_version(version)

    def holds(part: Column) -> Column:
        op = F.regexp_extract(part, r"^\s*(>=|<=|==|!=|>|<|=)", 1)
        wanted = numeric_version(F.trim(F.regexp_replace(part, r"^\s*(?:>=|<=|==|!=|>|<|=)", "")))
        width = F.greatest(F.size(actual), F.size(wanted))
        a, b = _padded(actual, width), _padded(wanted, width)
        test = F.when(op == ">=", a >= b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == "<", a < b)
        return F.when(op != "", test.when(op == "!=", a != b).when(op.isin("==", "="), a == b))

    tests = F.transform(F.split(requirement, ","), holds)
    return F.when(actual.isNotNull() & ~F.exists(tests, lambda t: t.isNull()), F.forall(tests, lambda t: t))


def _number(text: Column) -> Column:
    """A text of digits that compares like its number: without leading zeros, behind its length."""
    plain = F.regexp_replace(text, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 4, "0"), plain)


_ZERO = "00010"
_SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-((?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+[0-9A-Za-z.-]+)?$"
_PART = r"^\s*(\^|~|>=|<=|>|<|=)?\s*([0-9]+|[*xX])(?:\.([0-9]+|[*xX]))?(?:\.([0-9]+|[*xX]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"


def _with_pre(core: Column, pre: Column) -> Column:
    """A release sorts after its pre-releases; numbers sort before other identifiers, and fewer before more."""
    names = F.transform(F.split(pre, r"\."), lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]+$")), F.concat(F.lit("0"), _number(p))).otherwise(F.concat(F.lit("1"), p)))
    return F.concat(core, F.when(pre == "", F.array(F.lit("1"))).otherwise(F.concat(F.array(F.lit("0")), names)))


def _semver_core(version: Column) -> Column:
    return F.array(*[_number(F.regexp_extract(version, _SEMVER, i)) for i in (1, 2, 3)])


def semver_key(version: Column) -> Column:
    """An array of strings that compares like the semantic version; null for anything else. Build tags do not count."""
    return F.when(F.regexp_like(version, F.lit(_SEMVER)), _with_pre(_semver_core(version), F.regexp_extract(version, _SEMVER, 4)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _semver_part(part: Column) -> Column:
    """A comparator as a struct: ``low`` and ``high`` keys (``low`` is met, ``high`` is not; null is no bound), and ``pre``,
    the numbers of its own pre-release. Null if it cannot be read."""
    star = ("*", "x", "X")
    read = F.when(F.regexp_like(part, F.lit(_PART)), F.struct(*[F.regexp_extract(part, _PART, i).alias(n) for i, n in enumerate(("op", "a", "b", "c", "pre"), 1)]))

    def places(r: Column) -> Column:
        known = F.when(r["a"].isin(*star), 0).when(r["b"].isin("", *star), 1).when(r["c"].isin("", *star), 2).otherwise(3)
        wild = r["a"].isin(*star) | r["b"].isin(*star) | r["c"].isin(*star)
        op = F.when(wild & r["op"].isin("", "="), "=").when(r["op"] == "", "^").otherwise(r["op"])
        plain = F.array(F.when(r["a"].isin(*star), "0").otherwise(r["a"]), F.when(r["b"].isin("", *star), "0").otherwise(r["b"]), F.when(r["c"].isin("", *star), "0").otherwise(r["c"]))
        fits = r.isNotNull() & ((r["pre"] == "") | (known == 3))
        return F.when(fits, F.struct(op.alias("op"), known.alias("known"), plain.alias("plain"), F.transform(plain, _number).alias("low"), r["pre"].alias("pre")))

    def after(r: Column) -> Column:
        zero = F.transform(r["low"], lambda x: x == _ZERO)
        nonzero = F.when(~zero[0], 0).when((r["known"] > 1) & ~zero[1], 1).when((r["known"] > 2) & ~zero[2], 2).otherwise(r["known"] - 1)
        place = F.when(r["op"] == "^", nonzero).when(r["op"] == "~", F.least(F.lit(1), r["known"] - 1)).otherwise(r["known"] - 1)
        one_more = lambda x: _number((x.cast("decimal(38,0)") + 1).cast("string"))
        # The first version beyond those that share the given places; its pre-releases are beyond as well.
        rest = _let(F.greatest(place, F.lit(0)), lambda p: F.concat(F.slice(r["low"], F.lit(1), p), F.array(one_more(r["plain"][p])), F.array_repeat(F.lit(_ZERO), 2 - p)))
        return F.struct(r["op"].alias("op"), r["known"].alias("known"), r["low"].alias("low"), r["pre"].alias("pre"), rest.alias("after"), _with_pre(r["low"], r["pre"]).alias("wanted"))

    def bounds(r: Column) -> Column:
        op, exact, end, none = r["op"], r["known"] == 3, F.array(F.lit("")), F.lit(None).cast("array<string>")
        above, beyond = F.concat(r["wanted"], end), F.concat(r["after"], end)  # right behind the wanted version; before the next ones
        whole = F.concat(r["low"], F.array(F.lit("0")))  # with all pre-releases, but for what the rule of pre-releases says
        low = (
            F.when((op == "=") & ~exact, whole).when(op.isin("^", "~", ">=", "="), r["wanted"]).when((op == ">") & exact, above)
            .when(op == ">", F.concat(r["after"], F.array(F.lit("0"))))
        )
        high = F.when(op.isin("^", "~"), beyond).when(op == "<", r["wanted"]).when(op.isin("=", "<=") & exact, above).when(op.isin("=", "<="), beyond)
        some = r["known"] > 0
        return F.when(r.isNotNull(), F.struct(F.when(some, low).otherwise(none).alias("low"), F.when(some, high).otherwise(none).alias("high"), F.when(r["pre"] != "", r["low"]).otherwise(none).alias("pre")))

    return _let(_let(_let(read, places), lambda r: F.when(r.isNotNull(), after(r))), bounds)


def semver_bounds(requirement: Column) -> Column:
    """(low, high, pre) of a comma-separated requirement: versions with ``low <= key < high`` meet all comparators, where
    null is no bound. A pre-release has to have the numbers of one in ``pre`` as well. Null if it cannot be read."""

    def whole(parts: Column) -> Column:
        lows, highs, pres = (F.array_compact(parts[n]) for n in ("low", "high", "pre"))
        return F.when(~F.exists(parts, lambda p: p.isNull()), F.struct(F.array_max(lows).alias("low"), F.array_min(highs).alias("high"), pres.alias("pre")))

    return _let(F.transform(F.split(requirement, ","), _semver_part), whole)


def within(key: Column, bounds: Column) -> Column:
    """Whether a key of ``semver_key`` lies within ``semver_bounds``; null if either is."""

    def test(both: Column) -> Column:
        k, b = both["key"], both["bounds"]
        inside = (b["low"].isNull() | (k >= b["low"])) & (b["high"].isNull() | (k < b["high"]))
        return F.when(k.isNotNull() & b.isNotNull(), inside & ((F.element_at(k, 4) != "0") | F.array_contains(b["pre"], F.slice(k, 1, 3))))

    return _let(F.struct(key.alias("key"), bounds.alias("bounds")), test)


def semver_satisfies(version: Column, requirement: Column) -> Column:
    """Whether a semantic version meets a comma-separated requirement; null if either cannot be read."""
    return within(semver_key(version), semver_bounds(requirement))


#: Groups: epoch, release, kind and number of the pre-release, number of a post-release (two spellings), of the
#: development release, and the local part.
_PEP440 = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]+)?)?"
    r"((?:-([0-9]+))|(?:[-_.]?(?:post|rev|r)[-_.]?([0-9]+)?))?([-_.]?dev[-_.]?([0-9]+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)


def _pep440(text: Column) -> Column:
    """The parts of a Python version as a struct, with keys that compare like it; null for anything else.

    ``base`` is epoch and release, ``public`` leaves the local part out, ``key`` is the whole.
    """
    plain = F.lower(F.trim(text))
    names = ("epoch", "release", "kind", "pre", "post", "post1", "post2", "dev", "dev_n", "local")
    read = F.when(F.regexp_like(plain, F.lit(_PEP440)), F.struct(*[F.regexp_extract(plain, _PEP440, i).alias(n) for i, n in enumerate(names, 1)]))
    number = lambda x: _number(F.when(x == "", "0").otherwise(x))

    def parts(r: Column) -> Column:
        has_pre, has_post, has_dev = r["kind"] != "", r["post"] != "", r["dev"] != ""
        code = F.when(r["kind"].isin("a", "alpha"), "a").when(r["kind"].isin("b", "beta"), "b").otherwise("rc")
        before = F.when(has_pre, F.concat(F.lit("1"), code, number(r["pre"]))).when(~has_post & has_dev, "0").otherwise("2")
        behind = F.when(has_post, F.concat(F.lit("1"), number(F.concat(r["post1"], r["post2"])))).otherwise("0")
        made = F.when(has_dev, F.concat(F.lit("0"), number(r["dev_n"]))).otherwise("1")
        # Trailing zeros do not count; the end of the release sorts before any further number.
        short = F.transform(F.split(F.regexp_replace(r["release"], r"(\.0+)+$", ""), r"\."), _number)
        local = F.transform(F.split(r["local"], "[-_.]"), lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]+$")), F.concat(F.lit("1"), _number(p))).otherwise(F.concat(F.lit("0"), p)))
        return F.struct(
            number(r["epoch"]).alias("epoch"), F.transform(F.split(r["release"], r"\."), _number).alias("release"), (has_pre | has_dev).alias("is_pre"), has_post.alias("is_post"),
            (r["local"] != "").alias("is_local"), F.concat(F.array(number(r["epoch"])), short, F.array(F.lit(""))).alias("base"), F.array(before, behind, made).alias("marks"), local.alias("local"),
        )

    def keys(r: Column) -> Column:
        public = F.concat(r["base"], r["marks"])
        held = [r[n].alias(n) for n in ("epoch", "release", "is_pre", "is_post", "is_local", "base")]
        return F.struct(*held, public.alias("public"), F.when(r["is_local"], F.concat(public, r["local"])).otherwise(public).alias("key"))

    return _let(_let(read, lambda r: F.when(r.isNotNull(), parts(r))), lambda r: F.when(r.isNotNull(), keys(r)))


def pep440_key(version: Column) -> Column:
    """An array of strings that compares like the Python version; null for anything else."""
    return _pep440(version)["key"]


def pep440_satisfies(version: Column, requirement: Column) -> Column:
    """Whether a Python version, pre-releases included, meets its comma-separated specifiers; null if either cannot be read."""
    form = r"^\s*(~=|===|==|!=|<=|>=|<|>)\s*(\S+?)(\.\*)?\s*$"

    def holds(part: Column, v: Column) -> Column:
        read = F.struct(*[F.regexp_extract(part, form, i).alias(n) for i, n in enumerate(("op", "text", "star"), 1)])

        def test(r: Column) -> Column:
            op, star, w = r["op"], r["star"] != "", r["w"]
            n = F.size(w["release"]) - F.when(op == "~=", 1).otherwise(0)
            padded = F.concat(v["release"], F.array_repeat(F.lit(_ZERO), F.greatest(n - F.size(v["release"]), F.lit(0))))
            shares = (v["epoch"] == w["epoch"]) & (F.slice(padded, F.lit(1), n) == F.slice(w["release"], F.lit(1), n))
            same = F.when(star, shares).when(w["is_local"], v["key"] == w["key"]).otherwise(v["public"] == w["public"])
            base = v["base"] == w["base"]
            less = (v["key"] < w["key"]) & ~(~w["is_pre"] & v["is_pre"] & base)
            more = (v["key"] > w["key"]) & ~(~w["is_post"] & v["is_post"] & base) & ~(v["is_local"] & base)
            found = (
                F.when(op == "==", same).when(op == "!=", ~same).when(op == ">=", v["public"] >= w["key"]).when(op == "<=", v["public"] <= w["key"])
                .when(op == "<", less).when(op == ">", more).when(op == "~=", shares & (v["public"] >= w["key"]))
            )
            plain = ~star | (op.isin("==", "!=") & ~w["is_pre"] & ~w["is_post"] & ~w["is_local"])
            fits = w.isNotNull() & plain & (~w["is_local"] | op.isin("==", "!=")) & ((op != "~=") | (F.size(w["release"]) > 1))
            return F.when(op == "===", F.lower(F.trim(version)) == F.lower(F.concat(r["text"], r["star"]))).when(fits & (op != ""), found)

        return _let(_let(read, lambda r: F.struct(r["op"].alias("op"), r["text"].alias("text"), r["star"].alias("star"), _pep440(r["text"]).alias("w"))), test)

    def all_of(v: Column) -> Column:
        tests = F.transform(F.filter(F.split(requirement, ","), lambda p: F.trim(p) != ""), lambda p: holds(p, v))
        return F.when(v.isNotNull(), _let(tests, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.forall(t, lambda x: x))))

    return _let(_pep440(version), all_of)


def satisfies(ecosystem: Column, version: Column, requirement: Column) -> Column:
    """True, false, or null where a constraint cannot be interpreted."""
    semver = (ecosystem == "cargo") | F.startswith(F.ltrim(requirement), F.lit("^"))
    return (
        F.when(semver, semver_satisfies(version, requirement))
        .when(ecosystem == "python", pep440_satisfies(version, requirement))
        .when(ecosystem == "r", numeric_satisfies(version, requirement))
    )
