"""Documents as trees: Markdown to flat nodes, front matter, includes, references, anchors, and the HTML policy.

Spark has no recursive types, so a document becomes rows (doc, path, ord, kind, level, text, target, identifier): the
path is the position in the tree, the ordinal its place in document order. All later operators are plain relational
ones over these rows. Parsing is one vectorised function; its work is linear in the text.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "path string, ord int, kind string, level int, text string, target string, identifier string"

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?=\s|$)(.*)$")
_ITEM = re.compile(r"^( *)(?:[-*+]|\d{1,9}[.)])\s+(.*)$")
_RULE = re.compile(r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_ATTR = re.compile(r"\s*\{#([A-Za-z][\w.:-]*)[^}]*\}\s*$")
_LABEL = r"(?:[^\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*"
_INLINE = re.compile(
    r"`(?P<code>[^`]+)`|\$(?P<math>[^$\n]+)\$|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>"
    rf"|(?P<image>!?)\[(?P<label>{_LABEL})\](?:(?P<dest>\(\s*(?:<(?P<angle>[^<>]*)>|(?P<bare>[^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\))|\[(?P<ref>[^\[\]]*)\])?"
)
_DEFINITION = re.compile(r"^ {0,3}\[([^\[\]]+)\]:\s*<?([^\s<>]+)>?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*$")
_SEPARATOR = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def front_matter(text: str) -> tuple[list[tuple[str, str]], str]:
    """(key, value) pairs of a leading ``---`` block, duplicates kept, and the rest of the text.

    Keys of mappings within mappings are joined by dots; items of lists have their list's key.
    """
    if not text.startswith("---\n"):
        return [], text
    end = re.search(r"^(?:---|\.\.\.)[ \t]*$", text[4:], re.M)
    if not end:
        return [], text
    pairs: list[tuple[str, str]] = []
    above: list[tuple[int, str]] = []  # indent and key of the mappings that are open
    for line in text[4 : 4 + end.start()].splitlines():
        m = re.match(r"^( *)(- +)?(?:([A-Za-z_<][\w.<-]*)\s*:(?:\s+|$))?(.*)$", line)
        if not line.strip() or line.lstrip().startswith("#") or not m[2] and not m[3]:
            continue
        while above and above[-1][0] >= len(m[1]) + bool(m[2]):
            above.pop()
        key, value = ".".join([*(k for _, k in above), *([m[3]] if m[3] else [])]), m[4].strip().strip("\"'")
        if m[3] and not value:
            above.append((len(m[1]) + len(m[2] or ""), m[3]))
        if value and key:
            pairs.append((key, value))
    return pairs, text[4 + end.end() :].lstrip("\n")


def _name(label: str) -> str:
    return " ".join(label.split()).casefold()


def _target(m: re.Match, defined: dict[str, str]) -> str | None:
    """Where a bracketed match leads: its own destination or that of its definition; None if it is no link at all."""
    if m["dest"] is not None:
        return m["angle"] if m["angle"] is not None else m["bare"]
    return defined.get(_name(m["ref"] or m["label"]))


def inlines(text: str, defined: dict[str, str]) -> Iterator[tuple[str, str, str | None]]:
    """(kind, text, target) of code, math, links and images in order; those within a label come after its own."""
    for m in _INLINE.finditer(text):
        if m["code"] is not None:
            yield "code", m["code"], None
        elif m["math"] is not None:
            yield "math", m["math"], None
        elif m["auto"] is not None:
            yield "link", m["auto"], m["auto"] if ":" in m["auto"] else f"mailto:{m['auto']}"
        else:
            to = _target(m, defined)
            if to is not None:
                yield "image" if m["image"] else "link", plain(m["label"], defined), to
            yield from inlines(m["label"], defined)


def plain(text: str, defined: dict[str, str] | None = None) -> str:
    """The text of inlines: the words of links, the description of images, code and math as written."""
    defined = defined or {}

    def words(m: re.Match) -> str:
        if m["label"] is None:
            return next(m[g] for g in ("code", "math", "auto") if m[g] is not None)
        inner = plain(m["label"], defined)
        return inner if _target(m, defined) is not None else f"{m['image']}[{inner}]" + (f"[{m['ref']}]" if m["ref"] is not None else "")

    return html.unescape(_unmarked(_INLINE.sub(words, text)))


def _unmarked(text: str) -> str:
    """Text without the marks of emphasis: each from a mark before a word to the next such mark behind one, on a line.

    Where marks may close, and where lines end, is listed once, so the work is near linear in the text.
    """
    marks = ("**", "__", "*", "~~")
    closes = {m: [x.start() for x in re.finditer(rf"(?<=\S)(?={re.escape(m)})", text)] for m in marks if m in text}
    if not closes:
        return text
    ends, out, at = [x.start() for x in re.finditer("\n", text)] + [len(text)], [], 0
    for x in re.finditer(r"(?=\*|__|~~)", text):
        i = x.start()
        if i < at:
            continue
        for m in marks:
            inner = i + len(m)
            if m in closes and text.startswith(m, i) and not text[inner : inner + 1].isspace():
                k = bisect.bisect_left(closes[m], inner + 1)
                if k < len(closes[m]) and (j := closes[m][k]) <= ends[bisect.bisect_left(ends, inner)]:
                    out += [text[at:i], text[inner:j]]
                    at = j + len(m)
                    break
    return "".join([*out, text[at:]])


def definitions(lines: list[str]) -> tuple[dict[str, str], list[str]]:
    """Link definitions outside code, the first of each name, and the lines without them."""
    defined, rest, fence = {}, [], None
    for line in lines:
        m = _FENCE.match(line)
        if fence is None and m:
            fence = m[1]
        elif fence is not None and re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}\s*$", line):
            fence = None
        elif fence is None and (d := _DEFINITION.match(line)):
            defined.setdefault(_name(d[1]), d[2])
            continue
        rest.append(line)
    return defined, rest


def _cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


_ALIGNED = {(True, False): "left", (False, True): "right", (True, True): "center"}


def nodes(text: str | None) -> Iterator[tuple]:
    """The nodes of a document in document order. The cells of a table have their column's alignment as target; an item
    under another has its path below that."""
    defined, lines = definitions(front_matter(text or "")[1].split("\n"))
    ord_, top, i = -1, -1, 0
    open_items: list[tuple[int, str, int]] = []  # indent, path and number of items so far below
    rows: list[tuple] = []

    def add(path, kind, text=None, level=None, target=None, identifier=None):
        nonlocal ord_
        ord_ += 1
        rows.append((path, ord_, kind, level, text, target, identifier))

    def block(kind, text, under=None, **more):
        nonlocal top
        if under is None:
            top += 1
        path = under or f"{top:06d}"
        raw = kind in ("code-block", "html")
        add(path, kind, text if raw else plain(text, defined), **more)
        if not raw and kind != "rule":
            for n, (inner, words, to) in enumerate(inlines(text, defined)):
                add(f"{path}.{n}", inner, words, target=to)
        return path

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            j = i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[j]):
                j += 1
            block("code-block", "\n".join(lines[i + 1 : j]), target=m[2].strip() or None)
            i = j + 1
        elif m := _HEADING.match(line):
            title = m[2].strip()
            if (open_ := title.rstrip("#")) != title and open_ and open_[-1].isspace():  # closing marks
                title = open_.rstrip()
            a = _ATTR.search(title)
            block("heading", _ATTR.sub("", title), level=len(m[1]), identifier=a[1] if a else None)
            i += 1
        elif _RULE.match(line):
            block("rule", "")
            i += 1
        elif "|" in line and i + 1 < len(lines) and _SEPARATOR.match(lines[i + 1]) and "-" in lines[i + 1]:
            header = _cells(line)
            sides = [_ALIGNED.get((c.startswith(":"), c.endswith(":"))) for c in _cells(lines[i + 1])]
            block("table", " | ".join(header))
            own, i, row = f"{top:06d}", i + 2, 0
            while i < len(lines) and "|" in lines[i]:
                for c, cell in enumerate(_cells(lines[i])[: len(header)]):
                    at = f"{own}.r{row:04d}.{c:03d}"
                    add(at, "cell", plain(cell, defined), level=row, target=sides[c] if c < len(sides) else None)
                    for n, (inner, words, to) in enumerate(inlines(cell, defined)):
                        add(f"{at}.{n}", inner, words, target=to)
                row, i = row + 1, i + 1
        elif (m := _ITEM.match(line)) and (len(m[1]) <= 3 or open_items):
            text, i = m[2], i + 1
            while i < len(lines) and lines[i].startswith("  ") and lines[i].strip() and not _ITEM.match(lines[i]):
                text, i = f"{text} {lines[i].strip()}", i + 1
            while open_items and open_items[-1][0] >= len(m[1]):
                open_items.pop()
            under = None
            if open_items:
                indent, above, count = open_items[-1]
                open_items[-1] = (indent, above, count + 1)
                under = f"{above}.i{count:04d}"
            open_items.append((len(m[1]), block("item", text, under, level=len(open_items)), 0))
            continue
        elif line.lstrip().startswith(">"):
            j = i
            while j < len(lines) and lines[j].lstrip().startswith(">"):
                j += 1
            block("quote", " ".join(x.lstrip()[1:].strip() for x in lines[i:j]))
            i = j
        elif re.match(r"^ {0,3}<[A-Za-z/!]", line):
            j = i
            while j < len(lines) and lines[j].strip():
                j += 1
            block("html", "\n".join(lines[i:j]))
            i = j
        else:
            j = i + 1
            while j < len(lines) and lines[j].strip() and not (_FENCE.match(lines[j]) or _HEADING.match(lines[j]) or _ITEM.match(lines[j])):
                j += 1
            block("paragraph", " ".join(x.strip() for x in lines[i:j]))
            i = j
        open_items.clear()
    yield from rows


def flatten(docs: DataFrame) -> DataFrame:
    """Nodes of all documents (doc, text)."""
    names = [c.split()[0] for c in NODE.split(", ")]

    @F.pandas_udf(f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(names, n)) for n in nodes(t)])

    return docs.select("doc", F.inline(parse("text")))


def references(tree: DataFrame) -> DataFrame:
    """(doc, ord, kind, target) of links and images in document order, with those in tables, labels and definitions."""
    return tree.where("kind in ('link', 'image') and target <> ''").select("doc", "ord", "kind", "target")


def anchors(tree: DataFrame) -> DataFrame:
    """(doc, anchor): identifiers of headings, given or made from their text, unique in each document."""
    from ..functions.text import slugify
    from .tables import unique_slugs

    heads = tree.where("kind = 'heading'")
    made = unique_slugs(heads.where("identifier is null").select("doc", F.col("ord").alias("ordinal"), slugify(F.col("text")).alias("slug")))
    return heads.where("identifier is not null").select("doc", F.col("identifier").alias("anchor")).unionAll(made.select("doc", F.col("identifier").alias("anchor"))).distinct()


def headings(tree: DataFrame) -> DataFrame:
    return tree.where("kind = 'heading'").select("doc", "ord", "level", "text", "identifier")


def titles(docs: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc, title): the front matter's title, else the first heading's text."""

    @F.pandas_udf("string")
    def given(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: next((v for k, v in front_matter(t or "")[0] if k == "title"), None))

    first = tree.where("kind = 'heading'").groupBy("doc").agg(F.min_by("text", "ord").alias("_h"))
    return docs.select("doc", given("text").alias("_t")).join(first, "doc", "left").select("doc", F.coalesce("_t", "_h").alias("title"))


def plain_text(tree: DataFrame) -> DataFrame:
    """(doc, text): the text of top blocks and cells in document order."""
    rows = tree.where("kind in ('heading', 'paragraph', 'item', 'quote', 'cell', 'code-block')")
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return rows.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def has_math(tree: DataFrame) -> DataFrame:
    return tree.groupBy("doc").agg(F.bool_or(F.col("kind") == "math").alias("math"))


def shown_cells(cells: DataFrame) -> DataFrame:
    """``source`` and ``outputs`` that a page shows of its cells (mode, echo, include, output). A page that is never run
    shows all sources and no outputs."""
    never = F.col("mode") == "never"
    return cells.withColumn("show_source", never | (F.col("include") & F.col("echo"))).withColumn(
        "show_outputs", ~never & F.col("include") & (F.col("output") != "hide")
    )


def skip_reasons(cells: DataFrame, language: str) -> DataFrame:
    """Why a cell is not run: another language comes before ``eval: false``."""
    other = ~F.lower("language").eqNullSafe(F.lit(language.lower()))
    return cells.withColumn("skip", F.when(other, "language-mismatch").when(~F.col("eval"), "eval-false"))


_INCLUDE = re.compile(r"^(\s*)\{\{<\s*(include|code)\s+(\S+?)(?:#L(\d+)-L?(\d+))?\s*>\}\}\s*$")
MAX_DEPTH = 128
#: Lines that a page may have with its includes; an include that goes beyond them is a problem.
MAX_LINES = 1_000_000


def include_path(path: str, spelled: str) -> str | None:
    """The path that a directive in the file ``path`` names: from the root with a leading slash, else from the file's
    folder; None if it leaves the root."""
    folder = path.rpartition("/")[0]
    parts: list[str] = []
    for part in (spelled[1:] if spelled.startswith("/") else f"{folder}/{spelled}").split("/"):
        if part == ".." and not parts:
            return None
        parts = parts[:-1] if part == ".." else [*parts, part] if part not in ("", ".") else parts
    return "/".join(parts) or None


def code_lines(text: str, first: int | None, last: int | None, indent: str) -> list[str] | None:
    """Lines ``first`` to ``last`` of a file as a fenced block, indented; the fence is longer than any run of its marks
    in them. None if the file has fewer lines."""
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    first, last = first or 1, last or len(lines)
    if not 1 <= first <= last <= len(lines):
        return None
    part = lines[first - 1 : last]
    fence = "`" * max(3, 1 + max((len(m[0]) for x in part for m in re.finditer("`+", x)), default=0))
    return [indent + x if x else x for x in (fence, *part, fence)]


def expand(path: str, files: dict[str, str], chain: tuple[str, ...] = (), room: int = MAX_LINES) -> tuple[list[tuple[str, str, int]], list[str]]:
    """((line, file, line number) rows, problems) of a file with its includes in place of their directives.

    A directive stands between blank lines. A file that includes itself, a missing one, one with front matter, lines
    that a file does not have, nesting beyond ``MAX_DEPTH`` and more than ``MAX_LINES`` lines in all, as includes of includes
    may double, are problems, and nothing is put in their place.
    """
    rows, problems = [], []
    lines = files[path].split("\n")
    for n, line in enumerate(lines, 1):
        m = _INCLUDE.match(line)
        if not m or m[2] == "include" and m[4]:
            rows.append((line, path, n))
            continue
        name = include_path(path, m[3])
        alone = (n == 1 or not lines[n - 2].strip()) and (n == len(lines) or not lines[n].strip())
        code = m[2] == "code"
        trouble = (
            "not-between-blank-lines" if not alone
            else "outside" if name is None
            else "missing" if name not in files
            else None if code
            else "cycle" if name in (*chain, path)
            else "too-deep" if len(chain) + 1 >= MAX_DEPTH
            else "front-matter" if front_matter(files[name])[0]
            else None
        )
        if trouble is None and code:
            first, last = (int(m[g]) if m[g] else None for g in (4, 5))
            found = code_lines(files[name], first, last, m[1])
            if found is None:
                trouble = "no-such-lines"
            else:
                rows += [(x, name if 0 < k < len(found) - 1 else path, (first or 1) + k - 1 if 0 < k < len(found) - 1 else n) for k, x in enumerate(found)]
        elif trouble is None:
            left = room - len(rows) - (len(lines) - n)
            inner, more = expand(name, files, (*chain, path), left) if files[name].count("\n") < left else ([], [])
            if 0 < len(inner) <= left:
                rows += inner
                problems += more
            else:
                trouble = "too-long"
        if trouble:
            problems.append(f"{path}:{n}: {trouble}: {name or m[3]}")
    return rows, problems


def include_targets(path: str, text: str | None) -> list[str]:
    """The paths that the directives of a file name, each once."""
    named = (include_path(path, m[3]) for m in map(_INCLUDE.match, (text or "").split("\n")) if m)
    return sorted({name for name in named if name is not None})


def expand_includes(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (project, path) with their includes expanded: (project, path, text, origins, problems).

    ``files`` has (project, path, text). Directives are followed as edges first, round by round, so that each page is a
    group of its own with just the files that it needs, however large its project.
    """
    from ..plans.lineage import settle

    schema = "project string, page string, text string, origins array<struct<file:string,line:int>>, problems array<string>"

    @F.pandas_udf("array<string>")
    def targets(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([include_targets(p, t) for p, t in zip(path, text)], dtype=object)

    # The columns are named anew, since both tables may come from one.
    held = files.select(F.col("project").alias("project"), F.col("path").alias("path"), F.col("text").alias("text"))
    edges = settle(held.select("project", "path", F.explode(targets("path", "text")).alias("to")))
    found = fresh = settle(pages.select(F.col("project").alias("project"), F.col("path").alias("page"), F.col("path").alias("path")).distinct())
    for _ in range(MAX_DEPTH):
        step = fresh.join(edges, ["project", "path"]).select("project", "page", F.col("to").alias("path")).distinct()
        fresh = settle(step.join(found, ["project", "page", "path"], "left_anti"))
        if fresh.isEmpty():
            break
        found = found.unionAll(fresh)

    def run(key, sources: pd.DataFrame) -> pd.DataFrame:
        texts = {p: t for p, t in zip(sources["path"], sources["text"]) if isinstance(t, str)}
        project, page = key
        if page not in texts:
            row = (project, page, None, [], [f"{page}: missing"])
        else:
            rows, problems = expand(page, texts)
            row = (project, page, "\n".join(r[0] for r in rows), [{"file": f, "line": n} for _, f, n in rows], problems)
        return pd.DataFrame([row], columns=["project", "page", "text", "origins", "problems"])

    return found.join(held, ["project", "path"], "left").groupBy("project", "page").applyInPandas(run, schema).withColumnRenamed("page", "path")


#: The elements that generated HTML may have.
ELEMENTS = (
    "p br hr div span strong em b i s sub sup code pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr th td a img"
).split()
VOID = {"br", "hr", "img"}


_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_WEB = re.compile(r"(?i:https?):/*[^/?#@\s]+(?:[/?#].*)?$|(?i:mailto):.*$", re.S)
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f\\]")


def _local(value: str) -> bool:
    return not (_UNSAFE.search(unquote(value)) or _SCHEME.match(value) or value.startswith("//"))


class _Policy(HTMLParser):
    """Accepts or rejects a fragment as a whole; ``out`` is its canonical form and ``images`` what it shows."""

    def __init__(self, max_depth: int, assets: set[str] | None):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.images, self.max_depth, self.assets, self.reason = [], [], [], max_depth, assets, None

    def reject(self, reason):
        self.reason = self.reason or reason

    def _attribute(self, tag, name, value):
        if name in ("class", "id") or name.startswith("data-"):
            return None
        value = value or ""
        if name == "title" or (tag, name) == ("img", "alt"):
            return value
        if (tag, name) == ("img", "src"):
            if self.assets is not None and value not in self.assets or self.assets is None and not _local(value):
                self.reject("remote-image" if _SCHEME.match(value) or value.startswith("//") else "url")
            self.images.append(value)
            return value
        if (tag, name) == ("a", "href"):
            if not (_local(value) or _WEB.match(value) and not _UNSAFE.search(value) and not _UNSAFE.search(unquote(value))):
                self.reject("url")
            return value
        if name in ("width", "height") and tag == "img" or name in ("colspan", "rowspan") and tag in ("th", "td"):
            digits = value.lstrip("0")
            if re.fullmatch("[0-9]+", value) and 0 < len(digits) <= 20 and int(digits) < 1 << 64:
                return digits
        elif (tag, name) == ("ol", "start") and re.fullmatch("[+-]?[0-9]+", value):
            digits = value.lstrip("+-").lstrip("0") or "0"
            if len(digits) <= 19 and -(1 << 63) <= (n := int(("-" if value[0] == "-" else "") + digits)) < 1 << 63:
                return str(n)
        elif name == "scope" and tag in ("th", "td") and value in ("row", "col", "rowgroup", "colgroup"):
            return value
        self.reject("attribute")
        return None

    def handle_starttag(self, tag, attrs):
        if tag not in ELEMENTS:
            return self.reject("element")
        kept = {}
        for name, value in attrs:
            if (v := self._attribute(tag, name, value)) is not None:
                kept[name] = v
        if len({name for name, _ in attrs}) < len(attrs) or tag == "img" and not kept.get("src"):
            self.reject("structure")
        self.out.append("<" + "".join([tag, *(f' {k}="{html.escape(v)}"' for k, v in sorted(kept.items()))]) + ">")
        if tag not in VOID:
            self.open.append(tag)
            if len(self.open) > self.max_depth:
                self.reject("structure")

    def handle_endtag(self, tag):
        if tag not in ELEMENTS:
            return self.reject("element")
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if "\0" in data:
            self.reject("structure")
        self.out.append(html.escape(data, quote=False))

    def handle_decl(self, decl):
        self.reject("structure")

    def handle_pi(self, data):
        self.reject("structure")


def html_policy(fragment: str | None, max_depth: int = 128, assets: set[str] | None = None) -> tuple[str | None, str | None]:
    """(canonical form, None), or (None, reason). Comments go; anything else that is not allowed rejects the whole.

    Links are web or mail addresses, or lead within the site. Images are local; with ``assets`` they are among those.
    """
    p = _Policy(max_depth, assets)
    p.feed(fragment or "")
    p.close()
    if p.reason:
        return None, p.reason
    return "".join([*p.out, *(f"</{t}>" for t in reversed(p.open))]), None


def apply_html_policy(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``safe`` and ``rejected`` (one of them null)."""

    @F.pandas_udf("struct<safe:string,rejected:string>")
    def check(fragments: pd.Series) -> pd.DataFrame:
        found = [html_policy(f) for f in fragments]
        return pd.DataFrame({"safe": [s for s, _ in found], "rejected": [r for _, r in found]}, dtype=object)

    return rows.withColumn("_p", check(column)).select(*rows.columns, "_p.safe", "_p.rejected")


def generated_references(outputs: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc, ord, kind, target, problem) of links and images in generated Markdown (doc, text).

    Images have to be assets (doc, target) that their own page holds; links must be safe to publish, raw HTML is not
    allowed. Sound references have no problem.
    """
    from ..functions.text import url_allowed

    tree = flatten(outputs)
    refs = references(tree)
    own = assets.select("doc", "target", F.lit(True).alias("_own")).distinct()
    met = refs.join(own, ["doc", "target"], "left")
    scheme = F.regexp_like("target", F.lit("^[A-Za-z][A-Za-z0-9+.-]*:|^//"))
    problem = F.when((F.col("kind") == "image") & F.col("_own").isNull(), F.when(scheme, "remote-image").otherwise("unbound-image")).when(
        (F.col("kind") == "link") & scheme & ~url_allowed(F.col("target")), "unsafe-url"
    )
    raw = tree.where("kind = 'html'").select("doc", "ord", "kind", F.lit(None).cast("string").alias("target"), F.lit("raw-html").alias("problem"))
    return met.select("doc", "ord", "kind", "target", problem.alias("problem")).unionAll(raw)


_CHUNK = re.compile(r"^\{\s*([A-Za-z][\w-]*)\s*(?:[,\s]\s*(.*?))?\s*\}$")
_HASHPIPE = re.compile(r"^#\|\s*([\w.-]+)\s*:\s*(.*?)\s*$")


def option_scalar(raw: str) -> str:
    """An option's value: only a bare ``true`` or ``false`` is a flag (given back in lower case); quotes are taken off,
    with their escapes, and everything else is text as written."""
    raw = raw.strip()
    if len(raw) >= 2 and raw[0] == raw[-1] == "'":
        return raw[1:-1].replace("''", "'")
    if len(raw) >= 2 and raw[0] == raw[-1] == '"':
        escapes = {"n": "\n", "t": "\t", '"': '"', "\\": "\\"}
        return re.sub(r"\\(.)", lambda m: escapes.get(m[1], m[0]), raw[1:-1])
    return raw


def code_chunks(text: str | None) -> Iterator[tuple[str, str, list[tuple[str, str, int]], str]]:
    """(language, label, options, source) of the chunks of a document; options are (key, value, tier).

    A chunk is a fence whose info is in braces: a language, maybe a label, and comma-separated options (tier 1); lines
    of ``#| key: value`` at its beginning are options of tier 2.
    """
    lines, i = front_matter(text or "")[1].split("\n"), 0
    while i < len(lines):
        fence = _FENCE.match(lines[i])
        i += 1
        if not fence:
            continue
        body = []
        while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[i]):
            body.append(lines[i])
            i += 1
        i += 1
        m = _CHUNK.match(fence[2].strip())
        if not m:
            continue
        label, options = "", []
        for n, part in enumerate(re.findall(r"""(?:[^,"']|"[^"]*"|'[^']*')+""", m[2] or "")):
            key, eq, value = part.partition("=")
            if eq:
                options.append((key.strip(), option_scalar(value), 1))
            elif n == 0:
                label = part.strip()
        while body and (h := _HASHPIPE.match(body[0])):
            options.append((h[1], option_scalar(h[2]), 2))
            body.pop(0)
        yield m[1], next((v for k, v, _ in reversed(options) if k == "label"), label), options, "\n".join(body)


def cells(docs: DataFrame) -> DataFrame:
    """(doc, cell, language, label, options, source) of the chunks of all documents (doc, text). ``option_values`` of the
    exploded options gives what is in force, ``skip_reasons`` and ``shown_cells`` what follows from it."""
    row = "cell:int,language:string,label:string,options:array<struct<key:string,value:string,tier:int>>,source:string"

    @F.pandas_udf(f"array<struct<{row}>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [
                {"cell": n, "language": lang, "label": label, "options": [{"key": k, "value": v, "tier": tier} for k, v, tier in options], "source": source}
                for n, (lang, label, options, source) in enumerate(code_chunks(t))
            ]
        )

    return docs.select("doc", F.inline(parse("text")))
