"""Text, path and route functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_escape(col: Column) -> Column:
    """``&`` first, then the other markup characters."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def markdown_escape(col: Column) -> Column:
    """A backslash before every character that could start markup."""
    return F.regexp_replace(col, r"([\\`*_{}\[\]()<>#+\-.!|~])", r"\\$1")


def terminal_safe(col: Column) -> Column:
    """Control characters, except line feed and tab, become the replacement character."""
    return F.regexp_replace(col, r"[\x00-\x08\x0B-\x1F\x7F\u0080-\u009F]", "�")


def strip_control_codes(col: Column) -> Column:
    """Escape sequences (CSI, OSC, DCS) go, then all controls but line feed and tab; an open sequence runs to the end."""
    col = F.regexp_replace(col, r"(?:\x1B\[|\u009B)[0-?]*[ -/]*(?:[@-~]|$)", "")
    col = F.regexp_replace(col, r"(?s)(?:\x1B[\]PX^_]|[\u0090\u0098\u009D-\u009F]).*?(?:\x07|\x1B\\|\u009C|$)", "")
    col = F.regexp_replace(col, r"\x1B(?:[ -/]*[0-~])?", "")
    return F.regexp_replace(col, r"[\x00-\x08\x0B-\x1F\x7F\u0080-\u009F]", "")


def collapse_space(col: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def slugify(col: Column) -> Column:
    """Lower case, runs of other characters become one hyphen; empty text is ``section``."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.when(slug == "", F.lit("section")).otherwise(slug)


def label(col: Column) -> Column:
    """Hyphens and underscores become blanks, the first character upper case, the rest as it is."""
    spaced = F.translate(col, "-_", "  ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))


def clean_route(col: Column) -> Column:
    """``index.html`` is the directory; other pages lose ``.html``."""
    return F.when(col == "index.html", F.lit("")).when(
        F.endswith(col, F.lit("/index.html")), F.regexp_replace(col, "index\\.html$", "")
    ).otherwise(F.regexp_replace(col, "\\.html$", ""))


def atom(col: Column) -> Column:
    """Percent-encoding of everything but ``[A-Za-z0-9_.-]``, byte by byte, upper-case hexadecimal."""
    pairs = F.regexp_extract_all(F.hex(col.cast("binary")), F.lit("(..)"), F.lit(1))

    def one(pair: Column) -> Column:
        char = F.unhex(pair).cast("string")
        plain = (pair < "80") & F.regexp_like(F.coalesce(char, F.lit("")), F.lit("^[A-Za-z0-9_.-]$"))
        return F.when(plain, char).otherwise(F.concat(F.lit("%"), pair))

    return F.array_join(F.transform(pairs, one), "")


def json_string(col: Column) -> Column:
    """A JSON string with quote and backslash escaped and every control as ``\\u00xx``."""
    out = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for n in range(32):
        out = F.replace(out, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def normal_path(col: Column) -> Column:
    """A relative path without ``.`` and ``..``; null if it is absolute, empty, or leaves its root."""
    parts = F.filter(F.split(col, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok"))

    def step(state: Column, part: Column) -> Column:
        up, empty = part == "..", F.size(state["path"]) == 0
        path = F.when(up & ~empty, F.slice(state["path"], F.lit(1), F.size(state["path"]) - 1)).when(up, state["path"])
        return F.struct(path.otherwise(F.concat(state["path"], F.array(part))).alias("path"), (state["ok"] & ~(up & empty)).alias("ok"))

    done = F.aggregate(parts, start, step)
    bad = F.startswith(col, F.lit("/")) | F.contains(col, F.lit("\\")) | F.regexp_like(col, F.lit("^[A-Za-z]:"))
    return F.when(~bad & done["ok"] & (F.size(done["path"]) > 0), F.array_join(done["path"], "/"))


def url_allowed(col: Column, kind: str = "link") -> Column:
    """Whether a URL is safe to publish: no controls or backslashes even when decoded, no credentials, a known scheme.

    Links may be web or mail addresses, images only web addresses; a web address has a host, whatever the number of
    slashes before it.
    """
    decoded = F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))
    bad = r"[\x00-\x1F\x7F-\x{9F}\\]"
    clean = decoded.isNotNull() & ~F.regexp_like(F.concat(decoded, col), F.lit(bad))
    web = F.regexp_like(col, F.lit(r"^(?i:https?):/*[^/?#@\s][^/?#@\s]*(?:[/?#]|$)"))
    mail = F.regexp_like(col, F.lit("^(?i:mailto):"))
    return F.coalesce(clean & (web if kind == "image" else web | mail), F.lit(False))


def site_url(col: Column) -> Column:
    """The address of a site with a slash at its end: absolute, http or https, with a host and nothing but a path after
    it; null if it is not so."""
    fine = F.regexp_like(col, F.lit(r"^(?i:https?)://[^/?#@\s\x00-\x1F\x7F-\x{9F}]+(?:/[^?#\s\x00-\x1F\x7F-\x{9F}]*)?$"))
    return F.when(fine, F.when(F.endswith(col, F.lit("/")), col).otherwise(F.concat(col, F.lit("/"))))


def kernel_language(col: Column) -> Column:
    """The language of a kernel, by which cells are compared."""
    lower = F.lower(col)
    return F.when(lower == "python3", F.lit("python")).otherwise(lower)


def relative_url(base: Column, target: Column) -> Column:
    """The way from the page ``base`` to ``target``, both relative to the root of the site."""
    a, b = F.split(base, "/"), F.split(target, "/")
    dirs, to = F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(1), F.size(b) - 1)
    upto = F.least(F.size(dirs), F.size(to))
    places = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(places, lambda i: F.element_at(dirs, i) != F.element_at(to, i))
    common = F.when(F.size(differs) > 0, F.element_at(differs, 1) - 1).otherwise(upto)
    return F.concat(F.repeat(F.lit("../"), F.size(dirs) - common), F.array_join(F.slice(b, common + 1, F.size(b) - common), "/"))


#: Media types of the file extensions that sites serve; the extensions are in lower case.
MEDIA_TYPES = {
    "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "ico": "image/x-icon",
    "webp": "image/webp", "gif": "image/gif", "avif": "image/avif", "webmanifest": "application/manifest+json",
    "txt": "text/plain; charset=utf-8", "pdf": "application/pdf", "woff": "font/woff", "woff2": "font/woff2",
    "js": "text/javascript; charset=utf-8", "mjs": "text/javascript; charset=utf-8", "css": "text/css; charset=utf-8",
    "wasm": "application/wasm", "json": "application/json", "map": "application/json",
}


def media_type(path: Column) -> Column:
    """By the extension as it is written; a leading dot begins a name, not an extension."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    pairs = [F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("application/octet-stream"))


def source_url(template: Column, revision: Column, path: Column, kind: Column) -> Column:
    """A repository link; null without a revision, without both places, or with braces left over."""
    url = F.replace(F.replace(F.replace(template, F.lit("{revision}"), revision), F.lit("{path}"), path), F.lit("{kind}"), kind)
    whole = F.contains(template, F.lit("{revision}")) & F.contains(template, F.lit("{path}"))
    return F.when(revision.isNotNull() & whole & ~F.regexp_like(url, F.lit("[{}]")), url)


def line_number(text: Column, offset: Column) -> Column:
    """The line, from 1, of a byte offset."""
    before = F.substring(text.cast("binary"), F.lit(1), offset.cast("int")).cast("string")
    return F.char_length(F.regexp_replace(before, "[^\n]", "")) + 1


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, both included; null if the text has fewer."""
    lines = F.split(text, "\n")
    return F.when((first >= 1) & (last >= first) & (F.size(lines) >= last), F.array_join(F.slice(lines, first, last - first + 1), "\n"))


def valid_label(col: Column) -> Column:
    return F.regexp_like(col, F.lit("^[A-Za-z][A-Za-z0-9_.:-]*$"))
