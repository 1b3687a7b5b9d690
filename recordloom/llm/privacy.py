"""Personal data: pattern spans, and terms that the corpus shows to reveal them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found leftmost and without overlaps, kind
by kind. The value of a base span is a protected entity.

Information-theoretic part. Every word of a text outside its base spans is a term, and so is the shape of one (a number,
a name, a word). Over the whole corpus, a term t tells about an entity e the pointwise mutual information
``log(P(e, t) / (P(e) P(t)))`` out of the information ``-log P(e)`` that e has, where P is the share of documents that
hold it anywhere. A term discloses e if that ratio, which is 1 for a term that occurs only in documents of e, reaches
``disclosure``, the two meet in at least ``support`` different texts, so that exact copies prove nothing, and those texts
have ``evidence`` bits: each text of the term that happens to hold e is a surprise of ``-log2 P(e)``, which is much for a
rare entity and little for one that is everywhere, whose documents share rare words by chance. Such a term is a span of kind ``term`` wherever it stands in a text that holds e. Sanitising replaces base spans by their kind, and
generalises a term to its shape, unless that shape discloses an entity of the text just as well; then the term is
removed.

Terms are counted in the pass that finds the base spans. Only entities of ``support`` different texts, and of their texts
only terms rare enough to disclose them, are paired.

Defined results. A null text is an empty one; rows with null or repeated ids are treated row by row; an empty table
gives an empty result; further columns are not looked at, or pass through ``sanitize`` unchanged. Offsets are code
points, ends exclusive. Texts are taken whole, and every search is linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import ROWS, cut, map_batches, table

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """The local part holds no @, so each match is fixed by its @: the run of local characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind), by start and then kind. A match that fails its test is passed over."""
    spans = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in parts):
            spans.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            spans.append((*m.span(), 2))
    if "+" in text:
        spans += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def _entity(text: str, span: tuple[int, int, int]) -> str:
    a, b, k = span
    return f"{KINDS[k]}:{text[a:b].lower() if k < 2 else _digits(text[a:b])}"


def shape(word: str) -> str:
    """What a term is generalised to."""
    return "[number]" if word.isdigit() else "[name]" if word[0].isupper() else "[word]"


def outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, stop) of the words outside base spans. Words end at base spans, so none overlaps one."""
    out, at = [], 0
    for a, b in [*((a, b) for a, b, _ in spans), (len(text), len(text))]:
        out += [m.span() for m in _WORD.finditer(text, at, max(a, at))]
        at = max(at, b)
    return out


def text_terms(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """The distinct words of a text outside its base spans, in lower case, and their shapes, which are in brackets."""
    words = {text[a:b] for a, b in outside(text, spans)} if spans else set(_WORD.findall(text))
    return {w.lower() for w in words} | set(map(shape, words))


_SPANS = "array<struct<start:int,ord:int,stop:int,kind:string>>"
_TERMS = "array<struct<start:int,stop:int,put:string>>"


def _scan(id_type: str, most: int = 200_000):
    """A row for each text, and rows of how many texts hold each term: one for each ``most`` terms and one at the end."""
    schema = f"_id {id_type}, base {_SPANS}, key string, entities array<string>, held string, counts array<struct<term:string,n:bigint>>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def rows(*cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def counted(counts: Counter) -> pa.RecordBatch:
        return rows([None], [None], [None], [None], [None], [[{"term": t, "n": n} for t, n in counts.items()]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                base, keys, entities, held = [], [], [], []
                for text in batch.column(1).to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    counts.update(text_terms(text, spans))
                    base.append([{"start": a, "ord": k, "stop": b, "kind": KINDS[k]} for a, b, k in spans])
                    keys.append(hashlib.md5(text.encode()).hexdigest() if spans else None)
                    entities.append(sorted({_entity(text, s) for s in spans}) if spans else None)
                    held.append(text if spans else None)
                    if len(counts) >= most:
                        yield counted(counts)
                        counts.clear()
                yield rows(batch.column(0).to_pylist(), base, keys, entities, held, [None] * len(base))
        yield counted(counts)

    return run, schema


def _terms_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, held) -> a row (key, term) for each term of a text."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms = sorted(text_terms(text, base_spans(text)))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(terms), pa.string()), pa.array(terms, pa.string())], names=["key", "term"])


def _marked():
    def work(cols):
        """Where the disclosing terms of a text stand, and what is put in their place."""
        found = []
        for text, hot in zip(cols["held"], cols["hot"]):
            told, terms = set(hot), []
            for a, b in outside(text, base_spans(text)):
                if text[a:b].lower() in told:
                    general = shape(text[a:b])
                    terms.append({"start": a, "stop": b, "put": "" if general in told else general})
            found.append(terms)
        return {"key": cols["key"], "terms": found}

    return work


def disclosing_terms(scanned: DataFrame, support: int, disclosure: float, evidence: float) -> tuple[DataFrame, DataFrame]:
    """(key, hot): for each text with entities the terms, shapes among them, that disclose one; and (key, held)."""
    texts = scanned.where("key is not null")
    n = scanned.where("counts is null").count()
    counts = scanned.where("counts is not null").select(F.inline("counts")).groupBy("term").agg(F.sum("n").alias("n"))
    holders = texts.select("key", F.explode("entities").alias("entity")).groupBy("key", "entity").agg(F.count("*").alias("rows"))
    common = holders.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("rows").alias("of_entity"))
    common = common.where((F.col("texts") >= support) & (F.col("of_entity") < n)).select("entity", "of_entity")
    links = cut(holders.join(common, "entity"))
    wanted = texts.select("key", "held").join(links.select("key").distinct(), "key", "left_semi")
    held = cut(wanted.groupBy("key").agg(F.first("held").alias("held")))
    terms = held.mapInArrow(_terms_of, "key string, term string").join(counts.where(F.col("n") >= support), "term")
    # A term of more documents than this cannot reach the ratio, even if it is in all documents of the entity.
    most = F.col("of_entity") * F.pow(F.lit(float(n)) / F.col("of_entity"), F.lit(1 - disclosure)) + 1
    pairs = links.join(terms, "key").where(F.col("n") <= most)
    met = pairs.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("rows").alias("both"), F.max("n").alias("n"), F.max("of_entity").alias("of_entity"))
    told = F.log(F.col("both") * float(n) / (F.col("of_entity") * F.col("n"))) / F.log(float(n) / F.col("of_entity"))
    bits = F.col("texts") * F.log2(float(n) / F.col("of_entity"))
    hot = cut(met.where((F.col("texts") >= support) & (bits >= evidence) & (told >= disclosure)).select("entity", "term"))
    of_text = links.join(hot, "entity").groupBy("key").agg(F.collect_set("term").alias("hot"))
    return of_text, held


def find_spans(
    df: DataFrame, id_col: str, text_col: str, support: int = 2, disclosure: float = 0.9, evidence: float = 20
) -> tuple[DataFrame, DataFrame]:
    """The base spans of every row, and the term spans of every text that has some.

    The first table has the id, ``base`` (an array of start, ord, stop, kind) and ``key``, the MD5 sum of a text that
    has base spans, else null. The second has ``key`` and ``terms`` (start, stop, put), where ``put`` is what sanitising
    writes in the place of the term.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    scan, schema = _scan(rows.schema["_id"].dataType.simpleString())
    scanned = cut(rows.mapInArrow(scan, schema))
    of_text, held = disclosing_terms(scanned, support, disclosure, evidence)
    terms = cut(map_batches(held.join(of_text, "key"), _marked, f"key string, terms {_TERMS}").where(F.size("terms") > 0))
    return scanned.where("counts is null").select(F.col("_id").alias(id_col), "base", "key"), terms


def rewrite(text: str, terms: list[tuple[int, int, str]]) -> str:
    """The text with base spans as their kinds in brackets and terms as given. Overlapping spans are replaced as one."""
    spans = [(a, b, f"[{KINDS[k]}]") for a, b, k in base_spans(text)] + list(terms)
    out, at = [], 0
    for a, b, put in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitize(df: DataFrame, id_col: str, text_col: str, broadcast_spans: int = 500_000, **options) -> DataFrame:
    """``df`` with personal data taken out of its text column; null texts stay null.

    Up to ``broadcast_spans`` spans of terms are broadcast to the texts; more are joined by a shuffle.
    """
    _, terms = find_spans(df, id_col, text_col, **options)
    terms = terms.select(F.col("key").alias("_key"), F.col("terms").alias("_terms"))
    found = terms.agg(F.coalesce(F.sum(F.size("_terms")), F.lit(0))).first()[0]
    terms = F.broadcast(terms) if found <= broadcast_spans else terms
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record")
    rows = df.select(record, F.col(f"`{text_col}`").alias("_text")).withColumn("_key", F.md5(F.col("_text").cast("binary")))
    rows = rows.join(terms, "_key", "left").select("record", "_text", "_terms")

    @F.pandas_udf("string")
    def clean(text: pd.Series, found: pd.Series) -> pd.Series:
        spans = ([] if f is None else [(x["start"], x["stop"], x["put"]) for x in f] for f in found)
        return pd.Series([None if t is None else rewrite(t, s) for t, s in zip(text, spans)], dtype=object)

    done = rows.select("record", clean("_text", "_terms").alias("_clean"))
    return done.select(
        *[(F.col("_clean") if c == text_col else F.col(f"record.`{c}`")).alias(c) for c in df.columns]
    )


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    base, terms = find_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    none = F.array().cast(_SPANS)
    extra = F.transform(
        "terms",
        lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("ord"), t["stop"].alias("stop"), F.lit("term").alias("kind")),
    )
    every = F.array_sort(F.concat("base", F.coalesce(extra, none)))

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")

    def number(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return base.join(terms, "key", "left").select(
        "doc_id", *map(number, KINDS), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans")
    )
