"""Canonical JSON and domain-separated fingerprints.

Built-in JSON functions order object keys as UTF-16 and rewrite numbers, so the canonical form is made by a vectorised
function. The domain strings are parameters: give those of another producer to match its fingerprints.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import json_string


def canonical(value) -> str:
    """Keys sorted by their bytes at every level, compact, UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(content: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null where a text is not JSON, repeats a key, or has a number that JSON lacks."""

    def pairs(found):
        if len({k for k, _ in found}) < len(found):
            raise ValueError
        return dict(found)

    def refuse(_):
        raise ValueError

    def one(text):
        try:
            return canonical(json.loads(text, object_pairs_hook=pairs, parse_constant=refuse))
        except (TypeError, ValueError):
            return None

    return content.map(one)


def restricted(text: str | None, max_depth: int = 128) -> str | None:
    """The one spelling of a JSON text of the restricted form: ASCII keys, each once and in order, whole numbers of 64
    bits, no deeper than ``max_depth``; None if the text is of no such value, or not spelled so."""

    def pairs(found):
        if len({k for k, _ in found}) < len(found) or not all(k.isascii() for k, _ in found):
            raise ValueError
        return dict(found)

    def refuse(_):
        raise ValueError

    def check(value, depth):
        if depth > max_depth:
            raise ValueError
        if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 64:
            raise ValueError
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            check(v, depth + 1)

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_float=refuse, parse_constant=refuse)
        check(value, 0)
    except (TypeError, ValueError, RecursionError):
        return None
    spelled = canonical(value)
    return spelled if spelled == text else None


@F.pandas_udf(StringType())
def restricted_json(content: pd.Series) -> pd.Series:
    """The texts that are of the restricted form as they are, else null."""
    return content.map(restricted)


def record_fingerprint(kind: Column, owner: Column, id_: Column, content: Column, domain: str = "recordloom/record-v1") -> Column:
    """SHA-256 over the canonical array of domain, key and content."""

    @F.pandas_udf("string")
    def digest(kind: pd.Series, owner: pd.Series, id_: pd.Series, content: pd.Series) -> pd.Series:
        def one(k, o, i, c):
            try:
                value = json.loads(c)
            except (TypeError, ValueError):
                return None
            key = {"id": i, "kind": k, "owner": o}
            return hashlib.sha256(canonical([domain, key, value]).encode()).hexdigest()

        return pd.Series([one(*row) for row in zip(kind, owner, id_, content)], dtype=object)

    return digest(kind, owner, id_, content)


def inputs_fingerprint(repository: Column, inputs: Column, domain: str = "recordloom/declared-inputs-v1") -> Column:
    """SHA-256 over domain, a zero byte and the JSON array of inputs: an array of (path, digest), taken in path order."""
    rows = F.transform(
        F.array_sort(inputs),
        lambda x: F.concat(
            F.lit('{"digest":'), json_string(x["digest"]), F.lit(',"path":'), json_string(x["path"]),
            F.lit(',"repository":'), json_string(repository), F.lit("}"),
        ),
    )
    return domain_digest(domain, F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")))


def domain_digest(domain: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(domain).cast("binary"), F.lit(b"\0"), text.cast("binary")), 256)
