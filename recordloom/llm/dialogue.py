"""Conversation structure repair by an error-correcting Earley parser over the roles of the turns.

The grammar of roles is ``Dialogue: nothing | Pairs``, ``Pairs: Opening u a | Pairs u a``, ``Opening: nothing | s``, over
the first letters of the roles. Error productions let every terminal take in deleted turns before it, stand for a turn
that is given another role, or be inserted, each at a cost; the end takes in what is deleted after the last pair. The
grammar is left-recursive, so every item of the chart starts at column 0: prediction is done there once, and a column
follows from the last one alone. An item retains the least (cost, audit); the completed start rule yields the repair.

Two audits that consumed as many turns and end with one are never prefixes of each other, because an insertion always
costs something. So a column ranks the audits that entered it, and later ones compare by rank and by what was inserted
since: the work is linear in the turns, whatever their number, and of a conversation only one letter a turn is held.

On Spark: one shuffle by conversation of narrow rows (role, hash of the text, kind of fault), which are sorted twice in
their partition, to find repeated turns and to stream in order through the parser; a second shuffle sorts the texts behind
the audit of their conversation, and rows stream through the repair one by one. No task holds a conversation. The rows
of one conversation, however long, pass one task in order, as their one audit and the hash of their one sequence ask for.

Defined results. A null role or text is one space; turns are ordered nulls first, those of one turn by role and SHA-256
of the text; a null conversation id is a conversation of its own. Equal rows are turns like any other, the later ones
duplicates. Only the first letter of a role counts for the grammar; a role without a letter fits nowhere. A table without
rows gives none; further columns are not looked at; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROWS, Memo, table

BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: (left side, right side); ``$`` is the end. Capitals are nonterminals.
GRAMMAR = (("Start", ("Dialogue", "$")), ("Dialogue", ()), ("Dialogue", ("Pairs",)), ("Pairs", ("Opening", "u", "a")), ("Pairs", ("Pairs", "u", "a")), ("Opening", ()), ("Opening", ("s",)))
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Turns after which the audits that are held as links become strings.
JOIN = 2048


class Repairer:
    """Least-cost repair of sequences of turns, each one a token: the role's letter (``x`` for any other), in capitals if
    the turn is truncated, or ``-`` if it must be deleted."""

    def __init__(self, rules=GRAMMAR, start: str = "Start", free: str = "ua"):
        """``free``: the terminals that may be inserted and that a turn may be given."""
        self.rules, self.start, self.free = rules, start, free
        self.symbols = {left for left, _ in rules}
        # Column 0 by prediction: the items there have consumed nothing, so they wait at no cost.
        predicted, todo = {start}, [start]
        while todo:
            for left, right in rules:
                if left == todo[-1] and right and right[0] in self.symbols - predicted:
                    predicted.add(right[0])
                    todo.insert(0, right[0])
            todo.pop()
        self.first = [(r, 0) for r, (left, _) in enumerate(rules) if left in predicted]
        self.waiting: dict[str, list] = {}
        for r, d in self.first:
            right = rules[r][1]
            if right and right[0] in self.symbols:
                self.waiting.setdefault(right[0], []).append((r, d))
            if any(x in self.symbols for x in right[1:]):
                raise ValueError("only left-recursive grammars have all their items at column 0")
        if any(r not in dict(self.first) for r in range(len(rules))):
            raise ValueError("a rule is never predicted")

    def _close(self, column: dict, todo: list) -> dict:
        """Complete and insert until nothing gets better. A value is (cost, rank, tail, link)."""
        while todo:
            item = todo.pop()
            value, (rule, dot) = column[item], item
            left, right = self.rules[rule]
            if dot == len(right):
                made = [((r, d + 1), value) for r, d in self.waiting.get(left, ())]
            elif right[dot] in self.free:
                made = [((rule, dot + 1), (value[0] + INSERT, value[1], value[2] + "I", value[3]))]
            else:
                continue
            for new, v in made:
                old = column.get(new)
                if old is None or v[:3] < old[:3]:
                    column[new] = v
                    todo.append(new)
        return column

    def _turn(self, column: dict, token: str) -> dict:
        """The items after one more turn."""
        out: dict = {}
        late = TRUNCATED if token.isupper() else 0
        letter = token.lower()
        for (rule, dot), (cost, rank, tail, link) in column.items():
            right = self.rules[rule][1]
            if dot == len(right) or right[dot] in self.symbols:
                continue
            ways = [((rule, dot), cost + DELETE, "D")]
            if letter != "-" and right[dot] == letter:
                ways.append(((rule, dot + 1), cost + late, "K"))
            if letter != "-" and right[dot] in self.free:
                ways.append(((rule, dot + 1), cost + REROLE + late, "R"))
            for item, c, edit in ways:
                v = (c, rank, tail + edit, link)
                if item not in out or v[:3] < out[item][:3]:
                    out[item] = v
        # What entered the column gets its rank among all that did, and a link of its own.
        ranks = {x: i for i, x in enumerate(sorted({(v[1], v[2]) for v in out.values()}))}
        links = {(v[1], v[2]): (v[3], v[2]) for v in out.values()}
        return {item: (c, ranks[rank, tail], "", links[rank, tail]) for item, (c, rank, tail, _) in out.items()}

    def parse(self, tokens: Iterable[str]) -> tuple[int, str]:
        """The least cost and, of the audits that have it, the least one."""
        column = self._close({item: (0, 0, "", None) for item in self.first}, list(self.first))
        for n, token in enumerate(tokens, 1):
            seeds = self._turn(column, token)
            if n % JOIN == 0:
                seeds = _joined(seeds, JOIN)
            column = self._close(seeds, list(seeds))
        end = next(r for r, (left, _) in enumerate(self.rules) if left == self.start)
        cost, _, tail, link = column[end, 1]
        parts = [tail]
        while link is not None:
            link, text = link
            parts.append(text)
        return cost, "".join(reversed(parts))


def _joined(seeds: dict, steps: int) -> dict:
    """The same values, with the last ``steps`` links of each as one. Values that share a link go on sharing it."""
    made: dict = {}
    for _, _, _, link in seeds.values():
        at, parts = link, []
        for _ in range(steps):
            at, text = at
            parts.append(text)
        made.setdefault(id(link), (at, "".join(reversed(parts))))
    return {item: (c, rank, tail, made[id(link)]) for item, (c, rank, tail, link) in seeds.items()}


def damaged(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, lost): what is left of the rows after damage by a hash of their place.

    A dropped row stays as one without role and text, marked ``lost``, so that its conversation is not forgotten.
    """
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    conv, turn = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`")
    rows = df.select(
        conv.alias("conv"), turn.alias("turn"), space(F.col(f"`{role_col}`")).alias("role"), space(F.col(f"`{text_col}`")).alias("text"),
        F.pmod(F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")), F.lit(20)).alias("h"),
    )
    h = F.col("h")
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (h == 0).alias("lost"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    whole = lambda c: F.when(~F.col("lost"), F.col(c))
    return rows.select("conv", "turn", whole("role").alias("role"), whole("text").alias("text"), "lost")


def intact(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, lost): the rows as they are, for ``repair``."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), F.lit(False).alias("lost"))


#: The order of turns: those of equal ``turn`` by role and hash of the text.
def _ordered() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first()]


_FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}


def _structures(arrow: pa.Schema):
    """One row for each conversation of a stream of sorted turns (conv, turn, letter, fault, lost)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer()
        short = Memo(repairer.parse, 50_000)

        class Conversation:
            def __init__(self, conv):
                self.conv, self.tokens, self.counts = conv, bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}
                self.first = self.last = self.letter = None
                self.turns = self.illegal = 0

            def add(self, turn, letter, fault):
                if turn is not None and turn != self.last:
                    self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
                if self.letter is not None and self.letter + letter not in LEGAL:
                    self.illegal += 1
                self.letter = letter
                token = letter if letter in ROLES else "x"
                if fault:
                    self.counts[fault] += 1
                    token = token.upper() if fault == "truncated" else "-"
                self.tokens += token.encode()

            def row(self):
                tokens = self.tokens.decode()
                cost, audit = short[tokens] if len(tokens) <= 64 else repairer.parse(tokens)
                gaps = self.last - self.first + 1 - self.turns if self.turns else 0
                return (self.conv, gaps, *self.counts.values(), self.illegal, cost, audit)

        def record(rows):
            cols = list(zip(*rows)) if rows else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        now, done = None, []
        for cols in _chunks(batches):
            for conv, turn, letter, fault, lost in zip(*(cols[c] for c in ("conv", "turn", "letter", "fault", "lost"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(conv)
                if not lost:
                    now.add(turn, letter, fault)
            if len(done) >= ROWS:
                yield record(done)
                done = []
        yield record(done + ([now.row()] if now is not None else []))

    return run


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.sha2("text", 256))


def structures(rows: DataFrame) -> DataFrame:
    """For each conversation of ``damaged`` or ``intact`` rows its faults, the cost of its repair, and the audit."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    seen = F.btrim("text", F.lit(BLANKS))
    narrow = _digested(rows).select(
        "conv", "turn", "role", "digest", "lost", F.substring("role", 1, 1).alias("letter"),
        F.when(seen == "", "blank").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "truncated").alias("fault"),
    )
    # Both sorts keep the partitioning by conversation, so there is one shuffle.
    first = F.row_number().over(W.partitionBy("conv", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) == 1
    dealt = narrow.repartition("conv").withColumn("first", first)
    fault = F.when(F.col("lost"), None).when(F.col("fault") == "blank", "blank").when(~F.col("first"), "duplicate").otherwise(F.col("fault"))
    stream = dealt.sortWithinPartitions(*_ordered()).select("conv", "turn", "letter", fault.alias("fault"), "lost")
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, {_FOUND}"
    return stream.mapInArrow(_structures(to_arrow_schema(_parse_datatype_string(schema))), schema)


def _repaired(arrow: pa.Schema):
    """Turns behind the audit of their conversation -> that row, then the repaired turns."""
    found = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, last = None, "", 0, 0, None
        rows: list = []

        def put(edit, turn, role, text):
            nonlocal place, last
            if edit in "RI":
                role = "assistant" if last == "u" else "user"
            rows.append((conv, *[None] * len(found), place, turn, role, text, edit))
            place, last = place + 1, role[:1]

        def insertions():
            nonlocal at
            while audit[at : at + 1] == "I":
                put("I", None, None, "")
                at += 1

        def record():
            cols = list(zip(*rows)) if rows else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for cols in _chunks(batches):
            for i, head in enumerate(cols["head"]):
                if head:
                    insertions()
                    conv, audit, at, place, last = cols["conv"][i], cols["audit"][i], 0, 0, None
                    rows.append((conv, *[cols[c][i] for c in found], -1, None, None, None, None))
                else:
                    insertions()
                    if audit[at] != "D":
                        put(audit[at], cols["turn"][i], cols["role"][i], cols["text"][i])
                    at += 1
            yield record()
            rows.clear()
        insertions()
        yield record()

    return run


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, its faults, cost and audit, place, turn, role, text, edit), in order.

    A conversation begins with a row of place -1, which alone has its faults, cost and audit; its repaired turns follow,
    numbered from 0, with the edit that made each. Rows of a conversation lie together in one partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    heads = structures(rows).withColumn("head", F.lit(True))
    turns = _digested(rows.where("not lost")).withColumn("head", F.lit(False))
    both = heads.unionByName(turns, allowMissingColumns=True).repartition("conv")
    stream = both.sortWithinPartitions(F.col("conv").asc_nulls_first(), F.desc("head"), *_ordered()[1:]).drop("digest", "lost")
    schema = f"conv {kinds['conv']}, {_FOUND}, place bigint, turn {kinds['turn']}, role string, text string, edit string"
    return stream.mapInArrow(_repaired(to_arrow_schema(_parse_datatype_string(schema))), schema)


def _hashed(arrow: pa.Schema):
    """The stream of ``repair`` -> one row for each conversation with the hash of its repaired turns."""
    found = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, done = None, None, []

        def record():
            cols = list(zip(*done)) if done else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for cols in _chunks(batches):
            for i, place in enumerate(cols["place"]):
                if place < 0:
                    if now is not None:
                        done.append((*now, hashed.hexdigest()))
                    now, hashed = [cols[c][i] for c in ("conv", *found)], hashlib.sha256()
                else:
                    hashed.update(("\n" * (place > 0) + f"{cols['role'][i]}:{cols['text'][i]}").encode())
            if len(done) >= ROWS:
                yield record()
                done.clear()
        if now is not None:
            done.append((*now, hashed.hexdigest()))
        yield record()

    return run


def repair_digest(rows: DataFrame) -> DataFrame:
    """One row for each conversation: faults, cost, audit and SHA-256 of the repaired ``role:text`` lines."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, {_FOUND}, repaired_sha256 string"
    return repair(rows).mapInArrow(_hashed(to_arrow_schema(_parse_datatype_string(schema))), schema)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = damaged(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return repair_digest(rows).withColumnRenamed("conv", "conv_id")
