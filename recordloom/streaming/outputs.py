"""Reduction of the output events of executed cells, as a table and as a stream.

Events of a page come in order: ``stream``, ``display``, ``result``, ``error``, ``warning``, ``update`` and ``clear``.
An update replaces the payload of the earlier displays of its ``display_id`` in any cell of the page; a clear empties the
cell, and one that waits does so at the cell's next output. Streams of the same name that follow each other are joined.

As a table nothing is folded: which outputs survive is decided by the last clears of a cell, what a display shows by the
last update of its id, and whether an update met anything by counting, along the events of its id, what has come and gone.
Windows are over one cell or one display id, never over a page, and Spark spills them.

As a stream a page has a state: where a cell's outputs start and end, what kind each is, and an index from a display id
to its places, so an event costs one look-up. No payload is kept: the stream hands on what changes (``CHANGE``), and
``current_outputs`` makes the outputs of that.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: A change of a page's outputs: ``put`` of a place, ``append`` to it, ``update`` of it, ``drop`` of a cell's places up to
#: and including it, or ``problem``, whose payload is the unknown id.
CHANGE = "page string, seq bigint, cell bigint, place bigint, op string, kind string, name string, payload string"


def _lives(events: DataFrame) -> DataFrame:
    """The outputs of a table of events with ``gone``: the event that removes each, null if none does.

    What comes after an event is looked at from the end, since a frame that starts at the row is added up anew for each row.
    """
    after = Window.partitionBy("page", "cell").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    output = ~F.col("kind").isin("update", "clear")
    own = events.where("kind <> 'update'").withColumn("_next", F.min(F.when(output, F.col("seq"))).over(after))
    clears = F.when(F.col("kind") == "clear", F.when(F.col("wait"), F.col("_next")).otherwise(F.col("seq")))
    return own.withColumn("_gone", clears).withColumn("gone", F.min("_gone").over(after)).where(output).drop("_next", "_gone")


def reduce_outputs(events: DataFrame, join_streams: bool = True) -> DataFrame:
    """Outputs (page, cell, position, kind, name, payload, problem) of (page, seq, cell, kind, name, payload, display_id, wait).

    ``seq`` orders a page's events and is unique there. An update of a display that nobody shows is a row with a
    ``problem`` and no position; its ``payload`` is the id.
    """
    lives = _lives(events.withColumn("wait", F.coalesce("wait", F.lit(False))))
    cell = Window.partitionBy("page", "cell").orderBy("seq")
    shown = F.col("kind").isin("display", "result") & F.col("display_id").isNotNull()
    left = lives.where("gone is null")
    if join_streams:
        follows = (F.col("kind") == "stream") & (F.lag("kind").over(cell) == "stream") & F.col("name").eqNullSafe(F.lag("name").over(cell))
        left = left.withColumn("_slot", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(cell))
        # A joined stream is one row of the result, so its parts are one group.
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("payload", F.lit("")).alias("p")))), lambda x: x["p"]), "")
        streams = left.where("kind = 'stream'").groupBy("page", "cell", "_slot").agg(F.min("seq").alias("seq"), F.first("kind").alias("kind"), F.first("name").alias("name"), parts.alias("payload")).withColumn("display_id", F.lit(None).cast("string"))
        names = ["page", "cell", "_slot", "seq", "kind", "name", "payload", "display_id"]
        left = left.where("kind <> 'stream'").select(names).unionByName(streams.select(names))
    else:
        left = left.withColumn("_slot", F.row_number().over(cell))
    updates = events.where("kind = 'update'")
    newest = updates.where("display_id is not null").groupBy("page", "display_id").agg(F.max(F.struct("seq", "payload")).alias("_u"))
    placed = left.join(newest, ["page", "display_id"], "left")
    plain = F.when(F.col("kind") == "stream", F.coalesce("payload", F.lit(""))).otherwise(F.col("payload"))
    payload = F.when(shown & (F.col("_u.seq") > F.col("seq")), F.col("_u.payload")).otherwise(plain)
    none = F.lit(None).cast("string")
    outputs = placed.select("page", "cell", (F.col("_slot") - 1).cast("int").alias("position"), "kind", "name", payload.alias("payload"), none.alias("problem"))
    # What has come and gone of an id before an update of it.
    marks = F.array(F.struct("seq", F.lit(1).alias("n")), F.struct(F.col("gone").alias("seq"), F.lit(-1).alias("n")))
    moved = lives.where(shown).select("page", "display_id", F.inline(marks)).where("n = 1 or seq is not null").withColumn("cell", F.lit(None).cast(events.schema["cell"].dataType))
    asked = updates.select("page", "display_id", "seq", F.lit(0).alias("n"), "cell")
    by_id = Window.partitionBy("page", "display_id").orderBy("seq", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = moved.unionAll(asked).withColumn("_shown", F.sum("n").over(by_id))
    lost = counted.where("n = 0 and (_shown = 0 or display_id is null)")
    problems = lost.select("page", "cell", F.lit(None).cast("int").alias("position"), F.lit("update").alias("kind"), none.alias("name"), F.col("display_id").alias("payload"), F.lit("unknown-display").alias("problem"))
    return outputs.unionAll(problems)


class _Page(StatefulProcessor):
    """The places of one page. ``cells``: a cell's first and next place and whether a clear waits; ``slots``: what a place
    holds; ``shown``: the places of a display id, as alternating cells and places."""

    def __init__(self, join_streams: bool):
        self.join_streams = join_streams

    def init(self, handle) -> None:
        self.cells = handle.getMapState("cells", "cell long", "first long, next long, wait boolean")
        self.last = handle.getMapState("last", "cell long", "kind string, name string")
        self.shown = handle.getMapState("shown", "id string", "places array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        frames = list(rows)
        events = (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values("seq", kind="stable")
        # A batch's reads and writes of the state go through dictionaries.
        cells, last, shown, out = {}, {}, {}, []

        def of_cell(c):
            if c not in cells:
                cells[c] = [*self.cells.getValue((c,))] if self.cells.containsKey((c,)) else [0, 0, False]
                last[c] = tuple(self.last.getValue((c,))) if self.last.containsKey((c,)) else (None, None)
            return cells[c]

        def places(i):
            if i not in shown:
                flat = [*self.shown.getValue((i,))[0]] if self.shown.containsKey((i,)) else []
                shown[i] = list(zip(flat[::2], flat[1::2]))
            return shown[i]

        def empty(seq, c):
            state = cells[c]
            if state[0] < state[1]:
                out.append((seq, c, state[1] - 1, "drop", None, None, None))
            state[0], state[2], last[c] = state[1], False, (None, None)

        plain = lambda x: None if x is None or x != x else x
        for seq, c, kind, name, payload, display, wait in zip(*(events[f] for f in ("seq", "cell", "kind", "name", "payload", "display_id", "wait"))):
            name, payload, display = plain(name), plain(payload), plain(display)
            state = of_cell(c)
            if kind == "update":
                live = [] if display is None else [(d, p) for d, p in places(display) if p >= of_cell(d)[0]]
                if display is not None:
                    shown[display] = live
                out += [(seq, d, p, "update", None, None, payload) for d, p in live] or [(seq, c, None, "problem", kind, None, display)]
            elif kind == "clear":
                if wait is True or wait == 1:
                    state[2] = True
                else:
                    empty(seq, c)
            else:
                if state[2]:
                    empty(seq, c)
                if self.join_streams and kind == "stream" and last[c] == ("stream", name):
                    out.append((seq, c, state[1] - 1, "append", kind, name, payload))
                    continue
                out.append((seq, c, state[1], "put", kind, name, payload))
                if kind in ("display", "result") and display is not None:
                    places(display).append((c, state[1]))
                state[1], last[c] = state[1] + 1, (kind, name)
        for c, state in cells.items():
            self.cells.updateValue((c,), tuple(state))
            self.last.updateValue((c,), last[c])
        for i, own in shown.items():
            self.shown.updateValue((i,), ([x for pair in own for x in pair],))
        if out:
            seq, cell, place, op, kind, name, payload = zip(*out)
            yield pd.DataFrame({
                "page": [key[0]] * len(out), "seq": seq, "cell": cell, "place": pd.array(place, dtype="Int64"), "op": op,
                "kind": pd.Series(kind, dtype=object), "name": pd.Series(name, dtype=object), "payload": pd.Series(payload, dtype=object),
            })

    def close(self) -> None:
        pass


def stream_changes(events: DataFrame, join_streams: bool = True) -> DataFrame:
    """The stream of changes (``CHANGE``) of a stream of events; a page's events come in order from batch to batch.

    The work of an event does not depend on the length of its page. Needs the RocksDB state store.
    """
    from pyspark.sql.types import _parse_datatype_string

    columns = ["page", "seq", "cell", "kind", "name", "payload", "display_id", "wait"]
    return events.select(columns).groupBy("page").transformWithStateInPandas(_Page(join_streams), _parse_datatype_string(CHANGE), "Append", "none")


def current_outputs(changes: DataFrame) -> DataFrame:
    """The outputs, as ``reduce_outputs`` gives them, that a table of changes has led to."""
    gone = changes.where("op = 'drop'").groupBy("page", "cell").agg(F.max("place").alias("_gone"))
    left = changes.where("op in ('put', 'append', 'update')").join(gone, ["page", "cell"], "left").where("_gone is null or place > _gone")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op") != "update", F.struct("seq", F.coalesce("payload", F.lit("")).alias("p"))))), lambda x: x["p"]), "")
    held = left.groupBy("page", "cell", "place").agg(
        F.max("kind").alias("kind"), F.max("name").alias("name"), text.alias("_text"),
        F.max(F.when(F.col("op") != "append", F.struct("seq", "payload"))).alias("_p"),
    )
    none, position = F.lit(None).cast("string"), F.row_number().over(Window.partitionBy("page", "cell").orderBy("place")) - 1
    payload = F.when(F.col("kind") == "stream", F.col("_text")).otherwise(F.col("_p.payload"))
    outputs = held.select("page", "cell", position.cast("int").alias("position"), "kind", "name", payload.alias("payload"), none.alias("problem"))
    lost = changes.where("op = 'problem'").select("page", "cell", F.lit(None).cast("int").alias("position"), "kind", none.alias("name"), "payload", F.lit("unknown-display").alias("problem"))
    return outputs.unionAll(lost)
