"""Concatenate and cut, centroid clustering and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recordloom.llm import dialogue, drake, windows

ODD = "id long, text string, part int, place long, ids string, before long, block int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


# Concatenate and cut


def plain_tokens(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("window", [16, 2048])
def test_cut_stream_is_whole(spark, window):
    rng = random.Random(5)
    texts = [None, "", " ", "word " * 3000, "é\n\t ...", "x"] + [" ".join(rng.choice(["alpha", "beta", "Gamma!"]) for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = [(None if i == 7 else i % 90, t, 1, 2, "x", 3, 4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ODD).repartition(5)
    pieces = windows.concatenate_and_cut(df, "id", "text", PATH, window=window, with_ids=True)
    p = pieces.toPandas()
    assert list(p.columns) == ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert all(zlib.crc32(b) == c and len(b) == 4 * n for b, c, n in zip(p.ids, p.ids_crc32, p.length))
    # Every document comes out whole: the pieces, put in the order of the stream, are the documents' tokens.
    p = p.sort_values(["sequence_id", "offset"])
    stream = np.frombuffer(b"".join(p.ids), "<u4").tolist()
    docs, at = [], 0
    for n in p[p.start == 0].doc_tokens:
        docs.append(tuple(stream[at : at + n]))
        at += n
    assert at == len(stream)
    assert sorted(docs) == sorted(tuple(plain_tokens(t)) for t in texts)
    # Sequences are gapless, full, and at the end powers of two.
    ends = (p.offset + p.length).groupby(p.sequence_id).max()
    assert list(ends.index) == list(range(len(ends)))
    assert (p.groupby("sequence_id").length.sum() == ends).all()
    full = len(stream) // window
    assert (ends[:full] == window).all() and list(ends[full:]) == [1 << b for b in reversed(range(window.bit_length())) if len(stream) % window >> b & 1]
    made = windows.training_sequences(pieces).toPandas().sort_values("sequence_id")
    assert b"".join(made.ids) == b"".join(p.ids) and list(made.n_tokens) == list(ends)


def test_cut_of_nothing(spark):
    out = windows.concatenate_and_cut(spark.createDataFrame([], ODD), "id", "text", PATH)
    assert out.count() == 0 and "sequence_id" in out.columns
    with pytest.raises(ValueError):
        windows.concatenate_and_cut(spark.createDataFrame([], ODD), "id", "text", PATH, window=100)


def test_partition_starts_over_blocks(spark):
    n = 3 * windows.BLOCK + 5
    totals = spark.range(n).select(F.col("id").cast("int").alias("part"), (F.col("id") % 7 + 1).alias("total")).where("part % 5 <> 3")
    found = {r.part: r.base for r in windows.partition_starts(totals).collect()}
    at = 0
    for part in range(n):
        if part % 5 != 3:
            assert found[part] == at
            at += part % 7 + 1


# Centroid clustering


def plain_clusters(rows, k, dim, rounds, seed=2):
    """Rows of (id, vector) -> (id, cluster, distance) of each kept row in order, and the centroids."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    raw = lambda v: np.array(v, "<i4").tobytes()
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), raw(r[1])))
    cents = [v for _, v in first[:k]]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]
        if n < rounds:
            for j in range(len(cents)):
                mine = [v for (_, v), (_, own) in zip(kept, found) if own == j]
                if mine:
                    cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, own, d) for (i, _), (d, own) in zip(kept, found)], cents


@pytest.mark.parametrize("k, spread", [(3, 1.0), (24, 0.3), (40, 0.02)])
def test_clusters_equal_plain_rounds(spark, k, spread):
    rng = np.random.default_rng(k)
    middles = rng.normal(size=(12, 6))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 12] + spread * rng.normal(size=6)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 520)]  # one vector many times
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[1][1]), (None, [0.0] * 6), (600, None), (601, []), (602, [1.0] * 5), (603, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (604, [float("nan")] * 6), (605, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "id long, e array<float>, vec string, own int, cluster int").repartition(4)
    out, cents = drake.cluster_vectors(df, "id", "e", k=k, dim=6, rounds=5)
    key = lambda r: tuple((x is None, x) for x in r)
    want, plain = plain_clusters(rows, k, 6, 5)
    assert cents.tolist() == plain
    assert sorted(map(tuple, out.select("id", "cluster", "distance").collect()), key=key) == sorted(want, key=key)


def test_bounds_certify_most_and_never_err():
    rng = np.random.default_rng(1)
    middles = rng.integers(-3000, 3000, (32, 8))
    v = middles[rng.integers(0, 32, 2000)] + rng.integers(-60, 60, (2000, 8))
    v[:50] = v[0]
    cents, measured = middles + rng.integers(-200, 200, (32, 8)), 0
    held = drake.Bounds(v, cents, 8)
    held.scan(np.arange(len(v)))
    for step, b in ((30, 8), (300, 8), (1, 6), (0, 4), (9, 4)):
        after = cents + rng.integers(-step, step + 1, cents.shape)
        moves = np.sqrt(drake.squared_to(after, cents).astype(float)) * (1 + drake.MARGIN)
        new = drake.Bounds(v, after, b)
        scans = []
        new.scan, scan = (lambda rows, f=new.scan: (scans.append(len(rows)), f(rows))), new.scan
        new.moved(held.own, held.near, held.low, held.rest, moves)
        d2 = drake.squared(v, after)
        assert (new.own == d2.argmin(1)).all() and (new.distance == d2.min(1)).all()
        for rows in range(0, 2000, 97):
            assert all(new.low[rows, j] <= np.sqrt(d2[rows, new.near[rows, j]]) for j in range(b))
            others = set(range(32)) - {new.own[rows], *new.near[rows].tolist()}
            assert new.rest[rows] <= min(np.sqrt(d2[rows, j]) for j in others)
        measured += sum(scans)
        held, cents = new, after
    assert measured < 1000  # of 10,000 assignments


def test_clusters_of_odd_tables(spark):
    schema = "id long, e array<double>"
    out = drake.cluster_digest(spark.createDataFrame([], schema), "id", "e")
    assert out.count() == 0 and out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = drake.cluster_digest(spark.createDataFrame([(1, [0.5, -1.0]), (2, [0.5, -1.0])], schema), "id", "e", k=9, dim=2, rounds=2).collect()
    # Equal centroids: both vectors go to the smaller number.
    assert {(r.cluster, r.distance, r.inertia, r.centroid_sha256) for r in few} == {(0, 0, 0, hashlib.sha256(b"128,-256").hexdigest())}
    big, _ = drake.cluster_vectors(spark.createDataFrame([(i, [float(i * 40000), 3.0]) for i in range(9)], schema), "id", "e", k=2, dim=2, rounds=3)
    rows = [(i, [float(i * 40000), 3.0]) for i in range(9)]
    assert sorted(map(tuple, big.collect())) == plain_clusters(rows, 2, 2, 3)[0]
    with pytest.raises(Exception, match="2\\*\\*27"):
        drake.cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], schema), "id", "e", k=1, dim=2)
    with pytest.raises(ValueError):
        drake.cluster_vectors(spark.createDataFrame([], schema), "id", "e", k=1 << 20)


# Conversation repair


def every_repair(tokens):
    """The least (cost, audit) by trying all edits with up to two insertions in each place."""
    gaps = [""] + ["".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    best = None
    for between in itertools.product(gaps, repeat=len(tokens) + 1):
        ways = [("D",) if t == "-" else ("K", "u", "a", "D") for t in tokens]
        for edits in itertools.product(*ways):
            roles, audit, cost = between[0], "I" * len(between[0]), 2 * sum(map(len, between))
            for t, e, more in zip(tokens, edits, between[1:]):
                audit += "R" if e in "ua" else e
                roles += t.lower() if e == "K" else "" if e == "D" else e
                cost += {"K": 0, "D": 3}.get(e, 2) + (e != "D" and t.isupper())
                roles, audit = roles + more, audit + "I" * len(more)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_states(tokens):
    """The same by the least (cost, audit) of each state of the roles so far."""
    nothing, system, user, assistant = range(4)
    put = {(nothing, "u"): user, (system, "u"): user, (assistant, "u"): user, (user, "a"): assistant, (nothing, "s"): system}

    def inserted(states):
        for _ in range(2):
            for q, (c, a) in list(states.items()):
                for r in "ua":
                    if (q, r) in put:
                        states[put[q, r]] = min(states.get(put[q, r], (9**9, "")), (c + 2, a + "I"))
        return states

    states = inserted({nothing: (0, "")})
    for t in tokens:
        after = {}
        for q, (c, a) in states.items():
            ways = [(q, c + 3, "D")]
            if t != "-":
                ways += [(put[q, t.lower()], c + t.isupper(), "K")] if (q, t.lower()) in put else []
                ways += [(put[q, r], c + 2 + t.isupper(), "R") for r in "ua" if (q, r) in put]
            for r, cost, e in ways:
                after[r] = min(after.get(r, (9**9, "")), (cost, a + e))
        states = inserted(after)
    return min(states[q] for q in (nothing, assistant) if q in states)


def test_repair_equals_every_edit():
    r = dialogue.Repairer()
    for n in (0, 1, 2):
        for tokens in itertools.product("suaxSUAX-", repeat=n):
            assert r.parse(tokens) == every_repair(tokens), tokens
    rng = random.Random(3)
    for _ in range(8):
        tokens = rng.choices("suaxSUA-", k=3)
        assert r.parse(tokens) == every_repair(tokens), tokens
    for _ in range(1500):
        tokens = rng.choices("suuaaxSUA-", k=rng.randrange(14))
        assert r.parse(tokens) == by_states(tokens), tokens


def test_repair_of_long_conversations_is_linear():
    r, rng, took = dialogue.Repairer(), random.Random(4), []
    tokens = "".join(rng.choices("uaUA-s", k=6000))
    assert r.parse(tokens) == by_states(tokens)
    for n in (10_000, 40_000):
        began = time.process_time()
        cost, audit = r.parse("ua" * (n // 2 - 1) + "uu")
        took.append(time.process_time() - began)
        assert cost == 2 and len(audit) == n + (audit.count("I"))
    assert took[1] < 10 * took[0]


CONVERSATIONS = "conv_id long, turn long, role string, text string, letter string, head boolean, lost int"


def plain_repair(rows):
    """Contract of the operator, conversation by conversation."""
    out, space = [], lambda x: " " if x is None else str(x)
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            role, text = "user" if h == 4 else space(role), "" if h == 1 else re.sub("[.!?]", "", space(text)) if h == 2 else space(text)
            turns += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        tokens, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for i, (_, role, text) in enumerate(turns):
            seen = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not seen else "duplicate" if (role, text) in [t[1:] for t in turns[:i]] else "truncated" if seen[-1] not in ".!?" else None
            token = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if fault:
                faults[fault] += 1
            tokens.append({"truncated": token.upper(), None: token}.get(fault, "-"))
        numbers = sorted({t[0] for t in turns} - {None})
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = by_states(tokens)
        left, lines, last = list(turns), [], ""
        for e in audit:
            _, role, text = (None, None, "") if e == "I" else left.pop(0)
            if e != "D":
                role = role if e == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{text}")
                last = role[:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, numbers[-1] - numbers[0] + 1 - len(numbers) if numbers else 0, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def test_conversations_equal_plain_repair(spark):
    rng = random.Random(6)
    texts = ["Hello.", "hello", "What?", "", " \t\n", "no end", "Yes! ", "\xa0", None, "Long text. " * 2000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in [*range(60), None] for t in rng.sample(range(30), rng.randrange(1, 9))]
    rows += [(3, None, "user", "Hello."), (3, None, "user", "Hello."), (70, None, None, None), (71, 4, "user", "a."), (71, 4, "user", "b."), (71, 4, "assistant", "a.")]
    rows += [(72, t, "user" if t % 2 else "assistant", "Same.") for t in range(1500)]  # one long conversation of repeats
    dropped = next(c for c in range(100, 10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "Gone.")]
    df = spark.createDataFrame([(*r, "x", True, 5) for r in rows], CONVERSATIONS).repartition(6)
    found = dialogue.repair_digest(dialogue.damaged(df, "conv_id", "turn", "role", "text"))
    got = sorted(map(tuple, found.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == plain_repair(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert next(r for r in got if r[0] == dropped) == (dropped, 0, 0, 0, 0, 0, 0, "", empty)


def test_repaired_turns_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (2, 0, "tool", "")]
    df = spark.createDataFrame([(*r, "x", True, 5) for r in rows], CONVERSATIONS)
    out = dialogue.repair(dialogue.intact(df, "conv_id", "turn", "role", "text")).where("place >= 0").select("conv", "place", "turn", "role", "text", "edit")
    assert [tuple(r) for r in out.orderBy("conv", "place").collect()] == [(1, 0, 0, "user", "Hi.", "K"), (1, 1, None, "assistant", "", "I"), (1, 2, 1, "user", "Again.", "K"), (1, 3, 2, "assistant", "Yes.", "K")]
    assert dialogue.repair_digest(dialogue.damaged(df.limit(0), "conv_id", "turn", "role", "text")).count() == 0
