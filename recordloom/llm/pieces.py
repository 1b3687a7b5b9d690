"""N-best SentencePiece segmentation: exact forward Viterbi scores guide a backward A-star search of the piece lattice.

A text is normalised as the model asks (a leading word mark, blanks written as marks; other normalisers are refused)
and cut where no piece can cross: before a run of marks, and around control characters that occur in no piece. The
lattice of a segment has an edge for each piece and, where no piece of one character starts, an edge for the unknown
character, which is written as its UTF-8 bytes. The forward pass gives the best score of every prefix. The backward
search starts at the end of the segment and orders its agenda by the score of the suffix found plus the forward score
of what is left, which is exactly the best completion, so complete segmentations leave the agenda in order of their
scores. The n best of a whole text combine those of its segments; only the ``n - 1`` segments with the smallest gap
between their best and second segmentation can differ from their best there, which makes the combination exact.

Scores have to be log-probabilities for a best segmentation to mean anything. A unigram model has them. Those of a BPE
model are the ranks of its merges, so such a model is only taken with scores that are fitted here (``fit_scores``): the
model's own encodings of all texts give first counts, and rounds of expectation and maximisation over the lattices of
their segments, by forward and backward sums, give the probabilities. Every text counts: the different segments of the
table are counted once by a shuffle, and each round goes over them. Pieces that were never expected get the probability
of a tenth of an occurrence. Lattices of many segments are followed together, place by place, with the same results.

Defined results. Null and empty texts have the one empty segmentation with score 0. Of segmentations with equal scores
any may come first. Equal rows are treated one by one; an empty table gives an empty result; further columns are not
looked at. Texts are taken whole; the segments kept for other texts are bounded and lie in arrays. Decoding writes marks as blanks and drops the
leading one, so decoding an encoding gives the text back, with any literal mark as a blank.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, crc_bytes, map_batches, remove_path, table, written

MARK = "▁"
INF = float("inf")
#: Segments of more characters are not kept in memory for other texts.
LONG = 64


def _log_add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -INF else a + math.log1p(math.exp(b - a))


class PieceModel:
    """The pieces of a model file, their scores, and segmentation of single segments."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """``kinds``: for each piece ``normal``, ``byte`` or ``other`` (control, unknown, unused)."""
        self.root: dict[str, list] = {}  # character -> [children, id or -1, score]
        self.byte_ids = [-1] * 256
        self.raw = [b""] * len(pieces)
        crossing, used = False, set()
        for i, (piece, kind) in enumerate(zip(pieces, kinds)):
            if kind == "byte":
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif kind == "normal" and piece:
                children, node = self.root, None
                for c in piece:
                    node = children.setdefault(c, [{}, -1, 0.0])
                    children = node[0]
                node[1:] = i, scores[i]
                self.raw[i] = piece.replace(MARK, " ").encode()
                used |= set(piece)
                crossing = crossing or MARK in piece.lstrip(MARK)
        self.unknown = min((s for s, k in zip(scores, kinds) if k == "normal"), default=0.0) - 10.0
        self.crossing = crossing
        self.alone = alone = "".join(c for c in "\t\n\x0b\x0c\r" if c not in used)
        cls = f"{MARK}{alone}"
        self.cutter = re.compile("[\\s\\S]+") if crossing else re.compile(f"{MARK}*[^{cls}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))

    @classmethod
    def load(cls, path: str, scores: dict[int, float] | None = None) -> PieceModel:
        """``scores`` are log-probabilities of pieces by id, with that of the rest at -1; a BPE model needs them."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only models with the identity normaliser and a leading mark are known here")
        if proto.trainer_spec.model_type != proto.trainer_spec.UNIGRAM and scores is None:
            raise ValueError("the scores of this model are no log-probabilities: fit them first")
        kind = {1: "normal", 4: "normal", 6: "byte"}
        held = [p.score if scores is None else scores.get(i, scores[-1]) for i, p in enumerate(proto.pieces)]
        return cls([p.piece for p in proto.pieces], held, [kind.get(p.type, "other") for p in proto.pieces])

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if self.crossing or "  " in text or MARK in text or text[0] == " ":
            return self.cutter.findall(MARK + text.replace(" ", MARK))
        # Every mark begins a segment, so blanks can stand for the cuts.
        text = MARK + text.replace(" ", " " + MARK)
        apart = False
        for c in self.alone:
            if c in text:
                text, apart = text.replace(c, f" {c} "), True
        return [s for s in text.split(" ") if s] if apart else text.split(" ")

    def count_segments(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The different segments of texts that are neither null nor empty, and how often they occur."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, MARK), pc.starts_with(texts, " ")))
        odd = pa.array([True] * len(texts)) if self.crossing else odd
        plain = pc.replace_substring(texts.filter(pc.invert(odd)), " ", " " + MARK)
        for c in self.alone:
            plain = pc.replace_substring(plain, c, f" {c} ")
        plain = pc.split_pattern(pc.binary_join_element_wise(MARK, plain, ""), " ").flatten()
        rest = pa.array([s for t in texts.filter(odd).to_pylist() for s in self.segments(t)], pa.string())
        counts = pc.value_counts(pa.concat_arrays([plain, rest]))
        counts = counts.filter(pc.not_equal(counts.field("values"), ""))
        return counts.field("values"), counts.field("counts")

    def lattice(self, seg: str) -> list[tuple[int, int, int, float]]:
        """Edges (from, to, id or -1, score), by their start."""
        edges, n = [], len(seg)
        for i in range(n):
            j, at, single = i, self.root.get(seg[i]), False
            while at is not None:
                j += 1
                at, p, s = at
                if p >= 0:
                    edges.append((i, j, p, s))
                    single = single or j == i + 1
                at = at.get(seg[j]) if j < n else None
            if not single:
                edges.append((i, i + 1, -1, self.unknown))
        return edges

    def expected(self, seg: str, times: float, counts: dict[int, float]) -> None:
        """Add how often each piece is expected in the segmentations of a segment that occurs ``times`` times."""
        edges, n = self.lattice(seg), len(seg)
        alpha, beta = [0.0] + [-INF] * n, [-INF] * n + [0.0]
        for i, j, _, s in edges:
            alpha[j] = _log_add(alpha[j], alpha[i] + s)
        for i, j, _, s in reversed(edges):
            beta[i] = _log_add(beta[i], s + beta[j])
        for i, j, p, s in edges:
            if p >= 0:
                counts[p] = counts.get(p, 0.0) + times * math.exp(alpha[i] + s + beta[j] - alpha[n])

    @cached_property
    def flat(self) -> _Flat:
        return _Flat(self)

    def expected_all(self, segs: list[str], times: np.ndarray) -> np.ndarray:
        """What ``expected`` adds for all these segments, as an array over the pieces."""
        counts, left = self.flat.expected(segs, times)
        alone: dict[int, float] = {}
        for at in left:
            self.expected(segs[at], float(times[at]), alone)
        counts[list(alone)] += list(alone.values())
        return counts

    def best_all(self, segs: list[str]) -> list[tuple[bytes, float, float]]:
        """``best`` of each of these segments, which are worked on together."""
        found = self.flat.best(segs)
        return [self.best(seg) if x is None else x for seg, x in zip(segs, found)]

    def _ids(self, seg: str, path: list[tuple[int, int, int, float]]) -> tuple[int, ...]:
        out: list[int] = []
        for i, j, p, _ in path:
            if p >= 0:
                out.append(p)
            else:
                out += [self.byte_ids[b] for b in seg[i:j].encode()]
        return tuple(out)

    def best(self, seg: str) -> tuple[bytes, float, float]:
        """Ids of the best segmentation as bytes, its score, and the gap to the second (infinite if there is none).

        The best score of every suffix comes from its best first edge. The second segmentation leaves the best one at
        some state by the second edge there, so the gap is the least difference of those two along the best path.
        """
        n, root, unknown = len(seg), self.root, self.unknown
        beta, to, ids, second = [0.0] * (n + 1), [0] * n, [-1] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            top = next_ = -INF
            j, at, p = i, root.get(seg[i]), -1
            if at is None or at[1] < 0:
                top, to[i], ids[i] = unknown + beta[i + 1], i + 1, -1
            while at is not None:
                j += 1
                at, p, s = at
                if p >= 0:
                    v = s + beta[j]
                    if v > top:
                        next_, top = top, v
                        to[i], ids[i] = j, p
                    elif v > next_:
                        next_ = v
                if j == n:
                    break
                at = at.get(seg[j])
            beta[i], second[i] = top, top - next_
        out, gap, i = [], INF, 0
        while i < n:
            if second[i] < gap:
                gap = second[i]
            if ids[i] >= 0:
                out.append(ids[i])
            else:
                out += [self.byte_ids[b] for b in seg[i].encode()]
            i = to[i]
        return array("I", out).tobytes(), beta[0], gap

    def nbest(self, seg: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a segment, the best first."""
        size, into = len(seg), [[] for _ in range(len(seg) + 1)]
        alpha = [0.0] + [-INF] * size
        for e in self.lattice(seg):
            i, j, _, s = e
            into[j].append(e)
            if alpha[i] + s > alpha[j]:
                alpha[j] = alpha[i] + s
        # Of equal scores the state nearest to the start goes first, so ties are followed to their end.
        agenda, made, out = [(-alpha[size], size, 0, 0.0, None)], 0, []
        while agenda and len(out) < n:
            _, at, _, tail, link = heapq.heappop(agenda)
            if at == 0:
                path = []
                while link is not None:
                    path.append(link[0])
                    link = link[1]
                out.append((tail, self._ids(seg, path)))
                continue
            for e in into[at]:
                made += 1
                g = tail + e[3]
                heapq.heappush(agenda, (-(g + alpha[e[0]]), e[0], made, g, (e, link)))
        return out

    @cached_property
    def raw_column(self) -> pa.Array:
        return pa.array(self.raw, pa.binary())

    def decode(self, ids) -> str:
        held = self.raw_column.take(pa.array(ids, pa.uint32())).buffers()[2]
        text = (b"" if held is None else held.to_pybytes()).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class _Columns:
    """Segments side by side: by falling length, so that those with a character at place ``i`` are the first ``n[i]``."""

    def __init__(self, segs: list[str]):
        sizes = np.fromiter(map(len, segs), np.int64, len(segs))
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.longest = int(self.sizes[0]) if len(segs) else 0
        flat = np.frombuffer("".join([segs[i] for i in self.order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(self.sizes) - self.sizes
        self.n = np.searchsorted(-self.sizes, -np.arange(self.longest + 1), "left")
        self.codes = [flat[starts[: self.n[i]] + i] for i in range(self.longest)]


class _Flat:
    """The trie of a model as arrays, to follow the lattices of many segments at a time.

    A node's child by the character class ``c`` is at ``base[node] + c``, if that place belongs to the node.
    """

    #: For each character, scores are raised by this: it is the same for all segmentations and keeps products in range.
    LIFT = 8.0

    def __init__(self, model: PieceModel):
        nodes, kids, at = [(-1, 0.0)], [model.root], 0
        links: list[list[tuple[str, int]]] = []
        while at < len(kids):
            links.append([])
            for c, (children, p, s) in kids[at].items():
                links[at].append((c, len(nodes)))
                nodes.append((p, s))
                kids.append(children)
            at += 1
        self.ids = np.array([p for p, _ in nodes], np.int64)
        self.scores = np.array([s for _, s in nodes])
        self.inner = np.array([bool(x) for x in links])
        self.unknown, self.pieces = model.unknown, len(model.raw)
        chars = sorted({c for x in links for c, _ in x})
        self.cls = np.full(0x110000, len(chars), np.int32)
        self.cls[[ord(c) for c in chars]] = np.arange(len(chars))
        number = {c: i for i, c in enumerate(chars)}
        used = bytearray(4 * len(nodes) + 2 * len(chars))
        owner, child = np.full(len(used), -1, np.int32), np.zeros(len(used), np.int32)
        self.base, free, several = np.zeros(len(nodes), np.int32), 0, True
        for node in sorted(range(len(links)), key=lambda i: -len(links[i])):
            if not links[node]:
                break
            places = sorted(number[c] for c, _ in links[node])
            if several and len(places) == 1:  # these fill the gaps
                several, free = False, 0
            at = free = used.index(0, max(free, places[0] if several else 0))
            if not several and at < places[0]:
                at = used.index(0, places[0])
            while any(used[at - places[0] + c] for c in places):
                at = used.index(0, at + 1)
            if several:
                free = at
            self.base[node] = at - places[0]
            for c, to in links[node]:
                where = at - places[0] + number[c]
                used[where], owner[where], child[where] = 1, node, to
        self.owner, self.child = np.append(owner, np.full(len(chars) + 1, -1, np.int32)), np.append(child, np.zeros(len(chars) + 1, np.int32))

    def edges(self, cols: _Columns, i: int, classes: list[np.ndarray]) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(segments, end, nodes) of the edges that begin at place ``i``, shorter ones first; node -1: the unknown character."""
        out, at, node, j = [], np.arange(cols.n[i]), np.zeros(cols.n[i], np.int32), i
        while len(at):
            where = self.base[node] + classes[j][at]
            ok = self.owner[where] == node
            at, node = at[ok], self.child[where[ok]]
            j += 1
            held = self.ids[node] >= 0
            if j == i + 1:
                single = np.zeros(cols.n[i], bool)
                single[at[held]] = True
                if not single.all():
                    lone = np.flatnonzero(~single)
                    out.append((lone, j, np.full(len(lone), -1, np.int32)))
            out.append((at[held], j, node[held]))
            if j >= cols.longest:
                break
            more = self.inner[node] & (at < cols.n[j])
            at, node = at[more], node[more]
        return [e for e in out if len(e[0])]

    def expected(self, segs: list[str], times: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Expected occurrences of each piece, and the segments that are left out as their products leave the range."""
        cols, counts = _Columns(segs), np.zeros(self.pieces)
        size = len(segs)
        classes = [self.cls[c] for c in cols.codes]
        weight, lone = np.exp(self.scores), np.exp(self.unknown + self.LIFT)
        beta = [np.zeros(size) for _ in range(cols.longest + 1)]
        for i in range(cols.longest + 1):
            beta[i][cols.sizes == i] = 1.0
        alpha = [np.zeros(size) for _ in range(cols.longest + 1)]
        lattice: list = [None] * cols.longest
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for i in range(cols.longest - 1, -1, -1):
                lattice[i] = [(at, j, node, np.where(node < 0, lone, weight[node] * np.exp(self.LIFT * (j - i)))) for at, j, node in self.edges(cols, i, classes)]
                for at, j, _, w in lattice[i]:
                    beta[i][at] += w * beta[j][at]
            whole = beta[0].copy()
            left = ~np.isfinite(whole) | (whole < 1e-280)
            share = np.where(left, 0.0, times[cols.order] / whole)
            alpha[0][:] = 1.0
            for i in range(cols.longest):
                for at, j, node, w in lattice[i]:
                    to = alpha[i][at] * w
                    alpha[j][at] += to
                    given = to * beta[j][at] * share[at]
                    left[at[~np.isfinite(given) & ~left[at]]] = True
            for i in range(cols.longest):
                for at, j, node, w in lattice[i]:
                    ok = (node >= 0) & ~left[at]
                    given = (alpha[i][at] * w * beta[j][at] * share[at])[ok]
                    counts += np.bincount(self.ids[node[ok]], given, self.pieces)
        return counts, cols.order[left].tolist()

    def best_columns(self, segs: list[str]) -> tuple[np.ndarray, ...]:
        """Order, ids, number of ids, score and gap of the best segmentations, one after the other in this order of the
        segments, and whether they have an unknown character, whose ids are missing."""
        cols, size = _Columns(segs), len(segs)
        classes = [self.cls[c] for c in cols.codes]
        beta = np.zeros((cols.longest + 1, size))
        second, ids, to = np.zeros((cols.longest, size)), np.full((cols.longest, size), -1, np.int32), np.zeros((cols.longest, size), np.int16)
        for i in range(cols.longest - 1, -1, -1):
            top, next_ = np.full(cols.n[i], -INF), np.full(cols.n[i], -INF)
            for at, j, node in self.edges(cols, i, classes):
                v = (self.scores[node] if node[0] >= 0 else self.unknown) + beta[j, at]
                held = top[at]
                better = v > held
                next_[at] = np.where(better, held, np.maximum(next_[at], v))
                won = at[better]
                top[won], to[i, won], ids[i, won] = v[better], j, self.ids[node[better]] if node[0] >= 0 else -1
            beta[i, : cols.n[i]], second[i, : cols.n[i]] = top, top - next_
        gap, unknown = np.full(size, INF), np.zeros(size, bool)
        at, place, taken = np.arange(size), np.zeros(size, np.int64), []
        at = at[cols.sizes > 0]
        while len(at):
            here = place[at]
            gap[at] = np.minimum(gap[at], second[here, at])
            p = ids[here, at]
            unknown[at[p < 0]] = True
            taken.append((at, p))
            place[at] = to[here, at]
            at = at[place[at] < cols.sizes[at]]
        owner = np.concatenate([a for a, _ in taken]) if taken else np.empty(0, np.int64)
        raw = np.concatenate([p for _, p in taken])[np.argsort(owner, kind="stable")].astype("<u4") if taken else np.empty(0, "<u4")
        return cols.order, raw, np.bincount(owner, minlength=size), beta[0], gap, unknown

    def best(self, segs: list[str]) -> list[tuple[bytes, float, float] | None]:
        """As ``PieceModel.best``, by the same sums; None where the best segmentation has an unknown character."""
        order, raw, sizes, scores, gaps, unknown = self.best_columns(segs)
        raw, ends, out = raw.tobytes(), (4 * np.cumsum(sizes)).tolist(), [None] * len(segs)
        for k, start, end, score, g, odd in zip(order.tolist(), [0, *ends], ends, scores.tolist(), gaps.tolist(), unknown.tolist()):
            if not odd:
                out[k] = raw[start:end], score, g
        return out


_models: dict = {}


def model_at(path: str, scores: dict[int, float] | None = None) -> PieceModel:
    """One model for each Python worker."""
    key = path, None if scores is None else hash(tuple(sorted(scores.items())))
    if key not in _models:
        _models[key] = PieceModel.load(path, scores)
    return _models[key]


def needs_scores(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto.trainer_spec.model_type != proto.trainer_spec.UNIGRAM


def _logs(counts: list[tuple[int, float]]) -> dict[int, float]:
    """Log-probabilities of pieces by id; at -1 that of a piece that was never expected."""
    total = sum(max(n, 0.1) for _, n in counts) + 1.0
    return {-1: math.log(0.1 / total)} | {p: math.log(max(n, 0.1) / total) for p, n in counts}


def _counted(model_path: str, most_bytes: int = 32 << 20):
    """Texts -> (seg, n): how often their segments occur, in parts of about ``most_bytes`` or one text."""

    def run(batches):
        model = model_at(model_path, {-1: 0.0})
        for batch in batches:
            texts, at = batch.column(0), 0
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
                segs, counts = model.count_segments(texts.slice(at, to - at))
                yield pa.record_batch({"seg": segs, "n": counts})
                at = to

    return run


def _summed(count):
    """(seg, n) -> (piece, n): the sums of ``count(segments, times)``, which gives an array over the pieces."""

    def run(batches, at_once=40_000):
        total, segs, times = 0.0, [], []
        for batch in batches:
            segs += batch.column(0).to_pylist()
            times.append(batch.column(1).to_numpy(zero_copy_only=False).astype(float))
            if len(segs) >= at_once:
                total, segs, times = total + count(segs, np.concatenate(times)), [], []
        if segs:
            total = total + count(segs, np.concatenate(times))
        pieces = np.flatnonzero(total)
        yield pa.record_batch({"piece": pa.array(pieces, pa.int32()), "n": pa.array(total[pieces] if len(pieces) else [], pa.float64())})

    return run


@cache
def _encoder(model_path: str):
    """The model's own encoder, for segments, which have their marks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def own_counts(model_path: str, segs: list[str], times: np.ndarray) -> np.ndarray:
    """How often the model's own encodings have each piece. No piece crosses a cut, so a text's is that of its segments."""
    model = _encoder(model_path)
    ids = model.encode(segs)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.bincount(np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum()), np.repeat(times, sizes), model.get_piece_size())


def fit_scores(df: DataFrame, text_col: str, model_path: str, rounds: int = 2) -> dict[int, float]:
    """Log-probabilities of a model's pieces, fitted to all texts of ``df``.

    Segments are counted first, so a round's work follows the different ones. The driver gets a count for each piece.
    """
    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null and text <> ''")
    paths: list[str] = []
    found = written(texts.mapInArrow(_counted(model_path), "seg string, n long").groupBy("seg").agg(F.sum("n").alias("n")), "segments", paths)

    def fit(count) -> dict[int, float]:
        counts = found.mapInArrow(_summed(count), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        return _logs([(r.piece, r.n) for r in counts.collect()])

    scores = fit(lambda segs, times: own_counts(model_path, segs, times))
    for _ in range(rounds):
        scores = fit(lambda segs, times, scores=scores: model_at(model_path, scores).expected_all(segs, times))
    for path in paths:
        remove_path(df.sparkSession, path)
    return scores


def fitted(df: DataFrame, text_col: str, model_path: str, **options) -> dict[int, float] | None:
    """``fit_scores`` where the model has no probabilities of its own, else None."""
    return fit_scores(df, text_col, model_path, **options) if needs_scores(model_path) else None


def text_nbest(model: PieceModel, text: str, n: int, best: dict, more: dict, segs: list[str] | None = None) -> list[tuple[float, bytes]]:
    """The ``n`` best segmentations of a text as (score, ids); ``best`` and ``more`` memoise segments. ``segs``: those of the text."""
    segs = model.segments(text) if segs is None else segs
    raw, scores, gaps = map(list, zip(*map(best.__getitem__, segs))) if segs else ([], [], [])
    bounds = np.cumsum([0, *map(len, raw)]).tolist()
    return combined(n, segs, sum(scores), np.array(gaps), b"".join(raw), bounds, more)


def combined(n: int, segs: list[str], top: float, gaps: np.ndarray, raw: bytes, bounds: list[int], more: dict) -> list[tuple[float, bytes]]:
    """The ``n`` best segmentations of a text from the best ones of its segments, which lie in ``raw`` between ``bounds``."""
    free = np.flatnonzero(gaps < INF)
    chosen = free[np.argsort(gaps[free], kind="stable")[: n - 1]].tolist()
    first: dict[int, bytes] = {}
    ways: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
    for at in chosen:
        options = more[segs[at]]
        first[at] = options[0][1]  # of equal best ones, the one that the others were found beside
        ways = heapq.nsmallest(
            n,
            ((loss + d, held | {at: ids} if k else held) for loss, held in ways for k, (d, ids) in enumerate(options)),
            key=lambda w: w[0],
        )
    # What lies between the chosen segments is the same in all ways.
    places = sorted(chosen)
    between = [raw[i:j] for i, j in zip([bounds[0], *[bounds[at + 1] for at in places]], [*[bounds[at] for at in places], bounds[-1]])]
    out = []
    for loss, held in ways:
        parts = [x for at, part in zip(places, between) for x in (part, held.get(at, first[at]))]
        out.append((top - loss, b"".join([*parts, between[-1]])))
    return out


class _Short(Memo):
    """A memo that does not keep long segments."""

    def __missing__(self, seg):
        return super().__missing__(seg) if len(seg) <= LONG else self.compute(seg)

    def fill(self, segs: set[str], compute_all) -> None:
        """Take in what is not held of these segments, computed together; no more than the limit."""
        new = [s for s in segs.difference(self) if len(s) <= LONG][: self.limit]
        held = {s: self.older[s] for s in new if s in self.older}
        rest = [s for s in new if s not in held]
        if len(self) + len(new) > self.limit:
            self.older = dict(self)
            self.clear()
        self.update(held)
        self.update(zip(rest, compute_all(rest)))



class _Kept:
    """Best segmentations of segments by arrays: for each its score, its gap and where its ids are.

    Once more than ``limit`` segments or ``most_ids`` ids would be held, those that the texts at hand do not have go.
    """

    def __init__(self, model: PieceModel, limit: int = 200_000, most_ids: int = 4_000_000):
        self.model, self.limit, self.most_ids = model, limit, most_ids
        self.number: dict[str, int] = {}
        self.ids, self.sizes, self.scores, self.gaps = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.starts = self.sizes

    def gathered(self, at: np.ndarray) -> np.ndarray:
        """The ids of these segments, one after the other."""
        sizes = self.sizes[at]
        return self.ids[np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def _add(self, new: list[str]) -> None:
        short, parts = [s for s in new if len(s) <= LONG], []
        alone = [s for s in new if len(s) > LONG]
        if short:
            order, ids, sizes, scores, gaps, odd = self.model.flat.best_columns(short)
            plain = ~odd
            alone += [short[i] for i in order[odd].tolist()]
            parts.append(([short[i] for i in order[plain].tolist()], ids[np.repeat(plain, sizes)], sizes[plain], scores[plain], gaps[plain]))
        for seg in alone:
            ids, score, gap = self.model.best(seg)
            parts.append(([seg], np.frombuffer(ids, "<u4"), [len(ids) // 4], [score], [gap]))
        segs, *columns = zip(*parts)
        self.number.update(zip(chain.from_iterable(segs), range(len(self.number), len(self.number) + len(new))))
        held = self.ids, self.sizes, self.scores, self.gaps
        self.ids, self.sizes, self.scores, self.gaps = (np.concatenate([old, *x]) for old, x in zip(held, columns))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def places(self, segs: list[str]) -> np.ndarray:
        """The numbers of these segments, which hold until the next call."""
        found = list(map(self.number.get, segs))
        new = list(dict.fromkeys([s for s, i in zip(segs, found) if i is None]))
        if not new:
            return np.array(found, np.int64)
        if self.number and (len(self.number) + len(new) > self.limit or len(self.ids) > self.most_ids):
            of = {s: i for s, i in zip(segs, found) if i is not None}
            kept = np.array(list(of.values()), np.int64)
            ids = self.gathered(kept)
            self.number = dict(zip(of, range(len(of))))
            self.ids, self.sizes, self.scores, self.gaps = ids, self.sizes[kept], self.scores[kept], self.gaps[kept]
        self._add(new)
        return np.fromiter(map(self.number.__getitem__, segs), np.int64, len(segs))


def _work(model_path: str, n: int, give, scores=None):
    def make():
        model = model_at(model_path, scores)
        best = _Kept(model)

        def options(seg):
            ways = model.nbest(seg, n)
            return [(ways[0][0] - s, array("I", ids).tobytes()) for s, ids in ways]

        more = _Short(options, 10_000)

        def ways(texts, most=1_000_000):
            """The segments of texts of about ``most`` characters are looked up together."""
            at = 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and (not part or size + len(texts[at] or "") <= most):
                    size += len(texts[at] or "")
                    part.append(texts[at] or "")
                    at += 1
                segs = [model.segments(t) for t in part]
                places = best.places(list(chain.from_iterable(segs)))
                raw, bounds = best.gathered(places).tobytes(), [0, *(4 * np.cumsum(best.sizes[places])).tolist()]
                scores, gaps, start = best.scores[places].tolist(), best.gaps[places], 0
                for own in segs:
                    end = start + len(own)
                    yield combined(n, own, sum(scores[start:end]), gaps[start:end], raw, bounds[start : end + 1], more)
                    start = end

        return lambda cols: give(model, cols, list(ways(cols["_text"])))

    return make


def _picked(df: DataFrame, id_col: str, col: str, as_name: str) -> tuple[DataFrame, str]:
    p = df.select(df[f"`{id_col}`"].alias("_id"), df[f"`{col}`"].alias(as_name))
    return p, p.schema["_id"].dataType.simpleString()


def encode_nbest(df: DataFrame, id_col: str, text_col: str, model_path: str, n: int = 4, scores: dict[int, float] | None = None) -> DataFrame:
    """Return the id and ``nbest``, an array of (score, ids) with the best segmentation first.

    ``scores`` are log-probabilities of pieces; without them they are fitted to ``df`` where the model has none.
    """
    scores = fitted(df, text_col, model_path) if scores is None else scores

    def give(model, cols, ways):
        return {"_id": cols["_id"], "nbest": [[{"score": s, "ids": array("I", b).tolist()} for s, b in w] for w in ways]}

    p, kind = _picked(df, id_col, text_col, "_text")
    out = map_batches(p, _work(model_path, n, give, scores), f"_id {kind}, nbest array<struct<score:double,ids:array<int>>>")
    return out.withColumnRenamed("_id", id_col)


def decode_ids(df: DataFrame, id_col: str, ids_col: str, model_path: str) -> DataFrame:
    """Return the id and ``text``, decoded from an array of piece ids; null ids give a null text."""

    def make():
        model = model_at(model_path, {-1: 0.0})
        return lambda cols: {"_id": cols["_id"], "text": [None if x is None else model.decode(x) for x in cols["_ids"]]}

    p, kind = _picked(df, id_col, ids_col, "_ids")
    return map_batches(p, make, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def encode_digest(df: DataFrame, id_col: str, text_col: str, model_path: str, n: int = 4, scores: dict[int, float] | None = None) -> DataFrame:
    """What ``encode_nbest`` finds, with CRC-32 sums in place of the ids, and the CRC-32 of the decoded best one.

    The ids are summed as little-endian unsigned 32-bit numbers. ``decoded_same`` tells whether decoding the best
    segmentation gives the text back (a literal mark counts as a blank).
    """
    scores = fitted(df, text_col, model_path) if scores is None else scores

    def give(model, cols, ways):
        out = {"_id": cols["_id"], "n_pieces": [], "nbest_scores": [], "nbest_crc32": [], "decoded_same": []}
        for text, w in zip(cols["_text"], ways):
            out["n_pieces"].append(len(w[0][1]) // 4)
            out["nbest_scores"].append([s for s, _ in w])
            out["nbest_crc32"].append([crc_bytes(b) for _, b in w])
            out["decoded_same"].append(model.decode(np.frombuffer(w[0][1], "<u4")) == (text or "").replace(MARK, " "))
        return out

    p, kind = _picked(df, id_col, text_col, "_text")
    schema = f"_id {kind}, n_pieces long, nbest_scores array<double>, nbest_crc32 array<bigint>, decoded_same boolean"
    return map_batches(p, _work(model_path, n, give, scores), schema).withColumnRenamed("_id", id_col)


def op10_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """The four best segmentations of every document, and whether the best one decodes to the text."""
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    r = encode_digest(table(spark, sf_dir, "documents"), "doc_id", "text", path, 4)
    return r.withColumn("best_score", F.col("nbest_scores")[0])
