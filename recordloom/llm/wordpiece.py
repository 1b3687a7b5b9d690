"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie. Every node carries a failure link and the number of pieces that following this link pops, both
computed once, so that greedy longest-match-first tokenisation of a word takes one step for each character plus one for
each popped group, and yields the number of pieces without building any.

A word is a maximal run of characters other than white space (``str.split``). Its first piece is taken from the
word-initial vocabulary and all later ones from the continuations. A word that cannot be covered counts as one unknown
token. Words of any length go through the automaton; only those of up to ``memo_chars`` characters are remembered.

Defined results. Null and empty texts have no words and no tokens; repeated rows are counted one by one; an empty table
gives an empty result. Texts are taken whole; the memory held is the automaton and a bounded memo of words.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .common import Memo, map_batches, table

UNKNOWN = -1


class LongestMatch:
    """The automaton: ``count(word)`` is the number of greedy pieces, or ``UNKNOWN``."""

    def __init__(self, initial: Iterable[str], continuation: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: start of a word; node 1: start of a later piece
        self.is_piece = [False, False]
        self._depth_order: list[int] = []
        for root, pieces in ((0, initial), (1, continuation)):
            for piece in pieces:
                if piece:
                    self._insert(root, piece)
        self._link()

    def _insert(self, node: int, piece: str) -> None:
        for c in piece:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.is_piece.append(False)
            node = self.next[node][c]
        self.is_piece[node] = True

    def _link(self) -> None:
        """fail[v]: where to go on when v has no child for the next character; popped[v]: how many pieces that emits.

        If the string of v is a piece, it is popped whole and matching restarts at the continuation root. Otherwise
        the link follows the parent's: what the parent pops, and then from there as far as the last character needs.
        A node without a link (None) has a string that greedy matching cannot cover.
        """
        n = len(self.next)
        self.fail: list[int | None] = [None] * n
        self.popped = [0] * n
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if self.is_piece[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, popped = self.fail[u], self.popped[u]
                    while z is not None and c not in self.next[z]:
                        popped += self.popped[z]
                        z = self.fail[z]
                    if z is not None:
                        self.fail[v], self.popped[v] = self.next[z][c], popped
                queue.append(v)

    def count(self, word: str) -> int:
        node, total = 0, 0
        children, fail, popped = self.next, self.fail, self.popped
        for c in word:
            while (to := children[node].get(c)) is None:
                if fail[node] is None:
                    return UNKNOWN
                total += popped[node]
                node = fail[node]
            node = to
        while node > 1:
            if fail[node] is None:
                return UNKNOWN
            total += popped[node]
            node = fail[node]
        return total


def vocabulary(model_path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuation pieces of a public piece model: those with and without the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    mark = "▁"
    return [p[1:] for p in pieces if p.startswith(mark)], [p for p in pieces if not p.startswith(mark)]


_automata: dict[str, LongestMatch] = {}


def automaton(model_path: str) -> LongestMatch:
    """One automaton for each model and Python worker."""
    if model_path not in _automata:
        _automata[model_path] = LongestMatch(*vocabulary(model_path))
    return _automata[model_path]


def token_counts(df: DataFrame, id_col: str, text_col: str, model_path: str, memo_chars: int = 100) -> DataFrame:
    """Return for each row its id, ``n_words``, ``n_tokens`` and ``n_unknown`` (all long)."""

    def make():
        lengths = automaton(model_path)
        memo = Memo(lengths.count)

        def count(word):
            return memo[word] if len(word) <= memo_chars else lengths.count(word)

        def work(cols):
            words, tokens, unknown = [], [], []
            for text in cols["_text"]:
                n = Counter(map(count, (text or "").split()))
                words.append(sum(n.values()))
                unknown.append(n[UNKNOWN])
                tokens.append(sum(k * v for k, v in n.items() if k != UNKNOWN) + n[UNKNOWN])
            return {"_id": cols["_id"], "n_words": words, "n_tokens": tokens, "n_unknown": unknown}

        return work

    picked = df.select(df[f"`{id_col}`"].alias("_id"), df[f"`{text_col}`"].alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()
    out = map_batches(picked, make, f"_id {kind}, n_words long, n_tokens long, n_unknown long")
    return out.withColumnRenamed("_id", id_col)


def op2_token_counts(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Greedy word-piece counts of every document."""
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", path)
