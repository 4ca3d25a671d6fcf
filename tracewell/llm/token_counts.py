"""Word-piece counts by a linear longest-match automaton, without building the pieces.

The vocabulary's pieces form two tries, of word beginnings and of continuations. Greedy longest match takes the
longest piece, pops it and goes on with the rest; each trie node holds in advance where matching goes on when no child
fits (its failure link) and how many pieces have been popped by then, so a word is one walk over its
characters. A word that can't be spelt counts one unknown piece. Words are taken between blanks; each distinct word is
walked once per process.

Defined cases: a null or empty text has no pieces; repeated rows give repeated results; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 300_000
_WORD = "▁"


class LongestMatch:
    """Automaton over pieces; those that begin a word start with `mark`, the others go on inside one."""

    def __init__(self, pieces: Iterable[str], mark: str = _WORD):
        self.children: list[dict[str, int]] = [{}, {}]  # node 0: word begins, node 1: word goes on
        self.end: list[bool] = [False, False]
        for p in pieces:
            node, text = (0, p[len(mark) :]) if p.startswith(mark) else (1, p)
            for c in text:
                node = self._child(node, c)
            self.end[node] = self.end[node] or bool(text)
        self.fail, self.popped = [-1] * len(self.end), [0] * len(self.end)
        level = [(n, c, 0) for c, n in self.children[0].items()] + [(n, c, 1) for c, n in self.children[1].items()]
        while level:  # nodes by depth: a failure link leads to a shallower node of the continuations
            for node, c, parent in level:
                if self.end[node]:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                z, k = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.children[z]:
                    z, k = self.fail[z], k + self.popped[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.children[z][c], k
            level = [(n, c, node) for node, _, _ in level for c, n in self.children[node].items()]

    def _child(self, node: int, c: str) -> int:
        if c not in self.children[node]:
            self.children[node][c] = len(self.end)
            self.children.append({})
            self.end.append(False)
        return self.children[node][c]

    def count(self, word: str) -> int:
        """Pieces of one word; 1 if it can't be spelt."""
        node, pieces = 0, 0
        for c in word:
            while c not in self.children[node]:
                pieces, node = pieces + self.popped[node], self.fail[node]
                if node < 0:
                    return 1
            node = self.children[node][c]
        while node != 1:  # pop what is left
            pieces, node = pieces + self.popped[node], self.fail[node]
            if node < 0:
                return 1
        return pieces


@lru_cache(maxsize=2)
def automaton(model: str) -> LongestMatch:
    """The automaton of a SentencePiece vocabulary's ordinary pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    return LongestMatch(sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))


class _Counts(dict):
    def __init__(self, machine: LongestMatch):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count(word)
        if len(self) < CACHE_WORDS:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counts(model: str) -> _Counts:
    return _Counts(automaton(model))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _counts(model).__getitem__
        for batch in batches:
            words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                own = (text.as_py() or "").split()
                words[i], tokens[i] = len(own), sum(map(get, own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
