"""SentencePiece BPE encoding by vectorised merge rounds, and decoding by gathering piece bytes.

Texts fall apart into words (a run of space marks and what follows it), which no piece of the vocabulary
crosses. Words not seen before are encoded together: all their symbols lie in one flat numpy array; in each
round the minimum pair rank of each word is found by a segmented minimum, its pairs of that rank are merged from the
left, in all words at once, and the arrays are compacted, until no pair is left. A word's merges of a round
end with the first that brings about a pair of lower rank, which the library's priority queue would take next, so
the ids are the library's. A round costs as much as the symbols left; words of over LONG_WORD characters, where rounds
are many, go through a heap of pairs, in n log n steps.

Defined cases: a null or empty text has no ids and decodes to the empty text; any code point works, by byte
pieces where the vocabulary lacks it; repeated rows give repeated results; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import vocabulary
from tracewell.llm.encoders import UnitEncoder
from tracewell.llm.token_output import id_lists

MARK = "▁"
_NONE = np.iinfo(np.int64).max
#: Characters of a word from which on its merges come from a heap.
LONG_WORD = 2000


class MergeTable:
    """Pairs of symbols that the vocabulary can merge, with rank and result, from the pieces alone."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int]):
        self.ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        self.byte_ids = np.array(byte_ids, np.int32)
        self.n = len(pieces)
        symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols))
        order = sorted(self.ids.values(), key=lambda i: -scores[i])
        rank = {i: r for r, i in enumerate(order)}
        keys, ranks, merged = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank[i])
                    merged.append(i)
        by_key = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[by_key], _NONE)
        self.ranks = np.append(np.array(ranks, np.int64)[by_key], _NONE)
        self.merged = np.append(np.array(merged, np.int64)[by_key], -1)
        self.chars = {s: i for s, i in symbols.items() if len(s) == 1}
        self.pairs: dict[int, tuple[int, int]] | None = None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place in the table) of pairs of symbols; _NONE where they don't merge."""
        pair = np.where((left >= 0) & (right >= 0), left << 32 | right, _NONE)
        found = np.searchsorted(self.keys, pair)
        return np.where(self.keys[found] == pair, self.ranks[found], _NONE), found

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        # a character outside the vocabulary is its own negative code point and never merges
        table = np.array([self.chars.get(chr(c), -int(c) - 1) for c in kinds.tolist()], np.int64)
        symbol = table[inverse] if len(points) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        done_word, done_at, done_symbol = [], [], []
        place = np.arange(len(symbol))
        for i in np.flatnonzero(lengths > LONG_WORD):
            at = np.flatnonzero(word == i)
            left, kept = self._by_heap(symbol[at])
            done_word.append(np.full(len(kept), i))
            done_at.append(place[at[kept]])
            done_symbol.append(left)
        short = lengths[word] <= LONG_WORD
        symbol, word, place = symbol[short], word[short], place[short]
        while len(symbol):
            same = word[1:] == word[:-1]
            rank, found = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)
            rank[:-1], found[:-1] = self._ranks(np.where(same, symbol[:-1], -1), symbol[1:])
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbol)))
            alive = np.repeat(least < _NONE, size)
            if not alive.all():
                rest = ~alive
                done_word.append(word[rest])
                done_at.append(place[rest])
                done_symbol.append(symbol[rest])
            at = np.flatnonzero((rank == np.repeat(least, size)) & alive)
            if not len(at):
                break
            at = self._together(at, symbol, word, rank, found)
            symbol[at] = self.merged[found[at]]
            alive[at + 1] = False
            symbol, word, place = symbol[alive], word[alive], place[alive]
        symbol, place, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbol, done_at, done_word))
        order = np.argsort(place, kind="stable")
        symbol, word = symbol[order], word[order]
        return self._spell(symbol, word, len(words))

    def _together(self, at: np.ndarray, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Those of the places at, all of their word's least rank, that can be merged in one round."""
        chain = np.concatenate([[True], at[1:] != at[:-1] + 1])  # of pairs that overlap, every second one
        start = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        new, n = self.merged[found[at]], len(symbol)
        after = np.minimum(at + 2, n - 1)
        right = np.where((at + 2 < n) & (word[after] == word[at]), symbol[after], -1)
        before = np.maximum(at - 1, 0)
        left = np.where((at > 0) & (word[before] == word[at]), symbol[before], -1)
        next_to = np.concatenate([[False], at[1:] == at[:-1] + 2]) & (left >= 0)
        left = np.where(next_to, new, left)  # the neighbour has just been merged to the same piece
        better = np.minimum(self._ranks(left, new)[0], self._ranks(new, right)[0]) < rank[at]
        ahead = np.cumsum(better) - better
        begin = np.concatenate([[True], word[at][1:] != word[at][:-1]])
        return at[ahead == ahead[begin][np.cumsum(begin) - 1]]

    def _by_heap(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols left, their places) of one word."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        get, n = self.pairs.get, len(symbol)
        rank = self._ranks(symbol[:-1], symbol[1:])[0]
        at = np.flatnonzero(rank < _NONE)
        heap = (rank[at] << 32 | at).tolist()
        heapq.heapify(heap)
        symbols, after, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        gone = bytearray(n)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if gone[i] or j >= n:
                continue
            pair = get(symbols[i] << 32 | symbols[j]) if symbols[i] >= 0 and symbols[j] >= 0 else None
            if pair is None or pair[0] != top >> 32:
                continue  # one of the two has been merged since
            symbols[i], gone[j] = pair[1], 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if symbols[k] >= 0 and (pair := get(symbols[i] << 32 | symbols[k])):
                    heapq.heappush(heap, pair[0] << 32 | i)
            h = before[i]
            if h >= 0 and symbols[h] >= 0 and (pair := get(symbols[h] << 32 | symbols[i])):
                heapq.heappush(heap, pair[0] << 32 | h)
        kept = np.flatnonzero(np.frombuffer(gone, np.uint8) == 0)
        return np.array(symbols, np.int64)[kept], kept

    def _spell(self, symbol: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of characters that have no piece."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.n))
        if len(odd):
            back = {i: s for s, i in self.chars.items()}
            spelt = [back[int(s)] if s >= 0 else chr(-int(s) - 1) for s in symbol[odd]]
            spelt = [self.byte_ids[list(c.encode("utf-8", "replace"))] for c in spelt]
            sizes = np.ones(len(symbol), np.int64)
            sizes[odd] = [len(x) for x in spelt]
            out = np.repeat(symbol, sizes)
            begin = np.cumsum(sizes) - sizes
            for i, x in zip(odd, spelt, strict=True):
                out[begin[i] : begin[i] + len(x)] = x
            symbol, word = out, np.repeat(word, sizes)
        return symbol.astype(np.int32), np.bincount(word, minlength=n).astype(np.int32)


class PieceCodec:
    """Encoder and decoder of one SentencePiece BPE model with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        normal = [not (byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        plain = [p for p, ok in zip(pieces, normal, strict=True) if ok]
        if any(re.search(f"[^{MARK}]{MARK}|\n|\0", p) for p in plain) or sp.normalize(" A ﬁ  b ") != MARK + " A ﬁ  b ".replace(" ", MARK):
            raise ValueError("only models with identity normalisation and without pieces across words are supported")
        self.table = MergeTable(pieces, scores, normal, [i for i in range(n) if byte[i]])
        self.encode = UnitEncoder(self._words, self.table.encode, lambda texts: [], lambda unit: False)
        surfaces = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.width = np.array([len(s) for s in surfaces], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(surfaces), np.uint8)

    @staticmethod
    def _words(text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if "\0" not in text:
            units = marked.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0")
            if MARK not in units:
                return units
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)

    def decode(self, flat: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of lists of ids."""
        width = self.width[flat]
        total = np.concatenate([[0], np.cumsum(width)])
        data = self.bytes[np.repeat(self.begin[flat] - total[:-1], width) + np.arange(total[-1])].tobytes()
        edge = np.concatenate([[0], np.cumsum(lengths)])
        out = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            try:
                text = data[total[i] : total[j]].decode()
            except UnicodeDecodeError:  # bytes that are no UTF-8: the library says what to put there
                out.append(self.library.decode(flat[i:j].tolist()))
                continue
            out.append(text[1:] if text.startswith(" ") else text)
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _encode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids)."""
    c = codec(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = batch.slice(at, 1000)
            flat, lengths = c.encode(rows.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), id_lists(flat, lengths)], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) to (doc_id, ids, text)."""
    c = codec(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = batch.slice(at, 1000)
            ids = rows.column("ids")
            flat, lengths = ids.flatten().to_numpy(zero_copy_only=False), np.diff(ids.offsets.to_numpy())
            text = pa.array(c.decode(flat, lengths), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), ids, text], ["doc_id", "ids", "text"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    spelt = np.zeros(0, object)  # decimal spellings, grown as ids turn up
    for batch in batches:
        ids = batch.column("ids")
        flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        if len(flat) and int(flat.max()) >= len(spelt):
            spelt = np.array([str(i).encode() for i in range(int(flat.max()) + 1)], object)
        shas = [hashlib.sha256(b",".join(spelt[flat[i:j]].tolist())).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
        texts = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of each whole text."""
    return _rows(docs, id_col, text_col).mapInArrow(lambda b: _encode(b, model), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text decoded from them."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decode(b, model), "doc_id long, ids array<int>, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def codec_digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of what `decode_pieces` returns."""
    return decoded.select("doc_id", "ids", "text").mapInArrow(_digest, DIGEST)


def round_trip_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of each text encoded and decoded.

    The steps of `encode_pieces` and `decode_pieces` run in one Python worker a task: ids and texts pass between
    them without going through the JVM, and one worker a core holds a vocabulary and a cache.
    """
    steps = lambda b: _digest(_decode(_encode(b, model), model))
    return _rows(docs, id_col, text_col).mapInArrow(steps, DIGEST)


def default_model() -> str:
    return vocabulary("piece_bpe_32k.model")
