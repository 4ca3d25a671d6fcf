"""Encoding of whole texts through a per-process cache of units.

A unit is a stretch of text whose ids don't depend on what stands around it, so a text's ids are its
units' ids in a row. Known units are looked up and gathered by numpy; unknown ones go to the tokenizer,
a batch at a time. The cache holds CACHE_UNITS units at most; rarer ones are encoded anew.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_UNITS = 500_000
#: The limit where units that aren't in the cache cost little: a cache of units, and one of their words.
CACHE_WORDS = 200_000
SLICE_CHARS = 1_000_000

#: What WORDS takes apart as the pre-tokenizer PLAIN does after its normaliser, of lower-cased units with a blank between them: runs of
#: letters up to U+00FF, digits, runs of ASCII punctuation. Any other character, an apostrophe for one, is a word that goes to the library.
WORDS = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[!-&(-/:-@\\[-`{-~]+|.", re.DOTALL)
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_TOKENIZER = [
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PLAIN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
]


class _Codes(dict):
    """unit -> code; an unknown unit gets the next code and is noted in `pending`."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, unit: str) -> int:
        code = len(self)
        self[unit] = code
        self.pending.append(unit)
        return code


class UnitEncoder:
    """Encodes texts by units.

    split(text): the units, or None where the text has to go to `whole` at once.
    encode(units): one list of ids for each unit. bound(unit): True if the unit's ids depend on its
    neighbours after all; a text that has such a unit goes to `whole`. distinct(texts): in place of split, units of all
    texts, the place of each of the texts' units among them, and how many units each text has. limit: in place of CACHE_UNITS.
    """

    def __init__(self, split: Callable, encode: Callable, whole: Callable, bound: Callable[[str], bool], distinct: Callable | None = None, limit: int | None = None):
        self.split, self.encode, self.whole, self.bound, self.distinct, self.limit = split, encode, whole, bound, distinct, limit
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)  # -1: bound
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _learn(self) -> None:
        new, self.codes.pending = self.codes.pending, []
        if not new:
            return
        n = len(self.codes)
        while n > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        bound = np.fromiter(map(self.bound, new), bool, len(new))
        ids, sizes = self.encode(new)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = slice(n - len(new), n)
        self.begin[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = np.where(bound, -1, sizes)
        self.used += len(ids)

    def _forget(self, kept: int, used: int) -> None:
        """Take the units beyond the cache's limit out again."""
        limit = CACHE_UNITS if self.limit is None else self.limit
        while len(self.codes) > max(kept, limit):
            self.codes.popitem()
        self.used = used if kept >= limit else int(self.begin[len(self.codes) - 1] + max(0, self.size[len(self.codes) - 1]))

    def _slice(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        known, used = len(self.codes), self.used
        if self.distinct:
            units, place, counts = self.distinct(texts)
            codes = np.fromiter(map(self.codes.__getitem__, units), np.int64, len(units))[place]
            tied = np.zeros(len(texts), bool)
        else:
            parts = [self.split(t) for t in texts]
            counts = np.fromiter((0 if p is None else len(p) for p in parts), np.int64, len(parts))
            units = chain.from_iterable(p for p in parts if p is not None)
            codes = np.fromiter(map(self.codes.__getitem__, units), np.int64, int(counts.sum()))
            tied = np.fromiter((p is None for p in parts), bool, len(parts))
        self._learn()
        size, begin = self.size[codes], self.begin[codes]
        edge = np.concatenate([[0], np.cumsum(counts)])
        at_bound = np.flatnonzero(size < 0)
        tied[np.searchsorted(edge, at_bound, "right") - 1] = True
        size = np.maximum(size, 0)
        if tied.any():
            size[np.repeat(tied, counts)] = 0
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        lengths = total[edge[1:]] - total[edge[:-1]]
        if tied.any():
            where = np.flatnonzero(tied)
            whole = self.whole([texts[i] for i in where])
            pieces, at = np.split(flat, np.cumsum(lengths)[:-1]), dict(zip(where.tolist(), whole, strict=True))
            pieces = [np.asarray(at.get(i, x), np.int32) for i, x in enumerate(pieces)]
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = np.concatenate(pieces) if pieces else flat
        if len(self.codes) > (CACHE_UNITS if self.limit is None else self.limit):
            self._forget(known, used)
        return flat, lengths

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row as int32, number of ids of each text); null counts as empty."""
        flats, lengths, i = [], [], 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars < SLICE_CHARS):
                chars += len(texts[j] or "")
                j += 1
            f, n = self._slice([t or "" for t in texts[i:j]])
            flats.append(f)
            lengths.append(n)
            i = j
        if not flats:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(flats), np.concatenate(lengths)


def _by_blank(text: str) -> list[str] | None:
    """Units that begin at each space and each line end."""
    if "\0" in text:
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def _between_blanks(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units between spaces and line ends, which are in none of them: a word is one unit wherever it stands."""
    units = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
    counts, coded = pc.list_value_length(units).to_numpy().astype(np.int64), units.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(), counts


def _words(units: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """WORDS of units without blanks."""
    found = WORDS.findall(" ".join(units).lower())
    blank = np.fromiter((w == " " for w in found), bool, len(found))
    counts = np.diff(np.concatenate([[-1], np.flatnonzero(blank), [len(found)]])) - 1
    return found, np.flatnonzero(~blank), counts


def _next_to_space(unit: str) -> bool:
    """White space right after the unit's first character, or at its end: a run of white space goes on in a neighbour."""
    return unit[1:2].isspace() or unit[-1:].isspace()


@lru_cache(maxsize=4)
def library_encoder(path: str, blanks_count: bool) -> UnitEncoder:
    """Encoder of a `tokenizers` file without special tokens added.

    blanks_count: white space makes ids (byte-level); False: the tokenizer drops it, so that
    every unit stands alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = whole(units)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter((x for i in ids for x in i), np.int32, int(sizes.sum())), sizes

    if blanks_count:
        return UnitEncoder(_by_blank, encode, whole, _next_to_space)
    by_words = _by_words(tokenizer, whole)
    return UnitEncoder(None, by_words or encode, whole, lambda unit: False, _between_blanks, CACHE_WORDS if by_words else None)


def _by_words(tokenizer, whole: Callable) -> Callable | None:
    """encode() that takes units apart into words and asks the library's model for unknown ones; None for another kind of tokenizer."""
    state = [part and json.loads(part.__getstate__()) for part in (tokenizer.pre_tokenizer, tokenizer.normalizer)]
    if state != PLAIN_TOKENIZER:
        return None
    spelt = {c: "".join(x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    model = tokenizer.model

    def ids_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[] if odd(w) else [t.id for t in model.tokenize(w if w.isascii() else w.translate(spelt))] for w in words]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

    def odd(word: str) -> bool:
        return len(word) == 1 and (not "!" <= word <= "\u00FF" or word in "'\u00D7\u00F7" or "\x7f" <= word < "\u00DF")

    words = UnitEncoder(None, ids_of, whole, odd, _words, CACHE_WORDS)

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = " ".join(units)
        if not any(token in joined for token in added):
            flat, sizes = words(units)
            return flat, sizes.astype(np.int32)
        ids = [whole([u])[0] if any(token in u for token in added) else words([u])[0].tolist() for u in units]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

    return encode


def trim() -> None:
    """Give memory that this process no longer uses back to the machine, what earlier stages have left in a worker included."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Forget this process's encoders, if it has any: a worker that goes on with something else needs their memory more."""
    if library_encoder.cache_info().currsize:
        library_encoder.cache_clear()
        trim()


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work on a task's batches, after which its worker gives memory back: it waits for the next task, perhaps of another step, meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run
