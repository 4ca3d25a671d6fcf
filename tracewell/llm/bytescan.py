"""Numpy scans over the UTF-8 bytes of whole Arrow batches of texts: words, hashes and groups without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are looked at together where numbers of eight bytes each are made of them; longer runs are hashed in pieces.
_BLOCK = 1 << 18
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    while len(_powers) < n:
        step = _powers[-1:] * _BASE
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


def text_buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words (runs of bytes outside space and 0x09-0x0D) of a run of texts.

    start, end: byte positions; doc: index of the text; per_doc: number of words of each text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SEPARATOR[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[cuts - 1] = inside[cuts - 1]
        self.inside = inside
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=len(offsets) - 1)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return run_hashes(_LOWER[self.data] if lower else self.data, self.start, self.end)


def counts_before(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of mask are set before each of the places at, which stand in order."""
    out, total = np.empty(len(at), np.int64), 0
    edge = np.searchsorted(at, np.arange(0, len(mask) + _BLOCK, _BLOCK))
    for k in range(len(edge) - 1):
        block, own = mask[k * _BLOCK : (k + 1) * _BLOCK], at[edge[k] : edge[k + 1]] - k * _BLOCK
        out[edge[k] : edge[k + 1]] = total + np.concatenate([[0], np.cumsum(block, dtype=np.int32)])[own]
        total += int(np.count_nonzero(block))
    out[edge[-1] :] = total
    return out


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs (start, end), which don't overlap and stand in order; an empty run has hash 0's."""
    length = end - start
    out = np.zeros(len(start), np.uint64)
    full = np.flatnonzero((length > 0) & (length <= _BLOCK))
    covered = np.cumsum(length[full])
    for own in np.split(full, np.searchsorted(covered, np.arange(_BLOCK, covered[-1], _BLOCK))) if len(full) else ():
        if len(own):
            out[own] = _sums(data, start[own], length[own])
    for i in np.flatnonzero(length > _BLOCK):
        cut = np.append(np.arange(start[i], end[i], _BLOCK), end[i])
        parts = np.array([_sums(data, cut[k : k + 1], cut[k + 1 : k + 2] - cut[k])[0] for k in range(len(cut) - 1)], np.uint64)
        out[i] = (mix(parts) * powers(len(parts))).sum()
    return mix(out ^ (length.astype(np.uint64) << np.uint64(40)))


def _sums(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The polynomial of each byte run in the hash base."""
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    terms = (data[within + np.repeat(start, length)].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[within]
    return np.add.reduceat(terms, first)


def windows(hashes: np.ndarray, per_doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window of `width` words inside one text."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = total * _BASE + hashes[k : n - width + 1 + k]
    last = np.repeat(np.cumsum(per_doc), per_doc)
    at = np.arange(n - width + 1)
    ok = at + width <= last[: n - width + 1]
    return at[ok], mix(total[ok])
