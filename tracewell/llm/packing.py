"""Best-fit-decreasing packing of whole documents into sequences of a fixed length.

A document longer than the window is first cut into full windows; what is left is one tail. Tails are
packed by best-fit decreasing over the whole corpus: longest first, each into the open window with the
least room that still holds it, found in a segment tree indexed by remaining capacity. Tails of equal
length are interchangeable, so the plan is made from the number of tails of each length (at most
`window` numbers, whatever the corpus size) and says which ranks of a length go to which windows; the
rows are then placed in parallel, without moving any ids.

Defined cases: a null or empty text is the end id alone; repeated doc_ids and rows are packed once each;
null doc_ids are kept; an empty table gives no pieces; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, materialise, vocabulary
from tracewell.llm.encoders import library_encoder, release, trim, trimmed
from tracewell.llm.token_output import crc_of_lists, id_lists, with_end

ENCODED = "doc_id long, ids array<int>, n_tokens long, part int, tail int, tail_rank long, full_rank long"
DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"
#: Rows of the table of rank offsets that may be broadcast; beyond that it is joined by a shuffle.
BROADCAST_ROWS = 3_000_000


class CapacityTree:
    """Segment tree over capacities 0..window: counts open windows and finds the least capacity that fits."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += count
            i //= 2

    def count(self, capacity: int) -> int:
        return self.tree[capacity + self.leaves]

    def tightest(self, length: int) -> int | None:
        """The least capacity >= length that some open window has."""
        i = length + self.leaves
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], window: int) -> np.ndarray:
    """Best-fit decreasing over counts[length] pieces.

    Rows (length, first rank, end rank, first window, offset, per window): rank r of the length goes to
    window first + (r - first rank) // per, at offset + (r - first rank) % per * length.
    """
    tree, open_windows, out, windows = CapacityTree(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = window, window // length
                taken = max(1, left // per)
                first, windows = windows, windows + taken
            else:
                per = room // length
                first, there = open_windows[room][-1]
                taken = min(there, max(1, left // per))
                if taken == there:
                    open_windows[room].pop()
                else:
                    open_windows[room][-1] = (first + taken, there - taken)
                tree.add(room, -taken)
            per = min(per, left)
            out.append((length, rank, rank + taken * per, first, window - room, per))
            rank, left, room = rank + taken * per, left - taken * per, room - per * length
            if room:
                open_windows.setdefault(room, []).append((first, taken))
                tree.add(room, taken)
    return np.array(out, np.int64).reshape(-1, 6)


def encode_for_packing(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Encode texts where they lie; each row notes its rank among its partition's tails of the same length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trim()
        part, fulls = TaskContext.get().partitionId(), 0
        seen = np.zeros(window, np.int64)
        encoder = library_encoder(tokenizer, False)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                flat, lengths = with_end(*encoder(rows.column("text").to_pylist()), end_id)
                tail = lengths % window
                order = np.argsort(tail, kind="stable")
                run = np.arange(len(tail)) - np.searchsorted(tail[order], tail[order], "left")
                rank = np.empty(len(tail), np.int64)
                rank[order] = run
                rank += seen[tail]
                seen += np.bincount(tail, minlength=window)
                full = lengths // window
                full_rank = fulls + np.cumsum(full) - full
                fulls += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), id_lists(flat, lengths), pa.array(lengths, pa.int64()), pa.array(np.full(len(tail), part, np.int32)), pa.array(tail.astype(np.int32)), pa.array(rank), pa.array(full_rank)],
                    ["doc_id", "ids", "n_tokens", "part", "tail", "tail_rank", "full_rank"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, ENCODED)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """Pieces of all documents with their ids and place; see PIECES for the columns.

    Texts are encoded once and written; counts come from two narrow columns of that table. digest: what `piece_digest`
    makes of the pieces, in the Python worker that cuts them.
    """
    encoded = materialise(encode_for_packing(docs, tokenizer, end_id, window, id_col, text_col), "packing")
    # the number of pieces of each length in each partition; length `window` stands for full windows
    tails = encoded.where("tail > 0").groupBy("part", "tail").agg(F.count("*").alias("n"))
    fulls = encoded.groupBy("part").agg(F.sum(F.expr(f"n_tokens div {window}")).alias("n")).where("n > 0")
    counts = materialise(tails.unionByName(fulls.select("part", F.lit(window).alias("tail"), "n")), "packing-counts")
    by_length = counts.groupBy("tail").agg(F.sum("n").alias("n")).collect()  # `window` rows at most
    steps = plan({r["tail"]: r["n"] for r in by_length}, window)
    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = materialise(counts.select("part", "tail", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "packing-ranks")
    tail_first = broadcast_if_small(first.where(F.col("tail") < window).withColumnRenamed("first", "tail_first"), BROADCAST_ROWS)
    full_first = broadcast_if_small(first.where(F.col("tail") == window).select("part", F.col("first").alias("full_first")), BROADCAST_ROWS)
    placed = (
        encoded.join(tail_first, ["part", "tail"], "left")
        .join(full_first, "part", "left")
        .select("doc_id", "ids", "n_tokens", (F.coalesce("tail_first", F.lit(0)) + F.col("tail_rank")).alias("tail_rank"), (F.coalesce("full_first", F.lit(0)) + F.col("full_rank")).alias("full_rank"))
    )
    # one row per planning step: the steps are bounded by the pairs of length and capacity, not by the corpus
    keys = steps[:, 0] * (1 << 44) + steps[:, 1]
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], steps[order]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # all texts are encoded by now
        keys, steps = shared.value
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            n = batch.column("n_tokens").to_numpy()
            lists = batch.column("ids")
            begin = lists.offsets.to_numpy().astype(np.int64)
            pieces = -(-n // window)
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * window
            length = np.minimum(window, n[row] - start)
            rank = np.where(length == window, batch.column("full_rank").to_numpy()[row] + nth, batch.column("tail_rank").to_numpy()[row])
            step = steps[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1] if len(row) else steps[:0]
            within = rank - step[:, 1]
            sequence, offset = step[:, 3] + within // step[:, 5], step[:, 4] + within % step[:, 5] * length
            flat = lists.values.slice(begin[0], begin[-1] - begin[0]) if len(n) else lists.values
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), ids, pa.array(n[row]), pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(trimmed(lambda b: _digest(cut(b))), DIGEST) if digest else placed.mapInArrow(trimmed(cut), PIECES)


def padded_length(length: int, window: int = 2048) -> int:
    """Length of a sequence once padded: a power of two stays as it is, any other becomes `window`."""
    return length if length > 0 and length & (length - 1) == 0 else window


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        crc = pa.array(crc_of_lists(batch.column("ids")), pa.int64())
        yield pa.RecordBatch.from_arrays([crc if c == "ids_crc32" else batch.column(c) for c in names], names)


def piece_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32 in place of the ids."""
    return pieces.mapInArrow(_digest, DIGEST)


def default_tokenizer() -> str:
    return vocabulary("word_bpe_49k.json")
