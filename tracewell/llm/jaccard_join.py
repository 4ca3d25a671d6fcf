"""Exact n-gram Jaccard self-join by PartEnum signatures, and the connected classes of its links.

Sets are the distinct word shingles of a text as 64-bit hashes. Documents with equal sets (by a 96-bit identity)
collapse to one node. Band b holds set sizes over 2**(b - 1) up to 2**b; a set takes part in the instance of its own
band and, if a partner may lie there, in that of the next. An instance bounds the symmetric difference of its
pairs by h = 2 * 2**b / 7 and cuts the feature domain into cells, more than h of them. In small bands (one
first-level group) all two-cell subsets are enumerated; in larger ones (first-level groups of two cells each) all
one-cell subsets of each group. Cells that no difference touches are the same in both sets, so linked sets
share a signature for each such cell or pair of cells that isn't empty. How many they share at least is known for each
set (its `spare`); a set with no spare is dealt to cells again under another seed, so that no link hangs on luck.
Signatures travel packed, six bytes and a share of their set's identity each, to parts of one instance.

What meets is a bucket of nodes, a packed row; equal buckets are counted, combined before they are shuffled. Parts also sum
up how often each node meets others. A node that meets others less often than it has to spare has no partner at all and
leaves. Buckets never give all their pairs: each node is compared with the bucket's pivot, the node that
meets most others and so the likeliest centre of near copies, and links are closed to classes. Only buckets that
still hold several classes go on. Up to BUCKET nodes, they pair nodes of different classes. Larger ones of one pivot
make a family; its nodes outside the largest class are a query set held against all of it in blocks of bounded size,
and only links leave a block. Every pair is checked by its true intersection before it counts.

Memory: a text is scanned as a whole, at some 70 bytes a word; a task holds FLUSH signatures and a meeting about PART.
Two-cell subsets in all bands were tried and left more rows and twice as many nodes after the first count, as each
difference spoils more of them; where sets are small, they keep short texts with one common line apart.

Defined cases: a null text and one without words have an empty set and link with nothing; under five words the
whole sequence is the one shingle; repeated rows and equal texts are one class; of a repeated doc_id with different texts
each row has its own text's class; a null doc_id is never the least; an empty table gives no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bytescan import Words, mix, slices, text_buffers, windows
from tracewell.llm.common import Scratch, broadcast_if_small, components
from tracewell.llm.encoders import release, trimmed

WIDTH = 5
#: Similarity as a fraction of integers: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Nodes of a bucket whose pairs across classes are joined.
BUCKET = 64
SEEDS = 6
#: Greatest set size of the bands that enumerate two-cell subsets.
PAIRS_TOP = 32
#: Bytes of a set's identity.
ID = 12
PART, FLUSH = 1_000_000, 500_000
BROADCAST_ROWS = 2_000_000
#: Parts that a large bucket's rows are gathered in.
SHARES = 32
#: Hashes in a block of a family.
BLOCK = 65_536


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes sorted within each text, text index of each, set size of each text)."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    hashes = w.hashes(lower=True)
    first, key = windows(hashes, w.per_doc, width)
    doc = w.doc[first]
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < width))
    if len(short):
        begin = np.cumsum(w.per_doc) - w.per_doc
        whole = []
        for d in short:
            total = np.uint64(w.per_doc[d])
            for h in hashes[begin[d] : begin[d] + w.per_doc[d]]:
                total = mix(np.array([total ^ h]))[0]
            whole.append(total)
        key, doc = np.concatenate([key, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[new], doc[new]
    return key, doc, np.bincount(doc, minlength=n)


def set_ids(key: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 96-bit identity of each set as three 32-bit numbers; zeros for the empty one."""
    out = np.zeros((len(sizes), 3), np.uint32)
    full = sizes > 0
    if full.any():
        first, n = (np.cumsum(sizes) - sizes)[full], sizes[full].astype(np.uint64)
        a, b = np.add.reduceat(mix(key + np.uint64(1)), first), np.add.reduceat(mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
        a, b = mix(a) ^ mix(b + n), mix(b ^ n)
        out[full] = np.stack([a >> np.uint64(32), a & np.uint64(0xFFFFFFFF), b & np.uint64(0xFFFFFFFF)], 1)
    return out


def id_array(ids: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """Binary column of identities; null for empty sets."""
    return pa.array([i.tobytes() if sizes is None or n else None for i, n in zip(ids, ids if sizes is None else sizes, strict=True)], pa.binary())


def own_band(sizes: np.ndarray) -> np.ndarray:
    """The least b with size <= 2**b."""
    return np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greatest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def cells(top: np.ndarray) -> np.ndarray:
    """Cells of the instance with this greatest size: more than the differences, and some for those that stay empty."""
    groups = (difference(top, top) + 2) // 2 + np.ceil(0.03 * top).astype(np.int64) + 2
    return 2 * groups


def _two_of(row: np.ndarray, cell: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, sum) of all pairs of filled cells of a set; rows are in a row."""
    size = np.bincount(row)
    first = np.cumsum(size) - size
    later = (first + size)[row] - np.arange(len(row)) - 1
    a = np.repeat(np.arange(len(row)), later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    return row[a], cell[a] << np.uint64(16) | cell[b] | np.uint64(1 << 39), mix(sums[a] + np.uint64(3)) + sums[b]


def signatures(key: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, entry, band of each entry, spare of each entry) of sets whose hashes are sorted and in a row.

    Entry 2 * i is set i in the instance of its own band, 2 * i + 1 in that of the next. Sets of under three
    elements link with equal ones only and have no signature.
    """
    n = len(sizes)
    own = own_band(sizes)
    entry_band = np.stack([own, own + 1], 1).reshape(-1)
    spare = np.zeros(2 * n, np.int64)
    out_sig, out_entry = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    begin = np.cumsum(sizes) - sizes
    for step in (0, 1):
        active = np.flatnonzero((sizes >= 3) & ((step == 0) | (sizes * DENOMINATOR // NUMERATOR > 1 << own)))
        for seed in range(SEEDS if len(active) else 0):
            size, band = sizes[active], own[active] + step
            m = cells(1 << band)
            row = np.repeat(np.arange(len(active)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[active], size)
            value = key[at]
            if seed:  # another dealing of the domain; its order is made anew within each set
                value = mix(value + np.uint64(seed))
                value = value[np.lexsort((value, row))]
            cell = ((value >> np.uint64(32)) * m[row].astype(np.uint64)) >> np.uint64(32)
            new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])]))
            row, cell, sums = row[new], cell[new], np.add.reduceat(mix(value), new)
            filled = np.bincount(row, minlength=len(active))
            left = filled - difference(size, np.minimum(size * DENOMINATOR // NUMERATOR, 1 << band))
            by_two = ((1 << band) <= PAIRS_TOP) & (seed == 0)
            at_two = by_two[row]
            parts = [(row[~at_two], cell[~at_two], sums[~at_two])]
            if at_two.any():
                parts.append(_two_of(row[at_two], cell[at_two], sums[at_two]))
                left = np.where(by_two, np.maximum(left, 0) * (np.maximum(left, 0) - 1) // 2, left)
            if not seed:
                spare[2 * active + step] = left
            poor = left <= 0
            if seed == SEEDS - 1 and poor.any():  # both sets of a pair this far have an empty cell in common
                for i in np.flatnonzero(poor):
                    gone = np.setdiff1d(np.arange(m[i], dtype=np.uint64), cell[row == i])
                    parts.append((np.full(len(gone), i), gone | np.uint64(1 << 38), np.zeros(len(gone), np.uint64)))
            for r, c, s in parts:
                place = (band[r].astype(np.uint64) << np.uint64(46)) + (np.uint64(seed) << np.uint64(42)) + c
                out_sig.append(mix(s ^ mix(place)))
                out_entry.append(2 * active[r] + step)
            active = active[poor]
            if not len(active):
                break
    return np.concatenate(out_sig), np.concatenate(out_entry), entry_band, spare


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def document_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_id (null for an empty set), sketch of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in slices(offsets):
                key, doc, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                sketches = pa.array([sketch(key[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(sizes.astype(np.int64)), id_array(set_ids(key, doc, sizes), sizes), sketches]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "sketch"])

    return texts.mapInArrow(trimmed(scan), "doc_id long, n_shingles long, set_id binary, sketch binary")


def parts_of_bands(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(first part, number of parts) of each band's instance, so that a part holds about PART signatures; number of parts in use."""
    counts = nodes.where("n >= 3").groupBy(F.length(F.bin(F.col("n") - 1)).alias("b")).agg(F.count("*").alias("c"))
    count = np.zeros(64, np.int64)
    for r in counts.collect():  # a row for each power of two
        count[r.b] = r.c
    each = [cells(np.array([1 << b]))[0] * (6 if 1 << b <= PAIRS_TOP else 1) if b < 40 else 1 for b in range(64)]
    total = (count + np.roll(count, 1)) * np.array(each)
    parts = np.maximum(1, -(-total // PART))
    return np.cumsum(parts) - parts, parts, max(1, int(parts[total > 0].sum()))


def packed_signatures(texts: DataFrame, first_part: np.ndarray, n_parts: np.ndarray, width: int = WIDTH) -> DataFrame:
    """part, sigs (4 bytes each), refs (2 or 4 bytes each), sets, spares, sizes: signatures of distinct sets, many to a row."""
    names = ["part", "sigs", "refs", "sets", "spares", "sizes"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[np.ndarray, ...]] = []
        count, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            sig, entry, band, spare, ids, sizes = (list(x) for x in zip(*held, strict=True))
            before = np.cumsum([0, *(len(s) for s in spare)])
            entry = np.concatenate([e + b for e, b in zip(entry, before, strict=False)])
            sig, band, spare, ids, sizes = (np.concatenate(x) for x in (sig, band, spare, ids, sizes))
            held, count = [], 0
            b = band[entry]
            part = first_part[b] + ((sig >> np.uint64(32)) % n_parts[b].astype(np.uint64)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            for own in np.split(order, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(order) else ():
                used, local = np.unique(entry[own], return_inverse=True)
                local = local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                blobs = [sig[own].astype(np.uint32), local, ids[used >> 1], np.minimum(spare[used], 32767).astype(np.int16), sizes[used >> 1].astype(np.int64)]
                p = first_part[b[own[0]]] + int((sig[own[0]] >> np.uint64(32)) % np.uint64(n_parts[b[own[0]]]))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names)

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in slices(offsets):
                key, doc, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                ids = set_ids(key, doc, sizes)
                # a set is dealt once a task: copies would only repeat its signatures
                fresh = np.zeros(len(ids), bool)
                for d, s in enumerate(map(bytes, ids)):
                    if sizes[d] and s not in seen:
                        seen.add(s)
                        fresh[d] = True
                held.append((*signatures(key[fresh[doc]], sizes[fresh]), ids[fresh], sizes[fresh]))
                count += len(held[-1][0])
                if count >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return texts.mapInArrow(trimmed(scan), "part int, sigs binary, refs binary, sets binary, spares binary, sizes binary")


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each distinct identity, number of each identity among them)."""
    order = np.lexsort(ids.T)
    sorted_ids = ids[order]
    new = np.concatenate([[True], (sorted_ids[1:] != sorted_ids[:-1]).any(1)])
    number = np.empty(len(ids), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def meetings(packed: DataFrame, first_part: np.ndarray, parts: int) -> DataFrame:
    """Rows of three kinds: 0, nodes that meet in a signature, packed; 1, some nodes of a large bucket, packed;
    2, a node, how often it meets others in a part (times), with how many (weight), its spare and size."""
    names = ["kind", "bucket", "band", "members", "times", "weight", "spare", "n"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, nodes, size = -1, [], [], 0
        large = np.zeros(0, np.uint32)

        def rows(kind: int, bucket: np.ndarray, lengths: np.ndarray, ids: np.ndarray, times: np.ndarray, weight=0, spare=0, n=0) -> pa.RecordBatch:
            many = len(lengths)
            members = pa.Array.from_buffers(pa.large_binary(), many, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths * ID)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])
            full = lambda x, t: pa.array(np.broadcast_to(x, many).astype(t))
            columns = [full(kind, np.int32), pa.array(bucket.view(np.int64)), full(np.searchsorted(first_part, part, "right") - 1, np.int32), members.cast(pa.binary()), full(times, np.int64), full(weight, np.int64), full(spare, np.int32), full(n, np.int64)]
            return pa.RecordBatch.from_arrays(columns, names)

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Sort what is held; large buckets leave at once, single nodes and small buckets when the part ends."""
            nonlocal held, nodes, size, large
            if not held:
                return
            ids, spare, n = (np.concatenate(x) for x in zip(*nodes, strict=True))
            keep, number = _numbered(ids)
            ids, spare, n = ids[keep], spare[keep], n[keep]
            both = np.concatenate([sig.astype(np.uint64) << np.uint64(32) | number[ref].astype(np.uint64) for sig, ref in held])
            both.sort()
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
            sig, node = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            length = np.diff(np.append(first, len(sig)))
            hot = (length > BUCKET) | np.isin(sig[first], large)
            large = np.union1d(large, sig[first[hot]])
            meets, weight = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            if hot.any():
                at = np.repeat(hot, length)
                yield rows(1, mix(sig[first[hot]].astype(np.uint64) << np.uint64(32) | np.uint64(part)), length[hot], ids[node[at]], 1)
                meets += np.bincount(node[at], minlength=len(ids))
                weight += np.bincount(node[at], np.repeat(length[hot], length[hot]), len(ids)).astype(np.int64)
            if last:
                several = ~hot & (length > 1)
                at = np.repeat(several, length)
                if at.any():
                    m, sizes = node[at], length[several]
                    meets += np.bincount(m, minlength=len(ids))
                    weight += np.bincount(m, np.repeat(sizes, sizes), len(ids)).astype(np.int64)
                    yield rows(0, np.zeros(len(sizes), np.uint64), sizes, ids[m], 1)
            met = np.flatnonzero(meets)
            if len(met):
                yield rows(2, np.zeros(len(met), np.uint64), np.ones(len(met), np.int64), ids[met], meets[met], weight[met], spare[met], n[met])
            if last:
                held, nodes, size, large = [], [], 0, np.zeros(0, np.uint32)
            else:
                at = np.repeat(~hot, length)
                held, nodes, size = [(sig[at], node[at])], [(ids, spare, n)], int(at.sum())

        for batch in batches:
            for p, sigs, refs, sets, spares, sizes in zip(*(batch.column(c).to_pylist() for c in names_in), strict=True):
                if p != part:
                    yield from settle(True)
                    part = p
                sig = np.frombuffer(sigs, np.uint32)
                ref = np.frombuffer(refs, np.uint16 if len(refs) == 2 * len(sig) else np.uint32).astype(np.int64)
                held.append((sig, ref + sum(len(x[0]) for x in nodes)))
                nodes.append((np.frombuffer(sets, np.uint32).reshape(-1, 3), np.frombuffer(spares, np.int16), np.frombuffer(sizes, np.int64)))
                size += len(sig)
                if size > 2 * PART:
                    yield from settle(False)
        yield from settle(True)

    names_in = ["part", "sigs", "refs", "sets", "spares", "sizes"]
    dealt = packed.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(trimmed(meet), "kind int, bucket long, band int, members binary, times long, weight long, spare int, n long")


def sketch(key: np.ndarray) -> bytes:
    """How many of the set's hashes fall into each of 2**k equal ranges, two to four a range on average; 255 at most."""
    bits = max(5, len(key).bit_length() - 2)
    counts = np.bincount((key >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference: sum of differences of counts, over the coarser of both ranges."""
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(x) != len(y):
        if max(x.max(), y.max()) == 255:  # a full count can't be added up
            return 0
        n = min(len(x), len(y))
        x, y = x.reshape(n, -1).sum(1), y.reshape(n, -1).sum(1)
    return int(np.abs(x - y).sum())


def member_sets(texts: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """set_id, hashes (sorted, 8 bytes each) of the sets in nodes (doc_id, set_id)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in slices(offsets):
                key, doc, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                hashes = pa.array([key[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([id_array(set_ids(key, doc, sizes), sizes), hashes], ["set_id", "hashes"])

    ids = broadcast_if_small(nodes.select(F.col("doc_id").alias("wanted")).distinct(), BROADCAST_ROWS)
    scanned = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").mapInArrow(trimmed(scan), "set_id binary, hashes binary")
    # an id may stand for several texts: only the sets that were asked for go on
    return scanned.join(broadcast_if_small(nodes.select("set_id"), BROADCAST_ROWS), "set_id", "left_semi").dropDuplicates(["set_id"])


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, m, n) that their sketches allow to link; sketches are a twentieth of the hashes."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            most = difference(batch.column("m").to_numpy(), batch.column("n").to_numpy())
            keep = [sketch_distance(i, j) <= d for i, j, d in zip(x, y, most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("set_id").alias("a"), F.col("sketch").alias("x")), sets.select(F.col("set_id").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "m", "n", "x", "y").mapInArrow(trimmed(test), "a binary, b binary")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity reaches the bound; b's hashes go to a, once a pair."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[i].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column("y")[i].as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep[i] = DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    x, y = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(trimmed(test), "a binary, b binary")


def bitmap(key: np.ndarray) -> np.ndarray:
    """Parities of how many of the set's hashes fall into each of 2**k equal ranges, eight to sixteen ranges an element."""
    bits = max(8, (8 * len(key)).bit_length())
    return (np.bincount((key >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)


def near_pairs(xs: list[np.ndarray], ys: list[np.ndarray], lx: np.ndarray, ly: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of the linked pairs of sets with different labels: parities bound the difference from below, true intersections decide."""
    nx, ny = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    mx, my = [bitmap(x) for x in xs], [bitmap(y) for y in ys]
    wx, wy = np.array([len(m) for m in mx]), np.array([len(m) for m in my])
    for width in np.unique(wx):
        rows = np.flatnonzero(wx == width)
        for other in np.unique(wy):
            if max(width, other) > 2 * min(width, other):  # sizes too far apart to link
                continue
            cols, narrow = np.flatnonzero(wy == other), min(width, other)
            fold = lambda m: np.bitwise_xor.reduce(m.reshape(narrow, -1), 1)
            x, y = np.stack([fold(mx[i]) for i in rows]), np.stack([fold(my[j]) for j in cols])
            both = np.zeros((len(rows), len(cols)), np.float32)
            for k in range(0, narrow, 8192):
                both += x[:, k : k + 8192].astype(np.float32) @ y[:, k : k + 8192].astype(np.float32).T
            apart = x.sum(1, dtype=np.int64)[:, None] + y.sum(1, dtype=np.int64)[None] - 2 * both.astype(np.int64)
            near = (apart <= difference(nx[rows][:, None], ny[cols][None])) & (lx[rows][:, None] != ly[cols][None])
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = xs[rows[i]], ys[cols[j]]
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                common = int((a[at] == b).sum())
                if DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common):
                    yield int(rows[i]), int(cols[j])


def family_links(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The links (a, b) between nodes of different classes of a family; members: family, member, label, n.

    The nodes outside a family's largest class are the query set, and are held against all its nodes in blocks
    of some BLOCK hashes; no pair is a row but those that link.
    """
    sizes = scratch(members.groupBy("family", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n")), "family-classes")
    info = sizes.groupBy("family").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("n").alias("n"))
    info = scratch(info.select("family", F.col("top.label").alias("top"), F.ceil(F.col("n") / BLOCK).alias("blocks")), "families")
    rows = members.join(info, "family").withColumn("asks", F.col("label") != F.col("top"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("member"), "blocks")).join(sets, F.col("member") == F.col("set_id"))
    columns = [F.struct("member", "label", "hashes").alias("x")]
    packed = rows.select("family", "asks", "block", *columns).groupBy("family", "asks", "block").agg(F.collect_list("x").alias("held"))
    packed = scratch(packed, "family-blocks")
    names = packed.select("family", "asks", "block")
    asking = names.where("asks").select("family", F.col("block").alias("bx"))
    against = names.select("family", F.col("asks").alias("ay"), F.col("block").alias("by"))
    meetings = asking.join(against, "family").where("not ay or bx <= by")
    x = packed.where("asks").select("family", F.col("block").alias("bx"), F.col("held").alias("x"))
    y = packed.select("family", F.col("asks").alias("ay"), F.col("block").alias("by"), F.col("held").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for name in ("x", "y"):
                    held = batch.column(name)[i].values
                    hashes = [np.frombuffer(h.as_buffer(), np.uint64) for h in held.field("hashes")]
                    sides.append((hashes, held.field("label"), held.field("member")))
                (xs, lx, ids_x), (ys, ly, ids_y) = sides
                number: dict[bytes, int] = {}
                lx, ly = (np.array([number.setdefault(v, len(number)) for v in side.to_pylist()], np.int64) for side in (lx, ly))
                found = list(near_pairs(xs, ys, lx, ly))
                columns = [ids_x.take(pa.array([f[0] for f in found], pa.int64())), ids_y.take(pa.array([f[1] for f in found], pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return meetings.join(x, ["family", "bx"]).join(y, ["family", "ay", "by"]).select("x", "y").mapInArrow(trimmed(compare), "a binary, b binary")


def true_links(pairs: DataFrame, tested: DataFrame | None, texts: DataFrame, nodes: DataFrame, scratch: Scratch, width: int) -> tuple[DataFrame, DataFrame]:
    """(links, pairs) of those of the pairs (a, m, b, n) that were not tested before; m and n are set sizes."""
    sized = pairs.where((F.col("a") != F.col("b")) & (DENOMINATOR * F.least("m", "n") >= NUMERATOR * F.greatest("m", "n")))
    ordered = F.struct(F.col("a").alias("v"), F.col("m").alias("s")), F.struct(F.col("b").alias("v"), F.col("n").alias("s"))
    fresh = sized.select(F.least(*ordered).alias("x"), F.greatest(*ordered).alias("y")).select(
        F.col("x.v").alias("a"), F.col("x.s").alias("m"), F.col("y.v").alias("b"), F.col("y.s").alias("n")
    )
    fresh = fresh.distinct()
    fresh = scratch(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"), "candidate-pairs")
    near = scratch(possible(fresh, _of_pairs(fresh, nodes, scratch)), "possible-pairs")
    sets = scratch(member_sets(texts, _of_pairs(near, nodes, scratch), width), "member-sets")
    return scratch(linked(near, sets), "links"), fresh.select("a", "b")


def _of_pairs(pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of pairs (a, b)."""
    ends = scratch(pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct(), "pair-ends")
    return scratch(nodes.join(broadcast_if_small(ends, BROADCAST_ROWS), "set_id", "left_semi"), "pair-nodes")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the class of each member so far, itself where it has none."""
    of = labels.select(F.col("node").alias("member"), F.col("component").alias("c"))
    return rows.join(broadcast_if_small(of, BROADCAST_ROWS), "member", "left").withColumn("label", F.coalesce("c", "member")).drop("c")


def _often(rows: DataFrame) -> DataFrame:
    """member, band of the nodes that are in as many of the buckets of rows as a link would make it."""
    return rows.groupBy("member", "band").agg(F.sum("times").alias("k"), F.min("s").alias("s")).where("k >= s").select("member", "band")


def _mixed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of buckets that hold several classes; a bucket's rows lie in SHARES parts, of which each is looked up once."""
    rest = [c for c in rows.columns if c != "bucket"]
    shares = rows.groupBy("bucket", F.pmod(F.xxhash64("member"), F.lit(SHARES)).alias("share"))
    shares = scratch(shares.agg(F.collect_list(F.struct(*rest)).alias("held"), F.min("label").alias("l"), F.max("label").alias("g")), "bucket-shares")
    buckets = shares.groupBy("bucket").agg(F.min("l").alias("l"), F.max("g").alias("g")).where("l < g").select("bucket")
    several = shares.join(broadcast_if_small(scratch(buckets, "mixed-buckets"), BROADCAST_ROWS), "bucket", "left_semi")
    return scratch(several.select("bucket", F.explode("held").alias("x")).select("bucket", "x.*"), "mixed-members")


def _of_nodes(rows: DataFrame, often: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of the nodes in often (member, band)."""
    return rows.join(broadcast_if_small(scratch(often, "nodes-often"), BROADCAST_ROWS), ["member", "band"], "left_semi")


def _classes(met: DataFrame, texts: DataFrame, nodes: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """node, component: the classes of linked nodes, from what met."""
    able = met.where("kind = 2").groupBy(F.col("members").alias("member"), "band")
    able = able.agg(F.sum("times").alias("k"), F.sum("weight").alias("w"), F.min("spare").alias("s"), F.min("n").alias("n")).where("k >= s").drop("k")
    able = broadcast_if_small(scratch(able, "nodes-met"), BROADCAST_ROWS)
    ids = F.explode(F.expr(f"transform(sequence(1, length(members), {ID}), i -> substring(members, i, {ID}))")).alias("member")

    packed = met.where("kind = 0").groupBy("band", "members").agg(F.sum("times").alias("times")).withColumn("bucket", F.xxhash64("band", "members"))
    small = packed.select("bucket", "band", "times", ids).join(able, ["member", "band"]).groupBy("bucket", "band", "times")
    small = scratch(small.agg(F.collect_list(F.struct("w", "member", "n", "s")).alias("ms")).where("size(ms) > 1"), "small-buckets")
    large = met.where("kind = 1").select("bucket", "band", "times", ids).join(able, ["member", "band"]).dropDuplicates(["bucket", "member"])
    large = scratch(large, "large-buckets")

    # the node that meets most others is the likeliest centre of its near copies
    pairs = small.select(F.array_max("ms").alias("p"), F.explode("ms").alias("x")).select(F.col("p.member").alias("a"), F.col("p.n").alias("m"), F.col("x.member").alias("b"), "x.n")
    pivots = scratch(large.groupBy("bucket").agg(F.max(F.struct("w", "member", "n")).alias("p")), "pivots")
    of_large = large.join(broadcast_if_small(pivots, BROADCAST_ROWS), "bucket").select(F.col("p.member").alias("a"), F.col("p.n").alias("m"), F.col("member").alias("b"), "n")
    links, tested = true_links(pairs.unionByName(of_large), None, texts, nodes, scratch, width)
    labels = scratch.note(components(links))

    # small buckets of several classes: pairs across classes, BUCKET nodes a bucket at most
    each = _labelled(small.select("bucket", "band", "times", F.explode("ms").alias("x")).select("bucket", "band", "times", "x.*"), labels)
    several = each.groupBy("bucket", "band", "times").agg(F.collect_list(F.struct("member", "n", "s", "label")).alias("ms"), F.min("label").alias("l"), F.max("label").alias("g"))
    several = scratch(several.where("l < g").drop("l", "g"), "mixed-small-buckets")
    counted = ["member", "band", "times", "s"]
    in_small = scratch(several.select("band", "times", F.explode("ms").alias("x")).select("x.member", "band", "times", "x.s"), "mixed-small-members")
    # nodes that all buckets together don't allow a link leave large ones before these are asked for their classes, and are counted again after that
    mixed = _mixed(_labelled(_of_nodes(large, _often(in_small.unionByName(large.select(counted))), scratch), labels), scratch)
    meeting = in_small.unionByName(mixed.select(counted))
    often = broadcast_if_small(scratch(_often(meeting), "nodes-mixed"), BROADCAST_ROWS)
    one = several.select("band", "ms", F.explode("ms").alias("x")).select("band", "ms", "x.member", F.col("x.n").alias("m"), "x.label").join(often, ["member", "band"], "left_semi")
    other = F.explode(F.filter("ms", lambda y: (y["label"] != F.col("label")) & (y["member"] > F.col("member")))).alias("y")
    two = one.select("band", F.col("member").alias("a"), "m", other).select("band", "a", "m", F.col("y.member").alias("member"), "y.n").join(often, ["member", "band"], "left_semi")
    more, _ = true_links(two.select("a", "m", F.col("member").alias("b"), "n"), tested, texts, nodes, scratch, width)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = scratch.note(components(links))
        mixed = _labelled(mixed.drop("label"), labels)

    # pairs that meet in no small bucket: large buckets of one pivot are a family
    mixed = _mixed(_of_nodes(mixed, _often(mixed), scratch), scratch)
    members = scratch(_of_nodes(mixed, _often(mixed), scratch), "undecided")
    if not members.isEmpty():
        family = scratch(members.groupBy("bucket").agg(F.max(F.struct("w", "member")).alias("p")).select("bucket", F.col("p.member").alias("family")), "bucket-families")
        family = scratch(members.join(family, "bucket").select("family", "member", "label", "n").distinct(), "family-members")
        ends = scratch(family.select(F.col("member").alias("set_id")).distinct(), "family-nodes")
        sets = member_sets(texts, nodes.join(broadcast_if_small(ends, BROADCAST_ROWS), "set_id", "left_semi"), width)
        links = links.unionByName(scratch(family_links(family, scratch(sets, "member-sets"), scratch), "links"))
        labels = scratch.note(components(links))
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) of each document."""
    texts = _texts(docs, id_col, text_col)
    scratch, lasting = Scratch(), Scratch()
    found = lasting(document_sets(texts, width), "shingle-sets")
    nodes = found.where("set_id is not null").groupBy("set_id")
    nodes = nodes.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = scratch(nodes, "shingle-nodes")
    first_part, n_parts, parts = parts_of_bands(nodes)
    met = scratch(meetings(packed_signatures(texts, first_part, n_parts, width), first_part, parts), "meetings")
    labels = _classes(met, texts, nodes, scratch, width)

    of = labels.select(F.col("node").alias("set_id"), "component")
    several = nodes.select("set_id", "doc_id", "copies").join(broadcast_if_small(of, BROADCAST_ROWS), "set_id", "left").where("component is not null or copies > 1")
    several = scratch(several.select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component")), "classes-of-several")
    least = scratch(several.groupBy("component").agg(F.min("doc_id").alias("component_id")), "classes")
    classes = lasting(several.join(broadcast_if_small(least, BROADCAST_ROWS), "component").select("set_id", "component_id", F.lit(True).alias("known")), "set-classes")
    scratch.drop()
    out = found.select("doc_id", "n_shingles", "set_id").join(broadcast_if_small(classes, BROADCAST_ROWS), "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
