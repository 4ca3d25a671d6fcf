import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import bytescan, jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def naive(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def near_texts(seed, sizes, copies):
    """Texts with copies edited so that similarities lie around the bound, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=30)
    out = []
    for n in sizes:
        base = rng.choices(vocabulary, k=n)
        if rng.random() < 0.5:
            base[5:5] = passage
        out.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words).title() if rng.random() < 0.3 else " ".join(words))
    return out


@pytest.mark.parametrize("seed, bucket", [(1, 64), (2, 3)])
def test_classes_equal_brute_force(spark, texts, seed, bucket, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    rng = random.Random(seed)
    rows = list(enumerate(near_texts(seed, [rng.randint(1, 60) for _ in range(50)] + [rng.randint(60, 900) for _ in range(12)], 7)))
    if seed == 1:
        rows += [(len(rows) + i, t) for i, t in enumerate(texts[:60])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, member string").repartition(3)
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()))
    assert got == naive(rows)
    if seed == 1:  # a near copy without an id, of a text that is a near copy itself, joins two classes but is never the least
        words = [f"v{i}" for i in range(200)]
        far = words[:20] + [f"u{i}" for i in range(20)] + words[40:]
        mid = words[:30] + far[30:]
        odd = [(10_000, " ".join(words)), (None, " ".join(mid)), (10_001, " ".join(far)), (None, " ".join(mid) + " end")]
        more = docs.unionByName(spark.createDataFrame([(i, t, "x") for i, t in odd], docs.schema))
        classes = {(r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(more).collect() if r.doc_id is None or r.doc_id >= 10_000}
        assert classes == {(None, 10_000), (10_000, 10_000), (10_001, 10_000)}
    if seed == 2:
        assert jaccard_join.near_duplicates(docs.limit(0)).collect() == []


def test_every_similar_pair_shares_what_is_promised():
    """Without Spark: similar sets share at least `spare` signatures of the seed-0 dealing, or one of a later dealing."""
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(3, 120))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        drop = int(rng.integers(0, n // 7 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 7 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        sig, entry, band, spare = jaccard_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert len(np.intersect1d(sig[entry < 2], sig[entry >= 2])) > 0
        shared = []
        for x in (0, 1):
            for y in (2, 3):
                if band[x] == band[y] and (entry == x).any() and (entry == y).any():
                    shared.append((len(np.intersect1d(sig[entry == x], sig[entry == y])), max(spare[x], spare[y])))
        assert any(k >= least for k, least in shared)
        assert jaccard_join.sketch_distance(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= len(a) + len(b) - 2 * both


def test_word_scan_equals_regex(texts):
    data, offsets = bytescan.text_buffers(pa.array(texts, pa.string()))
    w = bytescan.Words(data, offsets)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = [bytes(data[s:e]).decode() for s, e in zip(w.start, w.end, strict=True)]
    assert got == [x for ws in want for x in ws] and w.per_doc.tolist() == list(map(len, want))


def test_family_blocks_find_all_links():
    """Without Spark: bitmaps of different widths rule out no link, and equal labels give no pair."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 130).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, 40)) :], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)])) for _ in range(120)]
    labels = rng.integers(0, 4, len(sets))
    want = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if labels[i] != labels[j] and 100 * both >= 75 * (len(a) + len(b) - both):
                want.add((i, j))
    got = list(jaccard_join.near_pairs(sets, sets, labels, labels))
    assert set(got) == want and len(got) == len(want) > 0
    assert len({len(jaccard_join.bitmap(s)) for s in sets}) > 1


def test_family_of_near_copies_equals_brute_force(spark):
    """A group of more than BUCKET near copies whose edits lie around the bound, and copies of what they share."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, rows = rng.choices(vocabulary, k=150), []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(260 + i, " ".join(base[:80] + rng.choices(vocabulary, k=70))) for i in range(100)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == naive(rows)


def test_scans_in_pieces_equal_scans_at_once(texts, monkeypatch):
    data, offsets = bytescan.text_buffers(pa.array([*texts, "w" * 5000 + " " + "v" * 4999], pa.string()))
    w = bytescan.Words(data, offsets)
    edges = np.sort(np.concatenate([offsets, w.start, w.end]))
    want = np.concatenate([[0], np.cumsum(w.inside)])[edges]
    long = (w.end - w.start) > 64
    whole = w.hashes()
    monkeypatch.setattr(bytescan, "_BLOCK", 64)
    assert (bytescan.counts_before(w.inside, edges) == want).all()
    pieces = w.hashes()
    assert (pieces[~long] == whole[~long]).all() and len(set(pieces[long].tolist())) == len({bytes(data[s:e]) for s, e in zip(w.start[long], w.end[long], strict=True)})


def test_buckets_of_several_classes_are_looked_up_by_shares_of_rows(spark):
    rows = [(b, str(m % 3 if b else 0), m, b) for b in range(3) for m in range(600)]
    rows = spark.createDataFrame(rows, "bucket long, label string, member long, times long")
    asked = []

    def scratch(table, name):
        table = table.localCheckpoint()
        asked.append((name, table.count()))
        return table

    got = jaccard_join._mixed(rows, scratch)
    assert sorted(map(tuple, got.select(rows.columns).collect())) == sorted(map(tuple, rows.where("bucket > 0").collect()))
    assert dict(asked)["bucket-shares"] <= 3 * jaccard_join.SHARES < 600
