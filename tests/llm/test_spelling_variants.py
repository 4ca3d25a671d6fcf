import random
import re
import zlib
from collections import Counter

import pytest
from test_filters import by_duckdb, same_rows

from tracewell.llm import spelling_variants as S

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts):
    near = {a: [b for b in counts if one_apart(a, b)] for a in counts}
    form = {}
    for a, own in near.items():
        best = min(own, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best and counts[best] >= 5 * counts[a] else None
    for a in counts:
        root = a
        while form[root]:
            root = form[root]
        yield a, form[a], root, counts[a], len(near[a]), counts.get(form[a])


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def family(rng, n, core, letters="abé"):
    """Words of many lengths around a core, close to each other."""
    out = set()
    for _ in range(n):
        word = list(core)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word))
            word[i : i + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters)], [rng.choice(letters)]])
        out.add("".join(word))
    return {w for w in out if len(w) >= 6}


@pytest.mark.parametrize("subtree", [200_000, 12])
def test_pairs_equal_brute_force(spark, monkeypatch, subtree):
    monkeypatch.setattr(S, "SUBTREE", subtree)
    rng = random.Random(2)
    words = family(rng, 300, "abababab") | family(rng, 120, "aaaaaaaaaaaaaa") | family(rng, 40, "zyxwvu") | {"q" * n for n in range(6, 30)} | {"x" * 400 + "y", "x" * 400 + "z", "x" * 400}
    words |= {"onepla" + c + "ce" for c in LETTERS} | {"onepla" + c + "ce" + d for c in "ab" for d in LETTERS}
    counts = {w: rng.choice([5, 6, 7, 30, 150, 800, 4000]) for w in words}
    got = S.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_variants(counts))


def test_no_pair_twice_in_a_subtree():
    words = ["abc", "abd", "ab", "abcd", "xbc", "a", "zzz"]
    pairs = [frozenset((a[0], b[0])) for a, b in S.trie_pairs([(w, w, 1) for w in words], 3)]
    want = {frozenset((a, b)) for a in words for b in words if one_apart(a, b) and 3 in (len(a), len(b))}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def texts():
    rng = random.Random(8)
    words = sorted(family(rng, 60, "sprechen") | family(rng, 30, "garçons") | {"Straße", "ÀÉÎÕÜ×÷x"})
    weights = [rng.random() ** 12 for _ in words]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 400))).replace("sp", "Sp") + rng.choice(["", "\n", "1", "_a"])) for i in range(120)]
    return [*rows, (None, " ".join(words)), (None, None), (5, None), (6, ""), (7, "a" * 5000), (3, rows[3][1])]


def test_documents_equal_brute_force_and_sql(spark, docs, repeated):
    own = spark.createDataFrame([(*r, "x", 1) for r in texts()], "doc_id long, text string, word string, n int").repartition(3)
    for frame in (own, docs, repeated):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = sorted(map(tuple, S.spelling_variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()))
        assert got == sorted(brute_variants(brute_counts(rows)))
    want = by_duckdb(S.SQL, documents=own.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    same_rows(S.spelling_variants(own).toPandas().astype({"form_n": "Int64"}), want.astype({"form_n": "Int64", "n_near": "int64"}))
    assert len(want) > 20 and want.form.notna().sum() > 3
    assert S.spelling_variants(own.limit(0)).collect() == []


def test_partial_counts_are_given_out(spark, monkeypatch):
    counts = S.vocabulary(spark.createDataFrame(texts(), "doc_id long, text string")).collect()
    monkeypatch.setattr(S, "HELD", 40)
    assert sorted(map(tuple, S.vocabulary(spark.createDataFrame(texts(), "doc_id long, text string")).collect())) == sorted(map(tuple, counts))
