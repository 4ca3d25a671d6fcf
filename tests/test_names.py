import random
from difflib import SequenceMatcher

import pytest

from tracewell.operators import names


def ratio(a, b):
    a, b = sorted((a.strip().lower(), b.strip().lower()))
    return SequenceMatcher(None, a, b).ratio()


def people(seed, n):
    rng = random.Random(seed)
    first, last = ["Anna", "Hanna", "Johan", "Joana", "Mary-Ann", "Li", "Łukasz", "Zoë"], ["Smith", "Smyth", "Schmidt", "Ng", "O'Neill", "Müller", "Mueller", "van den Berg"]
    out = []
    for i in range(n):
        name = list(f"{rng.choice(first)} {rng.choice(last)}")
        for _ in range(rng.randint(0, 2)):
            name[rng.randrange(len(name))] = rng.choice(["", "x", "a", "E", "ö"])
        out.append((i, "".join(name) + rng.choice(["", " "]), rng.choice("xy")))
    return [*out, (n, None, "x"), (n + 1, "  ", "x"), (n + 2, "a", "x"), (n + 3, "A", "x"), (n + 4, out[0][1], out[0][2])]


@pytest.mark.parametrize("least", [0.85, 0.6, 1.0])
def test_all_pairs(spark, least):
    rows = people(int(least * 100), 130)
    frame = spark.createDataFrame(rows, "id long, name string, city string").repartition(3)
    known = [(i, n, c) for i, n, c in rows if n and n.strip()]
    want = {(a, b): ratio(x, y) for a, x, c in known for b, y, d in known if a < b and ratio(x, y) >= least}
    got = {(r.id_a, r.id_b): r.ratio for r in names.similar_names(frame, least).collect()}
    assert got == want and len(want) > 1
    within = {(r.id_a, r.id_b) for r in names.similar_names(frame, least, ("city",)).collect()}
    city = {i: c for i, _, c in rows}
    assert within == {(a, b) for a, b in want if city[a] == city[b]}


def test_each_pair_once_and_nothing(spark):
    frame = spark.createDataFrame([(i, "Supplier#00000000" + str(i)) for i in range(9)], "id long, name string")
    assert names.similar_names(frame).count() == 36
    assert names.similar_names(frame.limit(0)).collect() == []


def test_equal_names_are_compared_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(names, "cut", lambda df: kept.append(df) or df)
    rows = [(i, f"Supplier#{i % 6:03}", i % 2) for i in range(60)] + [(60, "abcd", 0), (61, "abcd ", 1)]
    got = names.similar_names(spark.createDataFrame(rows, "id long, name string, block int"), 0.85, ("block",)).collect()
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2}
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want)
    assert all(r.ratio == 1.0 for r in got if r.id_a % 6 == r.id_b % 6)
    assert max(df.count() for df in kept if "ratio" in df.columns) <= 12
