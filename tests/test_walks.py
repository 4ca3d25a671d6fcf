import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import bandit, walks
from tracewell.plans import queries

SCHEMA = "txn_id long, src string, dst string, amount double, ts timestamp"


@pytest.fixture
def ledger(spark):
    def make(rows):
        start = dt.datetime(2024, 1, 1)
        return spark.createDataFrame([(i, s, d, float(a), start + dt.timedelta(minutes=m)) for i, (s, d, a, m) in enumerate(rows)], SCHEMA)

    return make


def test_chains(ledger):
    txn = ledger([("A", "B", 100, 0), ("B", "C", 80, 10), ("C", "D", 60, 20), ("C", "A", 60, 15), ("D", "E", 5, 500), ("X", "X", 1, 0), ("X", "Y", 1, 1)])
    rows = walks.greedy_chains(txn, 7200).collect()
    # C to A comes first but A is on the path already, so C to D is taken; D to E is too late
    assert [tuple(r) for r in rows] == [(0, "A>B>C>D", 3, 1200, 0.6)]
    assert walks.greedy_chains(txn, 7200, 3, 2).count() == 0
    assert walks.greedy_chains(txn.limit(0), 7200).count() == 0


def test_long_cycles(ledger):
    square = [("B", "C", 9, 0), ("C", "D", 9, 0), ("D", "A", 9, 0), ("A", "B", 9, 0)]
    txn = ledger(square + [("A", "C", 1, 0), ("C", "B", 9, 0), ("Z", "A", 9, 0)])
    assert {tuple(r) for r in walks.long_cycles(txn, 4, 5).collect()} == {(2, "B>C"), (4, "A>B>C>D")}
    assert {r.cycle for r in walks.long_cycles(txn, 4).collect()} == {"B>C", "A>C>D", "A>B>C>D"}
    assert walks.long_cycles(txn.limit(0)).count() == 0


def test_components(ledger):
    line = [(f"n{i:03}", f"n{i + 1:03}", 1, 0) for i in range(40)]
    got = {r.account: r.component for r in walks.components(ledger(line[::-1] + [("p", "q", 1, 0), ("r", "r", 1, 0)])).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(41)} | {"p": "p", "q": "p", "r": "r"}
    assert walks.components(ledger([])).count() == 0


def test_registered_components_take_small_transfers(spark, tmp_path):
    n, moved = 9, [(0, 1, 99_999.0), (1, 2, 150_000.0), (3, 4, 0.01), (5, 5, 7.0), (6, 7, 200_000.0), (7, 2, 1.0)]
    spark.createDataFrame([(i, i % 3) for i in range(n)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, s, "x") for i, (s, *_) in enumerate(moved)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(i, 1, n + d, 0, a, dt.datetime(2024, 1, 1), "R") for i, (_, d, a) in enumerate(moved)]
    schema = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    root = list(range(n))
    for s, d, _ in moved:  # union-find; small enough to relabel all
        low, high = sorted((root[s], root[d]))
        root = [low if r == high else r for r in root]
    got = {r.account: r.component for r in queries.QUERIES["g18_components_whole"](spark, str(tmp_path)).collect()}
    assert got == {v: root[v] for s, d, _ in moved for v in (s, d)}


def test_walk_equals_the_linear_system(ledger):
    rows = [("A", "B", 1, 0), ("A", "B", 1, 1), ("B", "C", 1, 2), ("C", "A", 1, 3), ("C", "D", 1, 4)]
    got = {r.account: r.score for r in walks.walk_with_restart(ledger(rows), "A", 0.15, 60).collect()}
    n = np.zeros((4, 4))
    for s, d, *_ in rows:
        n[ord(s) - 65, ord(d) - 65] += 1
        n[ord(d) - 65, ord(s) - 65] += 1
    p = np.linalg.solve(np.eye(4) - 0.85 * (n / n.sum(1, keepdims=True)).T, [0.15, 0, 0, 0])
    assert np.allclose([got[c] for c in "ABCD"], p, atol=1e-3)
    assert walks.walk_with_restart(ledger([]), "A", 0.15, 2).collect()[0].score == 0.15


def test_bandit(spark):
    rows = spark.createDataFrame([("x", 1.0, 2.0, 1.0), ("x", 0.5, None, -0.3), ("y", 3.0, 1.0, 1.0)], "action string, u double, v double, r double")
    scored = bandit.linucb_scores(rows, ["u", "v"], bandit.linucb_state(rows, ["u", "v"], "action", "r")).orderBy(F.desc("u")).first()
    a, b = np.eye(2) + np.outer([1, 2], [1, 2]) + np.outer([0.5, 0], [0.5, 0]), np.array([1 - 0.15, 2.0])
    x = np.array([3.0, 1.0])
    want = np.linalg.solve(a, b) @ x + np.sqrt(x @ np.linalg.inv(a) @ x)
    assert scored.ucb["x"] == pytest.approx(want) and set(scored.ucb) == {"x", "y"}
    with pytest.raises(ValueError):
        bandit.linucb_state(rows, [], "action", "r")


def test_kept_ratio_is_that_of_doubles(ledger):
    rows = [("A", "B", 115.2, 0), ("B", "C", 1, 1), ("C", "D", 118.98, 2), ("E", "F", 0, 0), ("F", "G", 0, 1), ("G", "H", 5, 2), ("I", "J", 0, 0), ("J", "K", 1, 1), ("K", "L", 0, 2)]
    got = {r.start_id: r.kept_ratio for r in walks.greedy_chains(ledger(rows), 7200).collect()}
    # 118.98 / 115.2 is 1.0328125 as text, and 1032812.4999999999 millionths
    assert got[0] == 1.032812 and got[3] == float("inf") and np.isnan(got[6])


def test_cycles_in_parts_of_any_size_need_no_parts(ledger, monkeypatch):
    def refused(*_):
        raise AssertionError("the parts of the whole graph were looked for")

    monkeypatch.setattr("tracewell.operators.parts.strong_parts", refused)
    txn = ledger([("A", "B", 1, 0), ("B", "A", 1, 0), ("B", "C", 1, 0), ("C", "D", 1, 0), ("D", "B", 1, 0), ("D", "E", 1, 0)])
    assert {r.cycle for r in walks.long_cycles(txn, 5).collect()} == {"A>B", "B>C>D"}
    assert [r.nodes for r in walks.cycle_nodes(txn, 2, largest_part=None).collect()] == [["A", "B"]]
