"""Behaviour of accounts and the bandit's queue against plain loops over rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.investigation import behaviour
from tracewell.operators import bandit

SCHEMA = "txn_id long, src string, dst string, amount double, ts timestamp, channel string"
START = dt.datetime(2024, 1, 1)


def _ledger(seed):
    """Bursts around rests, with ties, exact ends of windows, transfers to oneself and one account in half of all rows."""
    r, rows = random.Random(seed), []
    for _ in range(400):
        day = r.choice([0, 1, 2, 9, 10, 17, 40, 41, 47])
        at = START + dt.timedelta(days=day, seconds=r.choice([0, 0, 1, 43_200, 86_399]))
        rows.append((len(rows), r.choice(["hub", f"a{r.randrange(25)}"]), f"a{r.randrange(25)}", float(r.randrange(1, 90)), at, r.choice(["branch_cash", "UPI", None])))
    return rows


def _own(rows):
    accounts = {}
    for _, s, d, x, t, c in rows:
        for a in {s, d}:
            accounts.setdefault(a, []).append((t, x, a == d, a == s, c))
    return {a: sorted(v, key=lambda x: x[0]) for a, v in accounts.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, seed):
    rows = _ledger(seed)
    txn, own = spark.createDataFrame(rows, SCHEMA).repartition(5), _own(rows)

    months = {(m.account, m.month): (m.n, m.total_in, m.total_out, m.total, m.n_cash, m.cash_in, m.n_transfers, m.transfers) for m in behaviour.monthly_trends(txn, transfer=F.col("channel") == "UPI").collect()}
    expected = {}
    for a, v in own.items():
        for t, x, came, went, c in v:
            e = expected.setdefault((a, t.strftime("%Y-%m")), [0.0] * 8)
            cash, moved = came and c == "branch_cash", c == "UPI"
            for i, add in enumerate([1, x * came, x * went, x * (came + went), cash, x * cash, moved, x * moved]):
                e[i] += add
    assert months == {k: tuple(v) for k, v in expected.items()}

    seen = 0
    for gap, span, least in ((7, 7, 3), (1, 1, 2), (15, 6, 1)):
        woken = []
        for a, v in own.items():
            for before, now in zip(v, v[1:]):
                if now[0] - before[0] >= dt.timedelta(days=gap):
                    n = sum(now[0] <= x[0] <= now[0] + dt.timedelta(days=span) for x in v)
                    woken += [(a, (now[0] - before[0]).days, n)] if n >= least else []
        found = behaviour.reactivations(txn, gap, span, least).collect()
        assert sorted((f.account, f.gap_days, f.burst) for f in found) == sorted(woken)
        seen += len(woken)
    assert seen > 20

    rates = {r.account: r for r in behaviour.velocity(txn, 1, 1.5).collect()}
    assert rates.keys() == own.keys()
    for a, v in own.items():
        cutoff = v[-1][0] - dt.timedelta(weeks=1)
        late, early = sum(x[0] > cutoff for x in v), sum(x[0] <= cutoff for x in v)
        base = early / (max((cutoff - v[0][0]).days, 1) / 7) if early and len(v) > 1 else 0.0
        assert rates[a].recent == pytest.approx(late if len(v) > 1 else 0.0) and rates[a].baseline == pytest.approx(base)
        assert rates[a].ratio == (pytest.approx(late / base) if base else None) and rates[a].increased == bool(base and late / base >= 1.5)


def test_bundle_and_edges(spark):
    rows = [
        (1, "a", "b", 5.0, START, "UPI"), (2, "a", "a", 2.0, START + dt.timedelta(days=100), "UPI"), (3, "a", "b", 1.0, START + dt.timedelta(days=100), None),
        (4, "a", "c", None, START + dt.timedelta(days=107), "UPI"), (5, "a", "c", 9.0, None, "UPI"), (6, None, "d", 9.0, START, "UPI"),
    ]
    txn = spark.createDataFrame(rows, SCHEMA)
    scope = spark.createDataFrame([("a",), ("a",), ("d",), ("nobody",), (None,)], "account string")
    found = {r.account: r for r in behaviour.bundle(txn, scope).collect()}
    assert found.keys() == {"a", "d"}  # those of the scope with transfers, each once
    a = found["a"]
    assert [(m.month, m.n, m.total_in, m.total_out) for m in a.months] == [("2024-01", 1, 0.0, 5.0), ("2024-04", 3, 2.0, 3.0)]
    assert a.reactivated and [(e.gap_days, e.burst) for e in a.events] == [(100, 3)]  # up to the very end of the seventh day
    assert list(a.deferred) == behaviour.DEFERRED
    d = found["d"]
    assert not d.reactivated and d.events == [] and (d.recent, d.baseline, d.ratio, d.increased) == (0.0, 0.0, None, False)
    assert behaviour.bundle(txn.limit(0), scope).collect() == []
    with pytest.raises(ValueError):
        behaviour.reactivations(txn, 0)
    with pytest.raises(ValueError):
        behaviour.velocity(txn, 0)


def _state(verdicts):
    a, b = np.eye(2), np.zeros(2)
    for x, good in verdicts:
        a += np.outer(x, x)
        b += np.array(x) * (1.0 if good else -0.3)
    return np.linalg.inv(a), np.linalg.inv(a) @ b


def test_queue_and_replay(spark):
    r = random.Random(5)
    rows = [(i, r.random(), r.random(), r.choice([True, True, False, None])) for i in range(157)]
    frame = spark.createDataFrame(rows, "k long, u double, v double, good boolean").repartition(4)
    judged = [((u, v), g) for _, u, v, g in rows if g is not None]
    inverse, theta = _state(judged)
    expected = []
    for k, u, v, _ in rows:
        x = np.array([u, v])
        expected.append((-round(float(theta @ x + np.sqrt(x @ inverse @ x)), 4), k))
    queue = bandit.ranked_by_bound(frame, ["u", "v"], frame, 20, "k").orderBy("place").collect()
    assert [(-q.ucb, q.k) for q in queue] == sorted(expected)[:20] and [q.place for q in queue] == list(range(1, 21))

    steps = {(s.step, s.feature): s for s in bandit.replayed(frame, ["u", "v"], ["k"], 30).collect()}
    assert {s for s, _ in steps} == {*range(30, len(judged), 30), len(judged)}
    for (step, feature), found in steps.items():
        n_good = sum(g for _, g in judged[:step])
        assert found.n_good == n_good and found.precision == pytest.approx(n_good / step, abs=5.1e-4)
        assert found.weight == pytest.approx(_state(judged[:step])[1]["uv".index(feature)], abs=1e-4)


def test_queue_without_verdicts(spark):
    frame = spark.createDataFrame([(1, 0.5, None, None), (2, 0.5, None, None), (3, None, None, None)], "k long, u double, v double, good boolean")
    queue = bandit.ranked_by_bound(frame, ["u", "v"], frame, 5, "k").orderBy("place").collect()
    assert [(q.k, q.expected, q.ucb, q.exploring) for q in queue] == [(1, 0.0, 0.5, True), (2, 0.0, 0.5, True), (3, 0.0, 0.0, False)]  # ties by key
    assert bandit.replayed(frame, ["u", "v"], ["k"], 2).collect() == []
    with pytest.raises(ValueError):
        bandit.replayed(frame, ["u", "v"], ["k"], 0)
