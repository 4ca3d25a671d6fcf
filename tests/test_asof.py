import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import asof, graph, walks
from tracewell.session import cut

SCHEMA = "txn_id long, src string, dst string, amount double, ts timestamp"
START = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    """rows: (src, dst, amount, minute); ids are their places."""
    return spark.createDataFrame([(i, s, d, float(a), START + dt.timedelta(minutes=m)) for i, (s, d, a, m) in enumerate(rows)], SCHEMA).repartition(3)


def random_rows(seed, n, accounts, minutes):
    rng = random.Random(seed)
    return [(f"a{rng.randrange(accounts)}", f"a{rng.randrange(accounts)}", rng.randint(1, 99), rng.randrange(minutes)) for _ in range(n)]


def after(rows, i, window):
    """Transfers that leave i's target later, within the window, in order of time and id."""
    _, to, _, m = rows[i]
    return [j for _, j in sorted((rows[j][3], j) for j in range(len(rows)) if rows[j][0] == to and m < rows[j][3] <= m + window)]


@pytest.mark.parametrize(("seed", "accounts", "minutes"), [(1, 4, 300), (2, 3, 12), (3, 12, 400)])
def test_next_departures_equal_brute_force(spark, seed, accounts, minutes):
    rows = random_rows(seed, 150, accounts, minutes)
    got = {(r.of, r.next.id) for r in asof.next_departures(frame(spark, rows), 60 * 60).collect()}
    want = {(i, j) for i in range(len(rows)) for j in [next((j for j in after(rows, i, 60) if rows[j][1] != rows[i][0]), None)] if j is not None}
    assert got == want


def test_upcoming_equals_brute_force(spark):
    rows = random_rows(5, 200, 6, 200)
    got = {r.txn_id: [o.id for o in r.options] for r in asof.upcoming(frame(spark, rows), 3600, 3).collect()}
    for i, (s, d, *_) in enumerate(rows):
        first = {}
        for j in after(rows, i, 60):
            if rows[j][0] != rows[j][1]:
                first.setdefault(rows[j][1], j)
        assert s == d or got.get(i, []) == list(first.values())[:3]


def walk(rows, i, window, longest):
    nodes, legs = list(rows[i][:2]), [i]
    while len(legs) < longest:
        last, t0 = legs[-1], rows[i][3]
        step = next((j for j in after(rows, last, window) if rows[j][3] <= t0 + window and rows[j][1] not in nodes), None)
        if step is None:
            break
        legs.append(step)
        nodes.append(rows[step][1])
    return legs, nodes


@pytest.mark.parametrize(("seed", "accounts", "minutes"), [(1, 9, 200), (4, 40, 60)])
def test_chains_equal_the_walk_in_one_order(spark, seed, accounts, minutes):
    rows = random_rows(seed, 250, accounts, minutes)
    rows += rows[:10]  # the same accounts, amount and time again
    busy = {a: sum(s == a != d for s, d, *_ in rows) for a, *_ in rows}
    used, want = set(), []
    for i in sorted((i for i, (s, d, *_) in enumerate(rows) if s != d), key=lambda i: (-busy[rows[i][0]], rows[i][0], rows[i][3], i)):
        legs, nodes = walk(rows, i, 60, 21)
        key = lambda j: (rows[j][0], rows[j][1], rows[j][3])
        if len(legs) >= 3 and key(i) not in used:
            used |= {key(j) for j in legs}
            want.append((i, tuple(nodes)))
    txn = frame(spark, rows)
    got = [(r.start_id, tuple(r.nodes)) for r in asof.transfer_chains(txn, 3600, cut).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5
    few = [(r.start_id, tuple(r.nodes)) for r in asof.transfer_chains(txn, 3600, cut, max_chains=4).collect()]
    assert sorted(few) == sorted(want[:4])


def test_a_hub_of_100000_transfers(spark):
    n = 50_000
    into = spark.range(n).select(F.col("id").alias("txn_id"), F.concat(F.lit("s"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit(1.0).alias("amount"), F.timestamp_seconds(F.col("id") * 2).alias("ts"))
    out = spark.range(n).select((F.col("id") + n).alias("txn_id"), F.lit("hub").alias("src"), F.concat(F.lit("t"), "id").alias("dst"), F.lit(1.0).alias("amount"), F.timestamp_seconds(F.col("id") * 2 + 1).alias("ts"))
    txn = into.unionByName(out)
    hops = graph.next_hops(txn, 3600)
    assert hops.where("next_id = txn_id + 50000").count() == hops.count() == n
    assert walks.used_once(txn, 3600, 2).count() == n


def test_nulls_and_nothing(spark):
    rows = [(0, None, "a", 1.0, START), (1, "a", None, 1.0, START), (2, "a", "b", 1.0, None), (None, "a", "b", 1.0, START), (4, "a", "b", None, START), (5, "a", "a", 1.0, START)]
    for txn in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        assert asof.next_departures(txn, 60).collect() == []
        assert walks.used_once(txn, 60).collect() == []
