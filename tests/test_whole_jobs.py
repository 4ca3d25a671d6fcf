"""Registered queries that take every row, pair and cycle of their tables."""

import datetime as dt
import random

from tracewell.operators import parts
from tracewell.plans import networks, queries
from tracewell.plans import parts as part_plans


def orders_tables(spark, folder, n, moved):
    """Tables whose orders_ledger has n accounts and the transfers moved (src, dst, amount, ts)."""
    spark.createDataFrame([(i, i % 3) for i in range(n)], "c_custkey long, c_nationkey long").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(i, s, "x") for i, (s, *_) in enumerate(moved)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    lines = [(i, 1, n + d, 0, a, t, "R") for i, (_, d, a, t) in enumerate(moved)]
    schema = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{folder}/lineitem.parquet")


def brute_cycles(pairs, longest=None):
    """Cycles from their least account, the least of those with the same accounts."""
    out, best = {}, {}
    for s, d in pairs:
        out.setdefault(s, set()).add(d)

    def walk(way):
        for d in out.get(way[-1], ()):
            if d == way[0] and len(way) > 1:
                best[frozenset(way)] = min(best.get(frozenset(way), way), way)
            elif d > way[0] and d not in way and (longest is None or len(way) < longest):
                walk((*way, d))

    for s in out:
        walk((s,))
    return set(best.values())


def test_same_tax_number_takes_every_customer(spark, tmp_path):
    keys = [0, 1, 2, 3, 400, 401, 402, 801, 1203]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted((r.entity_a, r.entity_b) for r in networks.related(spark, str(tmp_path)).collect())
    assert got == [(a, b) for a in keys for b in keys if a < b and a % 400 == b % 400]


def test_long_cycles_take_every_pair_whatever_it_moved(spark, tmp_path):
    rng, n, day = random.Random(4), 9, dt.datetime(2024, 1, 1)
    moved = [(rng.randrange(n), rng.randrange(n), rng.choice([100_000.0, 94_999.0, 0.01, 0.0, -5.0, None]), day) for _ in range(30)]
    orders_tables(spark, tmp_path, n, moved)
    ways = brute_cycles({(s, d) for s, d, *_ in moved}, 5)
    got = sorted((r.length, r.cycle) for r in queries.more_cycles(spark, str(tmp_path)).collect())
    assert got == sorted((len(way), ">".join(map(str, way))) for way in ways) and {k for k, _ in got} == {2, 3, 4, 5}


def test_every_cycle_equals_brute_force(spark):
    rng, graphs = random.Random(7), []
    for n, m in [(6, 8), (7, 14), (8, 12), (9, 11), (9, 13), (10, 14), (12, 15), (5, 20)] * 2:
        graphs.append({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    graphs += [{(i, (i + 1) % 40) for i in range(40)}, {(0, 1), (1, 0)}, {(0, 1), (1, 2)}, {(3, 1), (1, 2), (2, 3), (3, 0), (0, 2)}]
    graphs.append({(9, 5), (5, 8), (8, 9), (8, 1), (1, 2), (2, 3), (3, 8), (3, 4), (4, 9)})  # the least account lies between two others
    rows = [(k, s, d) for k, g in enumerate(graphs) for s, d in g if s != d]
    got = [(r.slice, tuple(r.nodes)) for r in parts.every_cycle(spark.createDataFrame(rows, "slice int, src long, dst long"), ("slice",)).collect()]
    assert sorted(got) == sorted((k, way) for k, g in enumerate(graphs) for way in brute_cycles(g))
    one = spark.createDataFrame([(f"n{s}", f"n{d}") for s, d in graphs[1] if s != d], "src string, dst string")
    assert {tuple(r.nodes) for r in parts.every_cycle(one).collect()} == {tuple(f"n{x}" for x in way) for way in brute_cycles(graphs[1])}
    assert parts.every_cycle(one.limit(0)).collect() == []


def test_part_round_trips_have_no_longest_cycle_and_no_largest_part(spark, tmp_path):
    at = lambda month, k=0: dt.datetime(2024, month, 1) + dt.timedelta(hours=k)
    n = 501
    star = [leg for i in range(1, n) for leg in ((0, i, 4.0, at(2)), (i, 0, 3.0, at(2, 6)))]
    small = [(i, (i + 1) % 13, 1.0, at(3)) for i in range(13)] + [(20, 21, -5.0, at(3)), (21, 20, None, at(3)), (21, 20, 1.0, at(3))]
    orders_tables(spark, tmp_path, n, star + small)
    got = {(r.month, r.cycle): r for r in part_plans.part_round_trips(spark, str(tmp_path)).collect()}
    row = lambda month, *way: tuple(got[month, ">".join(map(str, way))])[2:]
    assert len(got) == 500 + 2
    assert all(row("2024-02", 0, i) == (2, 2, 7.0, 6.0, 0.75, 0.300006, "MEDIUM") for i in range(1, n))
    assert row("2024-03", *range(13)) == (13, 13, 13.0, 0.0, 1.0, 0.700011, "CRITICAL")
    assert row("2024-03", 20, 21) == (2, 3, -4.0, 0.0, -0.2, 0.299997, "MEDIUM")
