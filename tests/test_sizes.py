"""What a step reads, shuffles and deals out, where results alone don't tell."""

import datetime as dt
import itertools

from tracewell.investigation import behaviour, networks
from tracewell.operators import features, graph, parts, scoring, sharing, walks
from tracewell.plans import parts as part_plans

LEDGER = "txn_id long, src long, dst long, amount double, ts timestamp, channel string, from_bank int, to_bank long, is_laundering int"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_shuffle_both_sides_twice_and_nothing_after(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(features, "cut", lambda df: seen.append(df) or df)
    who = spark.createDataFrame([(1, 5.0)], "account long, declared_income double")
    features.account_features(spark.createDataFrame([], LEDGER), who, 1, 2, 10)
    text = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert text.count("Exchange hashpartitioning(account") + text.count("RepartitionByExpression") == 2
    physical = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 2


def test_receivers_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharing, "PAIRS", 2)
    edges = {(s, d) for s in range(12) for d in range(9) if (s * 7 + d * 5) % 3}
    want = {}
    for x, y in itertools.combinations(range(9), 2):
        both = [s for s in range(12) if (s, x) in edges and (s, y) in edges]
        if len(both) >= 5:
            want[x, y] = both
    frame = spark.createDataFrame(sorted(edges), "s int, d int")
    assert want and {(r.d1, r.d2): r.shared for r in sharing.pairs_sharing(frame, 5).collect()} == want
    assert {(r.d1, r.d2): r.shared for r in sharing.pairs_sharing(frame, 5, heavy=5).collect()} == want


def test_legs_of_a_cycle_are_compared_before_the_leg_between(spark):
    rows = [(1, 1, 2, 100.0), (2, 2, 3, 7.0), (3, 3, 1, 90.0), (4, 1, 4, 100.0), (5, 4, 3, 1.0), (6, 5, 6, 9.0), (7, 6, 5, 8.0), (8, 2, 1, 10.0)]
    txn = spark.createDataFrame(rows, "txn_id long, src long, dst long, amount double")
    got = graph.short_cycles(txn, 0.85)
    assert {tuple(r) for r in got.collect()} == {(3, 1, 2, 3, 0.9), (3, 1, 4, 3, 0.9), (2, 5, 6, None, 0.888889)}
    joins = [line for line in plan(got).splitlines() if "Join Inner" in line]
    assert any("0.85" in line and "s1" in line and "d3" in line for line in joins), joins


def test_customers_of_one_number_meet_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(networks, "PAIRS", 50)
    who = spark.range(40).selectExpr("id AS customer_id", "CAST(NULL AS string) AS name", "IF(id < 30, 'a', 'b') AS tax_id")
    found = networks.related_customers(who, b"k").where("attribute = 'tax_id'")
    assert sorted((r.entity_a, r.entity_b) for r in found.collect()) == sorted([*itertools.combinations(range(30), 2), *itertools.combinations(range(30, 40), 2)])
    assert len([n for n in found.rdd.glom().map(len).collect() if n]) >= 8


def test_the_ensemble_reads_centralities_once(spark):
    read = spark.sparkContext.accumulator(0)
    central = spark.createDataFrame([(k, k / 10, k / 20) for k in range(8)], "account long, pagerank double, betweenness double")

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = spark.createDataFrame([(1, "layering")], "account long, kind string")
    assert scoring.ensemble(found, central.mapInArrow(count, central.schema)).count() == 8
    assert read.value == 8


def test_components_cut_no_table_larger_than_accounts(spark, monkeypatch):
    rows, real = [], walks.cut
    monkeypatch.setattr(walks, "cut", lambda df: rows.append(df.count()) or real(df))
    txn = spark.createDataFrame([(a, b) for a in range(40) for b in range(40)] + [(50, 60), (60, 50), (70, 60), (80, 80), (None, 1)], "src long, dst long")
    got = {r.account: r.component for r in walks.components(txn).collect()}
    assert got == {a: 0 for a in range(40)} | {50: 50, 60: 50, 70: 50, 80: 80}
    assert max(rows) <= 44


def test_reactivations_read_the_ledger_once_where_no_day_is_split(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(k)
    rows = [(1, 2, 5.0, day(k), "x") for k in (0, 100, 101, 107, 108)] + [(1, 3, 5.0, day(107) + dt.timedelta(hours=1), "x")]
    txn = spark.createDataFrame(rows, "src long, dst long, amount double, ts timestamp, channel string")
    whole = txn.where("dst = 2")
    found = behaviour.reactivations(whole.mapInArrow(count, whole.schema)).collect()
    assert read.value == 5 and sorted((r.account, r.gap_days, r.burst) for r in found) == [(1, 100, 3), (2, 100, 3)]
    # 107 and an hour lies after the burst's end of account 1, on the day that it falls on
    assert sorted((r.account, r.burst) for r in behaviour.reactivations(txn).collect()) == [(1, 3), (2, 3)]
    rates = behaviour.velocity(txn, 2).collect()
    assert {r.account: r.recent for r in rates} == {1: 2.5, 2: 2.0, 3: 0.0}


def test_strong_parts_cut_no_table_larger_than_accounts(spark, monkeypatch):
    rows, real = [], parts.cut
    monkeypatch.setattr(parts, "cut", lambda df: rows.append(df.count()) or real(df))
    edges = [(a, b) for a in range(40) for b in range(40)] + [(50, 60), (60, 50), (60, 70), (39, 50), (80, 80), (None, 1)]
    got = {tuple(r) for r in parts.strong_parts(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(a, 0, 40) for a in range(40)} | {(50, 50, 2), (60, 50, 2), (70, 70, 1), (80, 80, 1)}
    assert max(rows) <= 44


def test_part_round_trips_read_the_ledger_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(1, 2, 10.0, at(1, 0)), (2, 3, 9.0, at(1, 6)), (3, 1, 9.0, at(2, 0)), (1, 2, 2.0, at(1, 1)), (4, 5, 1.0, at(3, 0)), (4, 4, 7.0, at(3, 0)), (2, 1, 5.0, dt.datetime(2024, 2, 1))]
    txn = spark.createDataFrame(rows, "src long, dst long, amount double, ts timestamp")
    monkeypatch.setattr(part_plans, "orders_ledger", lambda *_: txn.mapInArrow(count, txn.schema))
    assert [tuple(r) for r in part_plans.part_round_trips(spark, "").collect()] == [("2024-01", "1>2>3", 3, 4, 30.0, 24.0, 0.75, 0.400024, "MEDIUM")]
    assert read.value == len(rows)
