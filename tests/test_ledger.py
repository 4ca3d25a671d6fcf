import datetime as dt
import json
import math
import os
import random
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell.operators import aggregates, detectors, features, graph, rules, sets, walks
from tracewell.sources import ledgers
from tracewell.streaming import alerts, light

SCHEMA = "txn_id long, src string, dst string, amount double, ts timestamp, channel string"


@pytest.fixture
def ledger(spark):
    def make(rows):
        start = dt.datetime(2024, 1, 1, 9)
        full = [(i, s, d, float(a), start + dt.timedelta(minutes=m), "UPI") for i, (s, d, a, m) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


DAY = 1440


def test_structuring(ledger):
    txn = ledger([("A", "B", 950e3, 0), ("A", "C", 960e3, DAY), ("A", "D", 970e3, 2 * DAY), ("E", "B", 950e3, 0), ("E", "C", 950e3, 5)])
    hit = detectors.amount_band_count(txn, 900e3, 1e6).collect()
    assert [(r.src, r.n, r.severity) for r in hit] == [("A", 3, "HIGH")]
    assert detectors.amount_band_count(txn, 900e3, 1e6, min_count=4).count() == 0
    split = detectors.split_sum(ledger([("A", x, 300e3, i) for i, x in enumerate("BCD")]), 900e3, 1e6).collect()
    assert [(r.src, r.n) for r in split] == [("A", 3)]


def test_dormancy(ledger):
    rows = [("A", "B", 1e3, 0), ("A", "B", 1e3, 10)] + [("A", "C", 50e3, 400 * DAY + 60 * i) for i in range(5)]
    run = lambda txn: {r.account: r for r in detectors.inactivity_then_burst(txn, 180 * 86400, 5, 10.0).collect()}
    hit = run(ledger(rows))
    assert set(hit) == {"A"} and hit["A"].ratio == 50.0 and hit["A"].n_after == 5 and hit["A"].severity == "CRITICAL"
    # a mean of 0 before the pause counts as the bound plus 1, but not from a single transfer
    assert run(ledger([("A", "B", 0, 0), ("A", "B", 0, 5), *rows[2:]]))["A"].ratio == 11.0
    assert run(ledger([("A", "B", 0, 0), *rows[2:]])) == {}
    assert run(ledger([("A", "B", 1e3, DAY * i) for i in range(8)])) == {}
    assert run(ledger(rows[:2] + [("A", "C", 5e3, 400 * DAY + i) for i in range(5)])) == {}


def test_cycles(ledger):
    got = graph.short_cycles(ledger([("A", "B", 100e3, 0), ("B", "C", 98e3, 10), ("C", "A", 95e3, 20)])).collect()
    assert [(r.length, r.n1, r.n2, r.n3, r.return_ratio) for r in got] == [(3, "A", "B", "C", 0.95)]
    assert graph.short_cycles(ledger([("A", "B", 1, 0), ("B", "C", 1, 1)])).count() == 0


def test_chain_by_next_hops(ledger):
    txn = ledger([("A", "B", 100e3, 0), ("B", "C", 80e3, 10), ("C", "D", 60e3, 20), ("B", "C", 5, 500)])
    assert {(r.txn_id, r.next_id) for r in graph.next_hops(txn, 7200).collect()} == {(0, 1), (1, 2)}
    paths = {(r.depth, r.reached) for r in graph.temporal_paths(txn, "A", 3).collect()}
    assert paths == {(1, "B"), (2, "C"), (3, "D")}
    back = {(r.depth, r.reached) for r in graph.temporal_paths(txn, "D", 3, forward=False).collect()}
    assert back == {(1, "C"), (2, "B"), (3, "A")}
    tied = ledger([("A", "B", 1, 0), ("B", "C", 1, 0)])  # equal times count
    assert {r.trail for r in graph.temporal_paths(tied, "A", 3).collect()} == {"0", "0>1"}


def test_fans(ledger):
    out = detectors.fan_degree(ledger([("H", x, 10, i) for i, x in enumerate("ABCDEF")]), 30, 3).collect()
    assert [(r.account, r.others, r.total, r.members, r.severity) for r in out] == [("H", 6, 60.0, "A,B,C,D,E,F", "HIGH")]
    inn = detectors.fan_degree(ledger([(x, "H", 10, i) for i, x in enumerate("ABCDEF")]), 30, 3, "in").collect()
    assert [(r.account, r.others) for r in inn] == [("H", 6)]
    pairs = graph.shared_senders(ledger([(s, d, 1, 0) for s in "ABC" for d in "XYZ"]), 3).collect()
    assert len(pairs) == 3 and all(r.shared == 3 for r in pairs)
    both = detectors.bipartite(ledger([(s, d, 1, 0) for s in "ABC" for d in "XYZ"]), 30, 3).collect()
    assert {(r.left, r.right, r.n_left, r.total, r.severity) for r in both} == {("A,B,C", "X,Y,Z", 3, 9.0, "HIGH")} and len(both) == 3


def test_windows_equal_brute_force(ledger):
    rng = random.Random(6)
    rows = [(rng.choice("HJ"), rng.choice("ABCDEFGH"), 1, rng.choice([0, 5, rng.randint(0, 4000)])) for _ in range(160)]
    minutes = 600
    want = {}
    for me in "HJ":
        best = max((len({d for s, d, _, t in rows if s == me and t0 <= t <= t0 + minutes}), -t0) for s0, _, _, t0 in rows if s0 == me)
        want[me] = (best[0], dt.datetime(2024, 1, 1, 9) + dt.timedelta(minutes=-best[1]))
    got = detectors.fan_degree(ledger(rows), minutes / 1440, 2).collect()
    assert {r.account: (r.others, r.starts) for r in got} == want


def test_profile(spark, ledger):
    schema = "account string, declared_income double, occupation string, city string, income_bracket string"
    accounts = spark.createDataFrame([("A", 100e3, "x", "y", "b"), ("B", 0.0, "x", "y", "b")], schema)
    hit = detectors.income_mismatch(ledger([("A", "B", 2.5e6, 0)]), accounts).collect()
    assert [(r.account, r.severity) for r in hit] == [("A", "HIGH")]
    peers = spark.createDataFrame([(c, 1.0, "x", "y", "b") for c in "ABCDEF"] + [("Z", 1.0, None, "y", "b"), ("Q", 1.0, "x", "y", "b")], schema)
    txn = ledger([(c, "Z", 10e3, 0) for c in "ABCDE"] + [("F", "Z", 5e6, 0)])
    found = detectors.peer_zscore(txn, peers, 1.5).collect()  # Q has no transfer and counts with volume 0
    assert [r.account for r in found] == ["F"] and abs(found[0].z - 2.2677) < 1e-3
    rows = [("A", "B", 1000 + i % 3, 60 * i) for i in range(20)] + [("A", "B", 500e3, 1300)]
    shift = detectors.behavioural_shift(ledger(rows), peers).collect()
    assert {(r.account, r.txn_id, r.severity) for r in shift} == {("A", 20, "MEDIUM"), ("B", 20, "MEDIUM")}
    text_ids = ledger(rows).withColumn("txn_id", F.concat(F.lit("t"), "txn_id"))
    assert {r.txn_id for r in detectors.behavioural_shift(text_ids, peers).collect()} == {"t20"}
    assert detectors.behavioural_shift(ledger(rows), accounts.where("account = 'B'")).collect() == []  # no declared income


def test_layering_and_round_trips(ledger):
    txn = ledger([("A", "B", 100e3, 0), ("B", "C", 90e3, 10), ("C", "D", 80e3, 20), ("D", "E", 95e3, 30)])
    found = detectors.layering(walks.grown_chains(txn, 7200, 3), walks.grown_chains(txn, 43_200 * 60, 4), 7200, 43_200 * 60).collect()
    assert [(r.path, r.hops, r.mode, r.severity) for r in found] == [("A>B>C>D>E", 4, "tight", "HIGH")] and abs(found[0].score - (2 / 3 * 0.4 + 0.3 + 0.05 * 0.3)) < 1e-6
    cycle = ledger([("A", "B", 100e3, 0), ("B", "C", 95e3, 10), ("C", "A", 90e3, 20), ("X", "Y", 1, 0), ("Y", "X", 0, 0)])
    trips = {r.cycle: r for r in detectors.round_trips(cycle, walks.cycle_nodes(cycle, 4)).collect()}
    assert set(trips) == {"A>B>C", "X>Y"} and trips["A>B>C"].severity == "CRITICAL" and trips["A>B>C"].return_ratio == 0.9 and trips["X>Y"].return_ratio == 0.0


def test_features_and_roles(spark, ledger):
    txn = ledger([("A", "B", 100e3, 0), ("B", "C", 50e3, 10), ("B", "A", 20e3, 20)]).withColumns({"from_bank": F.lit("x"), "to_bank": F.lit("y")})
    accounts = spark.createDataFrame([("A", 1.2e6), ("B", 0.6e6), ("C", 0.0)], "account string, declared_income double")
    f = {r.account: r for r in features.account_features(txn, accounts, 900e3, 1e6, 10_000).collect()}
    assert len(f["A"]) == 29 and f["C"].cross_bank_ratio == 0.5 and (f["A"].in_degree, f["A"].out_degree, f["B"].out_degree, f["B"].txn_count) == (1, 1, 2, 3)
    assert f["A"].net_flow == -80e3 and f["A"].round_number_ratio == 1.0 and not any(v != v for r in f.values() for v in r[1:])
    assert {r.account for r in graph.roles(txn).collect()} == {"A", "B", "C"}


def test_alerts_are_stable_and_diffed(spark):
    found = spark.createDataFrame([("A", "structuring", "d", 0.5), ("A", "structuring", "d", 0.7), ("B", "odd", "d", 0.1)], "account string, kind string, day string, score double")
    ids = {r.account: (r.alert_id, r.score) for r in features.alerts(found).collect()}
    assert len(ids) == 2 and ids["A"][1] == 0.7 and ids == {r.account: (r.alert_id, r.score) for r in features.alerts(found).collect()}
    old = spark.createDataFrame([("x", 1, 2), ("y", 1, 2)], "alert_id string, first_day int, last_day int")
    new = spark.createDataFrame([("y", 3), ("z", 3)], "alert_id string, day int")
    assert {tuple(r) for r in sets.alert_changes(old, new).collect()} == {("x", "stale", 1, 2), ("y", "active", 1, 3), ("z", "new", 3, 3)}


def test_rules(spark, ledger):
    txn = ledger([("A", "B", 950e3, i) for i in range(3)] + [("C", "D", 10, 0)])
    everyone = spark.createDataFrame([(c, 1.0, "o", "b") for c in "ABCD"], "account string, declared_income double, occupation string, income_bracket string")
    band = {"primitive": "amount_band_count"}
    of = lambda r: {x.account for x in rules.matches(r, txn, everyone).collect()}
    assert of(band) == {"A"} and of({"op": "NOT", "conditions": [band]}) == of(band | {"negate": True}) == {"B", "C", "D"}
    assert of({"op": "AND", "conditions": [band, {"op": "NOT", "conditions": [band]}]}) == set()
    big = {"primitive": "generic_group_aggregate", "params": {"group_by": "dest_account", "value": 5.0}}
    assert of({"op": "OR", "conditions": [band, big]}) == {"A", "B", "D"}
    bad = [{"primitive": "no"}, {"op": "XOR", "conditions": [band]}, {"conditions": []}, "x"]
    bad += [{"primitive": "amount_band_count", "params": p} for p in ({"min_count": True}, {"min_count": -1}, {"nothing": 1}, {"lower": "1"})]
    bad += [{"primitive": "fan_degree", "params": {"window_days": 1000}}, {"primitive": "fan_degree", "params": {"direction": "up"}}]
    for b in bad:
        with pytest.raises(rules.RuleError):
            rules.validate(b)
    rule = {"rule_id": "good", "detection_type": "structuring", "severity": "LOW", "conditions": [band]}
    both = rule | {"rule_id": "both", "combinator": "OR", "conditions": [band, {"primitive": "cycle", "negate": True}]}
    out, errors = rules.run_all([rule, {"rule_id": "bad", "detection_type": "x", "conditions": [{"primitive": "no"}]}, both, None], txn, everyone)
    got = {(r.rule_id, r.account_ids[0], r.score, r.severity) for r in out.collect()}
    assert ("good", "A", 0.435, "HIGH") in got and {r for r in got if r[0] == "both"} == {("both", "A", 0.435, "HIGH"), *(("both", c, 0.5, "LOW") for c in "BCD")}
    assert set(errors) == {"bad", "None"}
    report = rules.dry_run(rule, txn, everyone)
    assert report["matched_count"] == 1 and report["newly_flagged_accounts"] == ["A"] and report["sample_matches"][0]["severity"] == "HIGH"


def test_built_in_rules_find_their_patterns(spark, ledger):
    day = DAY
    rows = [("A", "B", 100e3, 0), ("B", "C", 98e3, 10), ("C", "A", 95e3, 20)]  # a round trip
    rows += [("S", f"r{i}", 950e3, i * day) for i in range(3)] + [("T", f"q{i}", 310e3, 5 + i) for i in range(3)]
    rows += [("K", "L", 100e3, 5000), ("L", "M", 90e3, 5010), ("M", "N", 80e3, 5020)]
    rows += [("D", "x", 10, 0), ("D", "x", 12, 9)] + [("D", "y", 9e3, 400 * day + i) for i in range(5)]
    rows += [("P", "z", 100 + i % 3, 7 * i) for i in range(25)] + [("P", "z", 50e3, 900)]
    txn = ledger(rows)
    who = [(a, 1000.0 if a == "S" else 1e9, "o", "b") for a in "ABCSTKLMNDP"]
    accounts = spark.createDataFrame(who, "account string, declared_income double, occupation string, income_bracket string")
    found, errors = rules.run_all(rules.BUILT_IN, txn, accounts)
    hit = {}
    for r in found.collect():
        hit.setdefault(r.rule_id.removeprefix("builtin_"), set()).update(r.account_ids)
    assert errors == {} and hit["round_trip"] == set("ABC") and {"K", "L", "M", "N"} <= hit["layering"] and hit["structuring_classic"] == {"S"}
    assert "T" in hit["structuring_split"] and hit["dormancy"] == {"D"} and hit["income_mismatch"] == {"S"} and "P" in hit["behavioural_shift"]


def test_raw_ledger(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
        "2024/01/01 10:00,1,A,2,B,5,USD,6.5,USD,Wire,0\n2024/01/01 10:00,1,A,2,B,5,USD,6.5,USD,Wire,0\n2024/01/01 10:00,1,A,2,B,5,USD,x,USD,Zzz,0\nbroken\n"
    )
    good, bad = ledgers.normalise_raw(ledgers.read_raw_csv(spark, str(path)))
    rows = good.collect()
    assert [(r.src, r.dst, r.amount, r.channel) for r in rows] == [("A", "B", 6.5, "RTGS")] * 2 and len({r.txn_id for r in rows}) == 2
    assert bad.count() == 2


def test_summaries(ledger):
    txn = ledger([("A", "B", 10, 0), ("A", "A", 5, 3 * DAY), ("B", "A", 1, 3 * DAY)])
    flow = {r.account: r for r in aggregates.account_flow(txn).collect()}
    assert (flow["A"].inflow, flow["A"].outflow, flow["A"].n, flow["A"].partners) == (6.0, 15.0, 4, 1)
    assert [r.n for r in aggregates.daily_counts(txn).orderBy("day").collect()] == [1, 0, 0, 2]
    assert aggregates.data_contract(txn).first().self_transfers == 1
    assert {(r.account, r.hops) for r in graph.hop_distances(txn, ["A"], 2).collect()} == {("A", 0), ("B", 1)}


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, 9, 95.0 if i % 2 else -1.0, dt.datetime(2024, 1, 1 + i % 4), "x") for i in range(40)]
    frame = spark.createDataFrame(rows, alerts.LEDGER)
    for k in range(3):
        frame.where(F.col("txn_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame.where("txn_id < 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # sent twice
    stream = alerts.deduplicated(alerts.read_ledger_stream(spark, str(tmp_path / "in")))
    alerts.run_batches(stream, str(tmp_path / "out"), str(tmp_path / "c1"), lambda b: b).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/alerts")).count() == 20
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 20
    hits = alerts.windowed_bands(alerts.read_ledger_stream(spark, str(tmp_path / "in")), 90, 100)
    query = hits.writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination()
    want = alerts.windowed_bands(spark.read.parquet(str(tmp_path / "in")), 90, 100)
    assert sorted(map(tuple, spark.table("hits").collect())) == sorted(map(tuple, want.collect()))


def test_light_detectors_in_batches_raise_an_alert_once(spark, tmp_path):
    rows = [(i, 1, 10 + i, 950_000.0, dt.datetime(2024, 1, 1, i), "x") for i in range(4)]
    rows += [(9, 1, 99, 950_000.0, dt.datetime(2024, 1, 2), "x"), (10, 77, 1, 500_000.0, dt.datetime(2024, 1, 2), "x")]
    frame = spark.createDataFrame(rows, alerts.LEDGER)
    frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    who = spark.createDataFrame([(1, 1000.0)], "account long, declared_income double")
    detect = lambda batch: light.detect(batch, who, "2024-01-02")
    alerts.run_batches(alerts.read_ledger_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), detect).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out/alerts")).drop("batch")
    assert {(r.account, r.pattern, r.risk, r.level) for r in found.collect()} == {(1, "structuring", 75.0, "HIGH"), (1, "profile_mismatch", 95.0, "CRITICAL"), (1, "mule_suspect", 95.0, "CRITICAL")}
    assert sorted(map(tuple, detect(frame).collect())) == sorted(map(tuple, found.collect()))
    new, raised = light.fresh_alerts(found.unionByName(found), found.where("pattern = 'structuring'").select("alert_id"))
    assert new.count() == 2 and raised.count() == 3 and light.fresh_alerts(found, raised)[0].count() == 0


@pytest.mark.parametrize("gone", [("tracewell/llm", "tests/llm"), ("tracewell/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_llm_folders(tmp_path, gone):
    """A copy of the tree without these folders is imported by a Python of its own."""
    root = Path(__file__).resolve().parents[1]
    left_out = lambda folder, names: [n for n in names if n.startswith(".") or n == "__pycache__" or str((Path(folder) / n).relative_to(root)) in gone]
    shutil.copytree(root, tmp_path / "copy", ignore=left_out)
    code = "import json, __spark_entry__ as e; print(json.dumps([e.__file__, sorted(e.queries()), sorted(e.oracle_sql())]))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={"PATH": os.environ["PATH"]}, capture_output=True, text=True, check=True)
    file, names, with_sql = json.loads(done.stdout.strip().splitlines()[-1])
    assert file.startswith(str(tmp_path)) and len(names) > 150 and set(with_sql) <= set(names)
    assert not [n for n in names if n == "pipeline" or re.match(r"op[0-9]+_", n)]


def test_similar_to_each(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0, 2.0])]
    rows += [(i, rows[3][1]) for i in (70, 80)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    def cosine(x, y):
        norm = math.sqrt(sum(a * a for a in x or [])) * math.sqrt(sum(b * b for b in y or []))
        return round(sum(a * b for a, b in zip(x, y, strict=True)) / norm, 4) if norm and len(x) == len(y) else 0.0

    want = {(q, v, c) for q, x in rows if q % 20 == 0 for c, v in sorted(((cosine(x, y), v) for v, y in rows if v != q), key=lambda p: (-p[0], p[1]))[:10]}
    for block in (7, 4096):
        got = [tuple(r) for r in features.similar_to_each(vectors.where("vec_id % 20 = 0"), vectors, block=block).collect()]
        assert len(got) == 50 and set(got) == want
    assert features.similar_to_each(vectors.limit(0), vectors).count() == 0
