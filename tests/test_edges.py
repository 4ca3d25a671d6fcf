"""Every ledger operator on an empty ledger, on zero amounts, null sides and tied times: defined results, no crash."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.investigation import desk, facts, networks
from tracewell.operators import aggregates, detectors, features, graph, rules, scoring, sets, walks
from tracewell.sources import ingest
from tracewell.streaming import light

SCHEMA = "txn_id long, src string, dst string, amount double, ts timestamp, channel string, from_bank string, to_bank string, is_laundering int"
T = dt.datetime(2024, 1, 1, 9)
ROWS = {
    "empty": [],
    "zeros": [(i, "AB"[i % 2], "BA"[i % 2], 0.0, T + dt.timedelta(minutes=i), "c", "x", "y", 0) for i in range(8)],
    "nulls": [(1, None, "B", 1.0, T, "c", None, "y", 0), (2, "A", None, 2.0, T, None, "x", None, 1), (3, "A", "B", None, None, "c", "x", "y", None), (None, "A", "A", 5.0, T, "c", "x", "x", 0)],
    "ties": [(i // 2, "A", "BC"[i % 2], 10.0, T, "c", "x", "y", 1) for i in range(8)] + [(9, "B", "A", 10.0, T, "c", "x", "y", 0)],
}
DAY = "2024-01-31"

OPERATORS = {
    "band": lambda t, a: detectors.amount_band_count(t, 1, 100), "split": lambda t, a: detectors.split_sum(t, 1, 100), "structuring": lambda t, a: detectors.structuring(t, 1, 100),
    "dormancy": lambda t, a: detectors.inactivity_then_burst(t, 60), "fan": lambda t, a: detectors.fan_degree(t, 30, 1), "fan_in": lambda t, a: detectors.fan_degree(t, 30, 1, "in"),
    "bipartite": lambda t, a: detectors.bipartite(t, 30, 2), "income": detectors.income_mismatch, "peers": detectors.peer_zscore, "shift": detectors.behavioural_shift,
    "aggregate": lambda t, a: detectors.group_aggregate(t, "src", "SUM", "amount", 7, 1), "bursts": lambda t, a: detectors.gap_then_burst(t, 60, "1 DAY"), "outlier": lambda t, a: detectors.first_outlier(t, flagged=a),
    "cycles": lambda t, a: detectors.round_trips(t, walks.cycle_nodes(t, 3)), "layering": lambda t, a: detectors.layering(walks.grown_chains(t, 60), walks.grown_chains(t, 600), 60, 600),
    "collapsed": lambda t, a: graph.collapsed(t), "centrality": lambda t, a: graph.centrality(t), "roles": lambda t, a: graph.roles(t), "short_cycles": lambda t, a: graph.short_cycles(t),
    "hops": lambda t, a: graph.hop_distances(t, ["A"], 2), "ego": lambda t, a: graph.ego_edges(t, ["A"], 1), "trail": lambda t, a: graph.temporal_paths(t, "A", 3), "next": lambda t, a: graph.next_hops(t, 60),
    "shared": lambda t, a: graph.shared_senders(t, 1), "summary": lambda t, a: graph.graph_summary(t), "neighbours": lambda t, a: graph.top_neighbours(t), "components": lambda t, a: walks.components(t),
    "walk": lambda t, a: walks.walk_with_restart(t, "A", rounds=2), "flow": lambda t, a: aggregates.account_flow(t), "months": lambda t, a: aggregates.monthly_totals(t), "share": lambda t, a: aggregates.money_flow_share(t),
    "velocity": lambda t, a: aggregates.recent_velocity(t), "calendar": lambda t, a: aggregates.daily_counts(t), "histogram": lambda t, a: aggregates.amount_histogram(t, 0, 10), "percentiles": lambda t, a: aggregates.amount_percentiles(t),
    "quality": lambda t, a: aggregates.ranking_quality(t.select(F.col("is_laundering").alias("label"), F.col("amount").alias("score")), 5), "contract": lambda t, a: aggregates.data_contract(t),
    "features": lambda t, a: features.account_features(t, a, 1, 2, 10), "labels": lambda t, a: scoring.labels(t), "temporal_split": lambda t, a: scoring.temporal_split(t), "keep_last": lambda t, a: sets.keep_last(t, "src", ["ts"]),
    "light": lambda t, a: light.detect(t, a, DAY), "light_large": lambda t, a: light.detect(t, a, DAY, False), "lookback": lambda t, a: light.lookback(t, t, a), "violations": lambda t, a: ingest.violations(t, ingest.ledger_checks()),
    "minted": ingest.minted_accounts, "profiles": lambda t, a: ingest.account_profiles(t), "diversity": lambda t, a: facts.bank_diversity(t), "exposure": facts.exposure, "upload": lambda t, a: facts.upload_summary(t),
    "mismatches": facts.mismatches, "customer": lambda t, a: facts.customer_profile(t, a, F.col("declared_income")), "window": lambda t, a: desk.account_window(t, "A", most_recent=True), "path_facts": lambda t, a: networks.path_facts(t, "A", a),
    "filtered_ego": lambda t, a: networks.filtered_ego(t, "A", 1)[1], "decorated": lambda t, a: desk.decorated(t, a, a), "subgraph": lambda t, a: networks.validation_subgraph(t, "A", a),
}


@pytest.fixture(scope="module")
def tables(spark):
    who = spark.createDataFrame([("A", 10.0, "o", "c", "b"), ("B", 0.0, None, None, None), (None, None, "o", "c", "b")], "account string, declared_income double, occupation string, city string, income_bracket string")
    return {n: spark.createDataFrame(r, SCHEMA) for n, r in ROWS.items()}, who


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_has_a_result(name, tables):
    ledgers, who = tables
    for kind, txn in ledgers.items():
        rows = OPERATORS[name](txn, who).collect()
        bad = [v for r in rows for v in r if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf")))]
        assert not bad, (kind, rows[:3])
        if kind == "empty" and name not in ("summary", "quality", "contract", "violations", "hops", "walk", "customer", "subgraph"):
            assert rows == [], rows[:3]


def test_chains_and_desk(spark):
    log, before = [], ""
    import hashlib

    for i in range(40):
        own = hashlib.sha256(f"{len(str(i))}:{i}1:x{len(before)}:{before}".encode()).hexdigest()
        log.append((i, "x", before, own))
        before = own
    frame = lambda rows: spark.createDataFrame(rows, "seq int, what string, prev_hash string, row_hash string").repartition(5)
    assert desk.broken_links(frame(log), ["seq", "what"]).collect() == []
    changed = [*log[:7], (7, "y", *log[7][2:]), *log[8:20], *log[21:]]
    assert {(r.seq, r.broken) for r in desk.broken_links(frame(changed), ["seq", "what"]).collect()} == {(7, "content"), (21, "link")}
    assert desk.assigned(["c1", "c2", "c3"], {"b": 1, "a": 1, "z": 0}) == [("c1", "z"), ("c2", "a"), ("c3", "b")]
    with pytest.raises(ValueError):
        desk.assigned(["c"], {})


def test_related_customers(spark):
    rows = [(1, "Anna Maria Smith", "ab1"), (2, "Anna Maria Smyth", " AB1 "), (3, "anna maria smith", None), (4, "Zed", ""), (5, None, "x")]
    got = {(r.entity_a, r.entity_b, r.attribute) for r in networks.related_customers(spark.createDataFrame(rows, "customer_id int, name string, tax_id string"), b"k").collect()}
    assert got == {(1, 2, "tax_id"), (1, 2, "name"), (1, 3, "name"), (2, 3, "name")}


def test_uploads(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("x,y\n1,2\n")
    assert ingest.check_upload(spark, str(good), ["x"]) == 1 and len(ingest.file_hash(str(good))) == 64
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe,y\n1,2\n")
    (tmp_path / "c.csv").write_text("x,y\n")
    (tmp_path / "d.txt").write_text("x,y\n1,2\n")
    for name, columns in (("a.csv", ["z"]), ("b.csv", []), ("c.csv", ["x"]), ("d.txt", ["x"])):
        with pytest.raises(ingest.IngestError):
            ingest.check_upload(spark, str(tmp_path / name), columns)
    assert ingest.sniff(["Payment Format", "Amount Paid"]) == "bank" and ingest.sniff(["sender", "payee", "sum", "date"]) == "generic"
    with pytest.raises(ingest.IngestError):
        ingest.sniff(["a", "b"])
    assert ingest.load_in_order("FAILED", lambda: None) == "ABORTED" and ingest.load_in_order("SKIPPED", lambda: 1 / 0) == "FAILED" and ingest.load_in_order("SUCCESS", lambda: None) == "SUCCESS"
    with pytest.raises(Exception, match="unreadable amount"):
        ingest.strict_amounts(spark.createDataFrame([(1, None)], "txn_id int, amount double")).collect()


def test_rule_confidence(spark):
    from tracewell.investigation.desk import learned_confidence

    rows = spark.createDataFrame([("r", 2, False), ("r", 1, True)], "rule string, seq int, good boolean")
    assert [(r.rule, r.n, r.confidence) for r in learned_confidence(rows).collect()] == [("r", 2, 0.495)]
    assert len(rules.BUILT_IN) == 8
