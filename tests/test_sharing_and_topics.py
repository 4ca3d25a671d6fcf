import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.operators.sharing import pairs_sharing
from tracewell.streaming import alerts, topics


@pytest.mark.parametrize(("least", "heavy"), [(1, 4), (2, 5), (3, 8), (2, 1), (3, 1000)])
def test_pairs_equal_brute_force(spark, least, heavy):
    rng = random.Random(least * heavy)
    edges = {(f"s{rng.randrange(14)}", f"d{rng.randrange(18)}") for _ in range(110)} | {("s0", f"d{i}") for i in range(18)} | {("s1", f"d{i}") for i in range(0, 18, 2)}
    frame = spark.createDataFrame(sorted(edges), "s string, d string")
    senders = {}
    for s, d in edges:
        senders.setdefault(d, set()).add(s)
    want = {(a, b): sorted(senders[a] & senders[b]) for a, b in combinations(sorted(senders), 2) if len(senders[a] & senders[b]) >= least}
    got = {(r.d1, r.d2): r.shared for r in pairs_sharing(frame, least, heavy).collect()}
    assert got == want and want


def test_a_sender_of_100000_receivers(spark):
    star = spark.range(100_000).select(F.lit("hub").alias("src"), F.concat(F.lit("r"), "id").alias("dst"))
    some = spark.createDataFrame([(f"x{k}", f"r{i}") for k in range(2) for i in range(3)], "src string, dst string")
    got = graph.shared_senders(star.unionByName(some), 3).collect()
    assert {(r.dst, r.dst2, r.shared) for r in got} == {("r0", "r1", 3), ("r0", "r2", 3), ("r1", "r2", 3)}


def test_dead_letters_and_counts(spark, tmp_path):
    paths = {x: str(tmp_path / x) for x in ("in", "out", "dead", "good", "bad")}
    for k in range(4):
        rows = spark.range(10).select((F.col("id") + 10 * k).alias("txn_id"), F.lit(1).cast("long").alias("src"), F.lit(2).cast("long").alias("dst"), F.lit(1.0).alias("amount"), F.current_timestamp().alias("ts"), F.lit("x").alias("channel"))
        rows.coalesce(1).write.mode("append").parquet(paths["in"])

    def fails_once(batch):
        if batch.where("txn_id between 10 and 19").count():
            raise ValueError("no handler for these\nmore")
        return batch.select("txn_id")

    lazily = lambda batch: batch.select(F.when(F.col("txn_id") == 3, F.raise_error(F.lit("late"))).otherwise(F.col("txn_id")).alias("txn_id"))
    counts = topics.TopicCounts()
    spark.streams.addListener(counts)
    try:
        for name, handle in (("good", fails_once), ("bad", lazily)):
            topics.run_topic(name, alerts.read_ledger_stream(spark, paths["in"]), handle, paths["out"], paths["dead"], paths[name]).awaitTermination()
        until = time.time() + 30  # the last progress arrives a little later
        while time.time() < until and sum(c.rows for c in counts.topics.values()) < 80:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counts)
    dead = spark.read.parquet(paths["dead"]).collect()
    out = spark.read.parquet(paths["out"]).groupBy("topic").count().collect()
    assert {r.txn_id for r in dead if r.topic == "good"} == set(range(10, 20)) and {r.reason for r in dead if r.topic == "good"} == {"ValueError: no handler for these"}
    assert {r.txn_id for r in dead if r.topic == "bad"} == set(range(10)) and len(dead) == 20
    assert {r.topic: r["count"] for r in out} == {"good": 30, "bad": 30}
    assert {n: (c.rows, c.batches, c.error) for n, c in counts.topics.items()} == {"good": (40, 4, None), "bad": (40, 4, None)}
