import datetime as dt
import random

from tracewell.streaming import alerts, keyed, light

START = dt.datetime(2024, 1, 1)
INCOME = "account long, declared_income double"


def ledger(spark, seed=1, days=4, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        amount = rng.choice([10.25, 950_000.0, 120_000.5, 100_000.01, None])
        rows.append((i, rng.choice([1, 2, 3, 4, None]), rng.choice([1, 2, 3, *range(10, 40)]), amount, START + dt.timedelta(minutes=rng.randrange(days * 1440)), "x"))
    rows += [(n + i, 7, 100 + i, 5.0, START + dt.timedelta(seconds=i), "x") for i in range(70)]
    rows += rows[:30]  # sent twice
    rng.shuffle(rows)
    return rows


def test_stream_that_is_stopped_half_way_equals_batch(spark, tmp_path):
    rows = ledger(spark)
    who = spark.createDataFrame([(1, 1000.0), (12, 10.0), (2, 0.0)], INCOME)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))

    def arrive(part):
        spark.createDataFrame(part, alerts.LEDGER).coalesce(1).write.mode("append").parquet(folder)

    def run():
        keyed.run_days(alerts.read_ledger_stream(spark, folder), who, out, checkpoint).awaitTermination()

    arrive(rows[:200])
    arrive(rows[200:300])
    run()
    assert spark.read.schema("alert_id string").parquet(out).count() == 0  # no day has passed yet
    arrive(rows[300:])
    far = START + dt.timedelta(days=30)
    arrive([(10**6, None, None, None, far, "x")])
    arrive([(10**6 + 1, None, None, None, far + dt.timedelta(days=1), "x")])
    run()
    got = {tuple(r) for r in spark.read.parquet(out).select("alert_id", "account", "pattern", "risk", "level").collect()}
    txn = spark.createDataFrame(rows, alerts.LEDGER)
    assert got == {tuple(r) for r in keyed.alerts_of(keyed.totals_of(txn), who).drop("day").collect()}

    # the light detectors of each day's rows say the same
    whole = txn.dropDuplicates(["txn_id"]).cache()
    want = set()
    for day in range(4):
        of = whole.where(f"to_date(ts) = date '2024-01-0{1 + day}'")
        name = f"2024-01-0{1 + day}"
        for found in (light.structuring(of, name), light.velocity_spike(of, name), light.fan(of, name, "out", 10), light.fan(of, name, "in", 3), light.pass_through(of, name), light.income(of, who, name)):
            want |= {tuple(r) for r in found.collect()}
    close = lambda x: {(a, b, c, d) for a, b, c, _, d in x}
    assert {r[2] for r in want} == {"structuring", "velocity_spike", "fan_out", "fan_in", "mule_suspect", "profile_mismatch"}
    assert close(got) == close(want)
