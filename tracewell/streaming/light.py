"""Light detectors for micro-batches and days of a ledger: one grouping each, so they also run in foreachBatch.

All return alert_id, account, pattern, risk, level; an id repeats for the same account, pattern and day, so an alert that fires again
is the same alert. Nulls in a side or an amount count for nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources.ledgers import sides_in_one_scan


def named_alerts(rows: DataFrame, pattern: str, day: Column, risk: Column, level: Column, *more: str) -> DataFrame:
    """Alerts of one pattern with their ids, and more columns of rows."""
    key = F.concat_ws("-", F.col("account").cast("string"), F.lit(pattern), day)
    ident = F.concat(F.lit("ALT-"), F.upper(F.substring(F.sha2(key, 256), 1, 12)))
    return rows.where("account IS NOT NULL").select(ident.alias("alert_id"), "account", F.lit(pattern).alias("pattern"), F.round(risk.cast("double"), 1).alias("risk"), level.alias("level"), *more)


def _alerts(rows: DataFrame, pattern: str, day: str, risk: Column, level: Column) -> DataFrame:
    return named_alerts(rows, pattern, F.lit(day), risk, level)


def structuring(txn: DataFrame, day: str, lower: float = 900_000, upper: float = 1_000_000) -> DataFrame:
    hits = txn.where((F.col("amount") >= lower) & (F.col("amount") < upper)).groupBy(F.col("src").alias("account")).agg(F.count("*").alias("n")).where("n >= 3")
    return _alerts(hits, "structuring", day, F.least(F.lit(85.0), 50.0 + F.col("n") * 5), F.when(F.col("n") >= 5, "HIGH").otherwise("MEDIUM"))


def velocity_spike(txn: DataFrame, day: str, min_txns: int = 20, min_rate: float = 5.0) -> DataFrame:
    """Many transfers at a high hourly rate; a single known time counts as a day's span."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = txn.groupBy(F.col("src").alias("account")).agg(F.count("*").alias("n"), F.count("ts").alias("k"), ((F.max(t) - F.min(t)) / 3_600_000_000).alias("h")).where(F.col("n") >= min_txns)
    hours = F.when(F.col("k") >= 2, F.greatest(F.col("h"), F.lit(1.0))).otherwise(24.0)
    return _alerts(rows.where(F.col("n") / hours >= min_rate), "velocity_spike", day, F.least(F.lit(90.0), 40.0 + F.col("n") * 2), F.when(F.col("n") >= 50, "HIGH").otherwise("MEDIUM"))


def fan(txn: DataFrame, day: str, side: str, at_least: int) -> DataFrame:
    """Distinct counterparties of a side, counted after they are made distinct, so a hub is spread over its counterparties."""
    me, other = ("src", "dst") if side == "out" else ("dst", "src")
    rows = txn.where(F.col(other).isNotNull()).select(F.col(me).alias("account"), other).distinct().groupBy("account").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    risk, high = (F.least(F.lit(80.0), 45.0 + F.col("n") * 3), 20) if side == "out" else (F.least(F.lit(85.0), 50.0 + F.col("n") * 5), 5)
    return _alerts(rows, f"fan_{side}", day, risk, F.when(F.col("n") >= high, "HIGH").otherwise("MEDIUM"))


def income(txn: DataFrame, accounts: DataFrame, day: str, over: float = 10.0) -> DataFrame:
    """Inflow against declared income: in a stream, a join with a static table."""
    flow = txn.groupBy(F.col("dst").alias("account")).agg(F.sum("amount").alias("x"))
    rows = flow.join(accounts.where("declared_income > 0").select("account", "declared_income"), "account").withColumn("r", F.col("x") / F.col("declared_income"))
    level = F.when(F.col("r") > 50, "CRITICAL").when(F.col("r") > 20, "HIGH").otherwise("MEDIUM")
    return _alerts(rows.where(F.col("r") > over), "profile_mismatch", day, F.least(F.lit(95.0), 55.0 + F.least("r", F.lit(40.0))), level)


def pass_through(txn: DataFrame, day: str, min_in: float = 100_000, min_ratio: float = 0.8) -> DataFrame:
    money = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0.0))
    rows = sides_in_one_scan(txn).groupBy("account").agg(money("in").alias("i"), money("out").alias("o")).where((F.col("i") > min_in) & (F.col("o") > 0))
    rows = rows.withColumn("r", F.col("o") / F.col("i")).where(F.col("r") >= min_ratio)
    return _alerts(rows, "mule_suspect", day, F.least(F.lit(95.0), 60.0 + F.col("r") * 30), F.when(F.col("r") >= 0.95, "CRITICAL").otherwise("HIGH"))


def reciprocal(txn: DataFrame, day: str, hours: float = 48) -> DataFrame:
    """Accounts whose first transfer to another and that one's first back lie within some hours."""
    first = txn.groupBy("src", "dst").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    back = first.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("t").alias("u"))
    rows = first.join(back, ["src", "dst"]).where(F.coalesce(F.abs(F.col("u") - F.col("t")) <= hours * 3_600_000_000, F.lit(True)))
    return _alerts(rows.select(F.col("src").alias("account")).distinct(), "round_trip", day, F.lit(70.0), F.lit("HIGH"))


def tight_loops(txn: DataFrame, day: str, hours: float = 72, min_ratio: float = 0.85) -> DataFrame:
    """Loops of two and three accounts over the earliest transfer of each pair, within some hours, that return most of the money.

    A loop starts at its earliest leg, ties at the lesser account; of an account's loops the one of the greatest ratio counts.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = txn.where("src <> dst and ts is not null").groupBy("src", "dst").agg(F.min(F.struct(t.alias("t"), F.col("amount").alias("x"))).alias("f")).select("src", "dst", "f.t", "f.x")
    leg = lambda k: e.select(F.col("src").alias(f"s{k}"), F.col("dst").alias(f"d{k}"), F.col("t").alias(f"t{k}"), F.col("x").alias(f"x{k}"))
    a, b, c = leg(1), leg(2), leg(3)
    two = a.join(b, (F.col("d1") == F.col("s2")) & (F.col("d2") == F.col("s1"))).where(F.struct("t1", "s1") < F.struct("t2", "s2"))
    two = two.select(F.col("s1").alias("account"), F.lit(2).alias("n"), F.col("x1").alias("first"), F.col("x2").alias("last"), F.abs(F.col("t2") - F.col("t1")).alias("span"))
    three = a.join(b, F.col("d1") == F.col("s2")).where((F.col("d2") != F.col("s1")) & (F.abs(F.col("t2") - F.col("t1")) <= hours * 3_600_000_000))
    three = three.join(c, (F.col("d2") == F.col("s3")) & (F.col("d3") == F.col("s1"))).where((F.struct("t1", "s1") < F.struct("t2", "s2")) & (F.struct("t1", "s1") < F.struct("t3", "s3")))
    three = three.select(F.col("s1").alias("account"), F.lit(3).alias("n"), F.col("x1").alias("first"), F.col("x3").alias("last"), (F.greatest("t1", "t2", "t3") - F.least("t1", "t2", "t3")).alias("span"))
    rows = two.unionByName(three).where((F.col("first") > 0) & (F.col("span") <= hours * 3_600_000_000)).withColumn("r", F.col("last") / F.col("first")).where(F.col("r") >= min_ratio)
    best = rows.groupBy("account").agg(F.max("r").alias("r"), F.max("n").alias("n"))
    return _alerts(best, "round_trip", day, F.least(F.lit(95.0), 70.0 + F.col("r") * 20), F.when(F.col("n") >= 3, "CRITICAL").otherwise("HIGH"))


def detect(txn: DataFrame, accounts: DataFrame, day: str, small: bool = True) -> DataFrame:
    """All light alerts of a batch, each id once; a large batch has the plain round trip and no fan-in or income check."""
    found = [structuring(txn, day), velocity_spike(txn, day), fan(txn, day, "out", 10), pass_through(txn, day)]
    found += [tight_loops(txn, day), fan(txn, day, "in", 3), income(txn, accounts, day)] if small else [reciprocal(txn, day)]
    return reduce(lambda a, b: a.unionByName(b), found)


def lookback(history: DataFrame, today: DataFrame, known: DataFrame, days: int = 7) -> DataFrame:
    """What an incremental run looks at: today's transfers, and those of the last days that touch an account known before.

    A txn_id stands once, the latest row of it. The days are counted back from the first of today's transfers.
    """
    since = F.broadcast(today.agg((F.min("ts") - F.expr(f"INTERVAL {int(days)} DAYS")).alias("since")))
    seen = today.select(F.explode(F.array("src", "dst")).alias("account")).distinct().join(known.select("account"), "account", "left_semi")
    recent = history.join(since).where(F.col("ts") >= F.col("since")).drop("since")
    out = recent.join(seen.withColumnRenamed("account", "src"), "src", "left_semi")
    inn = recent.join(seen.withColumnRenamed("account", "dst"), "dst", "left_semi")
    both = out.unionByName(inn).withColumn("new__", F.lit(0)).unionByName(today.withColumn("new__", F.lit(1)))
    cols = [c for c in both.columns if c not in ("txn_id", "new__")]
    return both.groupBy("txn_id").agg(F.max_by(F.struct(*cols), F.struct("new__", "ts")).alias("r")).select("txn_id", "r.*")


def fresh_alerts(alerts: DataFrame, raised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts that weren't raised before, each id once; the table of raised ids with their last day moved on)."""
    once = alerts.dropDuplicates(["alert_id"])
    new = once.join(raised.select("alert_id"), "alert_id", "left_anti")
    return new, raised.select("alert_id").unionByName(new.select("alert_id"))
