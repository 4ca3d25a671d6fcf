"""Summaries of a ledger: channels, months, flows, stretches of time, quality of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.quantiles import exact_quantiles
from tracewell.session import cut
from tracewell.sources.ledgers import sides_in_one_scan


def account_flow(txn: DataFrame) -> DataFrame:
    """Inflow, outflow, transfers and distinct counterparties (itself apart) of each account."""
    money = lambda d: F.round(F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0.0)), 2)
    return sides_in_one_scan(txn).groupBy("account").agg(
        money("in").alias("inflow"), money("out").alias("outflow"), F.count("*").alias("n"),
        F.countDistinct(F.when(F.col("other") != F.col("account"), F.col("other"))).alias("partners"),
    )


def channel_summary(txn: DataFrame) -> DataFrame:
    return txn.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.avg("amount"), 4).alias("mean"), F.max("amount").alias("most"))


def channel_hours(txn: DataFrame) -> DataFrame:
    return txn.groupBy("channel", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


def flow_between(txn: DataFrame, kinds: DataFrame, top: int = 50) -> DataFrame:
    """Largest flows by kind of sender, channel and kind of receiver; kinds: (account, kind)."""
    a, b = kinds.select(F.col("account").alias("src"), F.col("kind").alias("src_kind")), kinds.select(F.col("account").alias("dst"), F.col("kind").alias("dst_kind"))
    flows = txn.join(a, "src").join(b, "dst").groupBy("src_kind", "channel", "dst_kind").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))
    return flows.orderBy(F.desc("total"), "src_kind", "channel", "dst_kind").limit(top)


def monthly_totals(txn: DataFrame) -> DataFrame:
    out = F.col("direction") == "out"
    return sides_in_one_scan(txn).groupBy("account", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.round(F.sum(F.when(~out, F.col("amount")).otherwise(0.0)), 2).alias("inflow"), F.round(F.sum(F.when(out, F.col("amount")).otherwise(0.0)), 2).alias("outflow"), F.count("*").alias("n")
    )


def money_flow_share(txn: DataFrame) -> DataFrame:
    """Each counterparty's share of what an account sends; self-transfers apart."""
    pairs = txn.where("src <> dst").groupBy("src", "dst").agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("n"))
    whole = pairs.groupBy("src").agg(F.sum("total").alias("whole"))
    return pairs.join(whole, "src").select("src", "dst", "total", "n", F.round(F.try_divide(100 * F.col("total"), F.col("whole")), 4).alias("share"))


def recent_velocity(txn: DataFrame, weeks: int = 1, min_ratio: float = 1.2) -> DataFrame:
    """Weekly rate of the last weeks against that of the time before, per account."""
    rows = sides_in_one_scan(txn).withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    ends = rows.groupBy("account").agg(F.max("t").alias("last"), F.min("t").alias("first"))
    late = F.col("t") > F.col("last") - weeks * 604800
    counts = rows.join(ends, "account").groupBy("account", "first", "last").agg(F.sum(late.cast("int")).alias("n_recent"), F.sum((~late).cast("int")).alias("n_before"))
    span = F.greatest((F.col("last") - F.col("first")) / 604800.0 - weeks, F.lit(1.0))
    ratio = F.try_divide(F.col("n_recent") / weeks, F.col("n_before") / span)
    return counts.where(ratio >= min_ratio).select("account", "n_recent", "n_before", F.round(ratio, 6).alias("ratio"))


def bucket_counts(txn: DataFrame, minutes: int = 10) -> DataFrame:
    """Transfers in each stretch of minutes."""
    width = minutes * 60
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / width) * width
    return txn.groupBy(start.cast("long").alias("bucket_s")).agg(F.count("*").alias("n"))


def daily_counts(txn: DataFrame) -> DataFrame:
    """Transfers of each calendar day between the first and the last, days without any included."""
    days = txn.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    calendar = txn.agg(F.explode(F.sequence(F.min(F.to_date("ts")), F.max(F.to_date("ts")))).alias("day"))
    return calendar.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def amount_histogram(txn: DataFrame, low: float, high: float, bins: int = 10) -> DataFrame:
    cell = F.least(F.floor((F.col("amount") - low) / ((high - low) / bins)), F.lit(bins - 1))
    return txn.where(F.col("amount").between(low, high)).groupBy(cell.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def amount_percentiles(txn: DataFrame) -> DataFrame:
    """p50, p75 and p95 of each channel's amounts."""
    found = exact_quantiles(txn, "amount", {"p50": 0.5, "p75": 0.75, "p95": 0.95}, ("channel",))
    return found.select("channel", *(F.round(c, 6).alias(c) for c in ("p50", "p75", "p95")))


def counts_below(rows: DataFrame, order: str, count: str, name: str) -> DataFrame:
    """rows with the sum of `count` over all rows of a lesser `order`, by ranges of it: a window within each, one row a range above."""
    dealt = cut(rows.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("range").agg(F.sum(count).alias("m"))
    ranges = ranges.select("range", F.coalesce(F.sum("m").over(before(Window.orderBy("range"))), F.lit(0)).alias("earlier"))  # a row a partition
    within = F.coalesce(F.sum(count).over(before(Window.partitionBy("range").orderBy(order))), F.lit(0))
    return dealt.withColumn("within", within).join(F.broadcast(ranges), "range").withColumn(name, F.col("earlier") + F.col("within")).drop("range", "within", "earlier")


def ranking_quality(scored: DataFrame, threshold: float) -> DataFrame:
    """Confusion counts, precision, recall and rank AUC of (label, score)."""
    counts = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    ranked = counts_below(counts, "score", "n", "below")
    hit = F.col("score") >= threshold
    total = ranked.agg(
        F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("all"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
    )
    p, q = F.col("p"), F.col("all") - F.col("p")
    return total.select("tp", "fp", (p - F.col("tp")).alias("fn"), F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", p), 6).alias("recall"), F.round(F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * q), 6).alias("auc"))


def data_contract(txn: DataFrame) -> DataFrame:
    """One pass over a ledger: rows, nulls, negative and extreme amounts, self-transfers, repeated ids, mean."""
    n = lambda c: F.sum(c.cast("int"))
    checks = txn.agg(
        F.count("*").alias("rows"), n(F.col("amount").isNull()).alias("null_amounts"), n(F.col("amount") <= 0).alias("not_positive"), n(F.col("amount") > 1e12).alias("extreme"),
        n(F.col("src") == F.col("dst")).alias("self_transfers"), (F.count("*") - F.countDistinct("txn_id")).alias("repeated_ids"), F.round(F.avg("amount"), 4).alias("mean_amount"),
    )
    return checks.withColumn("passed", (F.col("null_amounts") * 200 <= F.col("rows")) & (F.col("not_positive") + F.col("extreme") + F.col("repeated_ids") == 0))
