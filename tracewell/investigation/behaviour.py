"""How an account behaves: months by kind, waking after a long rest, and a higher rate of late.

No account's history is sorted: transfers are first counted by account and day, windows go over those days, and only the
days that a mark in time cuts through are looked at row by row. So an account with a third of all transfers costs
as many rows as it has days.

Defined cases: a transfer to oneself counts once, and as money in and out; rows without a time are left out;
equal times are one moment; accounts with fewer than two transfers have rates of 0 and no ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut, few

DAY = 86_400_000_000
#: What a behaviour bundle names as not computed.
DEFERRED = ["salary_mismatch", "seasonal_trends"]


def _own_rows(txn: DataFrame, transfer: Column) -> DataFrame:
    """account, t (microseconds), day, month, came, went, channel, transfer: a row for each transfer and account that takes part in it."""
    me = lambda who, came, went: F.struct(F.col(who).alias("account"), came.alias("came"), went.alias("went"))
    none, amount = F.lit(None).cast("double"), F.col("amount")
    itself = F.col("src").eqNullSafe(F.col("dst"))
    sides = F.when(itself, F.array(me("src", amount, amount))).otherwise(F.array(me("src", none, amount), me("dst", amount, none)))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = txn.select(F.explode(sides).alias("s"), "amount", t.alias("t"), F.date_format("ts", "yyyy-MM").alias("month"), "channel", transfer.alias("transfer"))
    rows = rows.where("s.account IS NOT NULL AND t IS NOT NULL")
    return rows.select("s.account", "s.came", "s.went", "amount", "t", F.floor(F.col("t") / F.lit(DAY)).alias("day"), "month", "channel", "transfer")


def monthly_trends(txn: DataFrame, cash: str = "branch_cash", transfer: Column | None = None) -> DataFrame:
    """account, month, n, total_in, total_out, total, n_cash, cash_in, n_transfers, transfers, in one grouping.

    cash: the channel whose incoming transfers are cash deposits. transfer: the condition of what counts as a transfer; all do without it.
    """
    rows = _own_rows(txn, F.lit(True) if transfer is None else F.coalesce(transfer, F.lit(False)))
    is_cash = F.col("came").isNotNull() & F.coalesce(F.col("channel") == cash, F.lit(False))
    money = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    months = rows.groupBy("account", "month").agg(
        F.count("*").alias("n"), money(F.col("came")).alias("total_in"), money(F.col("went")).alias("total_out"),
        F.count_if(is_cash).alias("n_cash"), money(F.when(is_cash, F.col("came"))).alias("cash_in"),
        F.count_if("transfer").alias("n_transfers"), money(F.when(F.col("transfer"), F.col("amount"))).alias("transfers"),
    )
    return months.select("account", "month", "n", "total_in", "total_out", F.round(F.col("total_in") + F.col("total_out"), 2).alias("total"), "n_cash", "cash_in", "n_transfers", "transfers")


def _days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("account", "day").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def _read_upto(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """account, mark, part: how many of an account's rows lie on the day of its mark (account, mark), at the mark or before."""
    marks = marks.select("account", "mark", F.floor(F.col("mark") / F.lit(DAY)).alias("mark_day"))
    part = rows.select("account", "t", F.col("day").alias("mark_day")).join(few(marks), ["account", "mark_day"]).where("t <= mark")
    return part.groupBy("account", "mark").agg(F.count("*").alias("part"))


def _with_parts(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """marked (account, mark, upto, split) with what a day that a mark splits adds to upto; rows are read only if a day is split."""
    marked = cut(marked)
    split = marked.where("split")
    if split.isEmpty():
        return marked.drop("split")
    parts = _read_upto(rows, split)
    return marked.join(parts, ["account", "mark"], "left").withColumn("upto", F.col("upto") + F.coalesce("part", F.lit(0))).drop("split", "part")


def reactivations(txn: DataFrame, gap_days: int = 90, burst_days: int = 7, burst_min: int = 3) -> DataFrame:
    """account, gap_start, gap_end (microseconds), gap_days, burst: rests of gap_days at least with burst_min transfers within burst_days of their end.

    One window over an account's days tells the rest before a day, the transfers of the days that the burst covers whole, and the
    first and last moment of the day that its end, burst_days later to the microsecond, falls on.
    """
    if gap_days < 1:
        raise ValueError("a gap has a day at least")
    if burst_days < 0:
        raise ValueError("a burst doesn't end before it begins")
    rows = _own_rows(txn, F.lit(True))
    by_day = Window.partitionBy("account").orderBy("day")  # a row for each day of an account, whatever the number of its transfers
    that = by_day.rangeBetween(burst_days, burst_days)
    whole = F.sum("n").over(by_day.rangeBetween(0, burst_days - 1)) if burst_days else F.lit(0)
    # a gap of a day and more lies between two of its days, so its ends are the last of one and the first of the next
    gaps = _days(rows).select(
        "account", F.col("first").alias("gap_end"), F.lag("last").over(by_day).alias("gap_start"), whole.alias("whole"),
        F.coalesce(F.sum("n").over(that), F.lit(0)).alias("k"), F.min("first").over(that).alias("from"), F.max("last").over(that).alias("to"),
    )
    gaps = gaps.where((F.col("gap_end") - F.col("gap_start") >= gap_days * DAY) & (F.col("whole") + F.col("k") >= burst_min))
    gaps = gaps.withColumn("mark", F.col("gap_end") + burst_days * DAY)
    upto = F.col("whole") + F.when(F.col("to") <= F.col("mark"), F.col("k")).otherwise(0)
    split = F.coalesce((F.col("from") <= F.col("mark")) & (F.col("to") > F.col("mark")), F.lit(False))
    found = _with_parts(rows, gaps.select("account", "gap_start", "gap_end", "mark", upto.alias("upto"), split.alias("split"))).withColumnRenamed("upto", "burst")
    rest = F.floor((F.col("gap_end") - F.col("gap_start")) / F.lit(DAY)).alias("gap_days")
    return found.where(F.col("burst") >= burst_min).select("account", "gap_start", "gap_end", rest, "burst")


def velocity(txn: DataFrame, recent_weeks: int = 4, threshold: float = 2.0) -> DataFrame:
    """account, recent, baseline, ratio, increased: weekly transfers of the weeks up to an account's latest one against those before."""
    if recent_weeks < 1:
        raise ValueError("a week at least")
    rows = _own_rows(txn, F.lit(True))
    days = _days(rows)
    ends = days.groupBy("account").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    ends = ends.withColumn("mark", F.col("last") - recent_weeks * 7 * DAY)
    day = F.floor(F.col("mark") / F.lit(DAY))
    on_it = F.col("day") == day
    before = F.when((F.col("day") < day) | (on_it & (F.col("day_last") <= F.col("mark"))), F.col("k"))
    split = on_it & (F.col("day_first") <= F.col("mark")) & (F.col("day_last") > F.col("mark"))
    each = days.select("account", "day", F.col("n").alias("k"), F.col("first").alias("day_first"), F.col("last").alias("day_last"))
    whole = ends.join(each, "account").groupBy("account", "n", "first", "mark").agg(F.coalesce(F.sum(before), F.lit(0)).alias("upto"), F.max(split).alias("split"))
    joined = _with_parts(rows, whole)
    weeks = F.greatest(F.floor((F.col("mark") - F.col("first")) / F.lit(DAY)), F.lit(1)) / 7.0
    several = F.col("n") >= 2
    recent = F.when(several, (F.col("n") - F.col("upto")) / recent_weeks).otherwise(0.0)
    baseline = F.when(several & (F.col("upto") > 0), F.col("upto") / weeks).otherwise(0.0)
    ratio = F.when(F.col("baseline") > 0, F.col("recent") / F.col("baseline"))
    rates = joined.select("account", recent.alias("recent"), baseline.alias("baseline")).withColumn("ratio", ratio)
    return rates.withColumn("increased", F.coalesce(F.col("ratio") >= threshold, F.lit(False)))


def bundle(txn: DataFrame, scope: DataFrame, cash: str = "branch_cash", transfer: Column | None = None, gap_days: int = 90, burst_days: int = 7, burst_min: int = 3) -> DataFrame:
    """One row for each account of the scope (account) that has transfers: months, reactivated, events, the rates of velocity, deferred.

    Transfers that don't touch the scope are left out before anything is counted.
    """
    inside = scope.select("account").where("account IS NOT NULL").distinct()
    months = monthly_trends(txn, cash, transfer).join(inside, "account", "left_semi")
    months = months.groupBy("account").agg(F.array_sort(F.collect_list(F.struct(*[c for c in months.columns if c != "account"]))).alias("months"))  # bounded by months
    events = reactivations(txn, gap_days, burst_days, burst_min).join(inside, "account", "left_semi")
    events = events.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("gap_start", "gap_end", "gap_days", "burst"))).alias("events"))  # bounded by days
    rows = months.join(events, "account", "left").join(velocity(txn), "account")
    return rows.select(
        "account", "months", F.col("events").isNotNull().alias("reactivated"), F.coalesce("events", F.array().cast(events.schema["events"].dataType)).alias("events"),
        "recent", "baseline", "ratio", "increased", F.array(*map(F.lit, DEFERRED)).alias("deferred"),
    )
