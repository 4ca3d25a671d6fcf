"""Per-account state in a stream: what each account did on each day, kept until the watermark has passed the day, and its alerts.

A state is a few numbers and the first distinct counterparties, as many as any level asks for, so its size doesn't grow with an account's
transfers. A timer at the end of each day gives the day out and drops its state; rows count until then in whatever order they come, and a
query that is stopped goes on from its checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.sources.ledgers import sides_in_one_scan
from tracewell.streaming import light
from tracewell.streaming.alerts import deduplicated

#: Distinct counterparties that are told apart: no risk or level changes beyond.
TOLD_APART = 20
#: Amounts are summed in hundredths of a cent, so that sums don't depend on their order.
UNITS = 10_000
TOTALS = "account long, day date, n_out long, n_timed long, n_band long, first_us long, last_us long, sent long, received long, to_others long, from_others long"
STATE = "n_out long, n_timed long, n_band long, first_us long, last_us long, sent long, received long, outs array<long>, ins array<long>"


def _fold(state: tuple, rows: pd.DataFrame, lower: float, upper: float) -> tuple:
    """The state after more sides of transfers."""
    n_out, n_timed, n_band, first, last, sent, received, outs, ins = state
    out = rows[rows["direction"] == "out"]
    n_out, n_timed = n_out + len(out), n_timed + int(out["t"].notna().sum())
    n_band += int(((out["amount"] >= lower) & (out["amount"] < upper)).sum())
    if len(out):
        first, last = min(first, int(out["t"].min())), max(last, int(out["t"].max()))
    units = (rows["amount"] * UNITS).round().fillna(0).astype("int64")
    sent += int(units[rows["direction"] == "out"].sum())
    received += int(units[rows["direction"] == "in"].sum())
    more = lambda old, side: sorted({*old, *rows[rows["direction"] == side]["other"].dropna().astype("int64").tolist()})[:TOLD_APART]
    return n_out, n_timed, n_band, first, last, sent, received, more(outs, "out"), more(ins, "in")


def day_totals(stream: DataFrame, delay: str = "7 days", lower: float = 900_000, upper: float = 1_000_000) -> DataFrame:
    """One row for each account and day (TOTALS) when the watermark has passed the day; each txn_id counts once within the delay.

    The least TOLD_APART counterparties of each side are kept, so to_others and from_others are exact up to that number.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        account, day = key
        if state.hasTimedOut:
            n_out, n_timed, n_band, first, last, sent, received, outs, ins = state.get
            state.remove()
            yield pd.DataFrame([(account, day, n_out, n_timed, n_band, first if n_out else None, last if n_out else None, sent, received, len(outs), len(ins))], columns=[c.split()[0] for c in TOTALS.split(", ")])
            return
        now = tuple(state.get) if state.exists else (0, 0, 0, 2**62, -(2**62), 0, 0, [], [])
        for rows in frames:
            now = _fold(now, rows, lower, upper)
        state.update(now)
        end = dt.datetime.combine(day, dt.time(), dt.UTC) + dt.timedelta(days=1)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    sides = sides_in_one_scan(deduplicated(stream, delay)).where("account IS NOT NULL").select(
        "account", F.to_date("ts").alias("day"), "direction", "other", "amount", F.unix_micros("ts").alias("t"), "ts"
    )
    return sides.groupBy("account", "day").applyInPandasWithState(update, TOTALS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def totals_of(txn: DataFrame, lower: float = 900_000, upper: float = 1_000_000) -> DataFrame:
    """The rows of day_totals from a whole ledger."""
    rows = sides_in_one_scan(txn.dropDuplicates(["txn_id"])).where("account IS NOT NULL AND ts IS NOT NULL").withColumns({"day": F.to_date("ts"), "t": F.unix_micros("ts"), "u": F.round(F.col("amount") * UNITS).cast("long")})
    out, when = F.col("direction") == "out", lambda c, v: F.when(c, v)
    sums = rows.groupBy("account", "day").agg(
        F.count(when(out, 1)).alias("n_out"), F.count(when(out, F.col("t"))).alias("n_timed"), F.count(when(out & (F.col("amount") >= lower) & (F.col("amount") < upper), 1)).alias("n_band"),
        F.min(when(out, F.col("t"))).alias("first_us"), F.max(when(out, F.col("t"))).alias("last_us"),
        F.coalesce(F.sum(when(out, F.col("u"))), F.lit(0)).alias("sent"), F.coalesce(F.sum(when(~out, F.col("u"))), F.lit(0)).alias("received"),
    )
    pairs = rows.where("other IS NOT NULL").select("account", "day", "direction", "other").distinct().groupBy("account", "day")
    told = lambda d: F.least(F.count(when(F.col("direction") == d, 1)), F.lit(TOLD_APART).cast("long"))
    return sums.join(pairs.agg(told("out").alias("to_others"), told("in").alias("from_others")), ["account", "day"], "left").fillna(0, ["to_others", "from_others"])


def alerts_of(totals: DataFrame, accounts: DataFrame) -> DataFrame:
    """day and the light alerts of each day's totals: structuring, velocity, fans, pass-through, income (a join with the static accounts)."""
    day = F.col("day").cast("string")
    n = F.col("n_out")
    hours = F.when(F.col("n_timed") >= 2, F.greatest((F.col("last_us") - F.col("first_us")) / 3_600_000_000, F.lit(1.0))).otherwise(24.0)
    ratio = F.col("sent") / F.col("received")
    to, frm = F.col("to_others"), F.col("from_others")
    high = lambda c, level="HIGH", other="MEDIUM": F.when(c, level).otherwise(other)
    patterns = [
        ("structuring", F.col("n_band") >= 3, F.least(F.lit(85.0), 50.0 + F.col("n_band") * 5), high(F.col("n_band") >= 5)),
        ("velocity_spike", (n >= 20) & (n / hours >= 5), F.least(F.lit(90.0), 40.0 + n * 2), high(n >= 50)),
        ("fan_out", to >= 10, F.least(F.lit(80.0), 45.0 + to * 3), high(to >= 20)),
        ("fan_in", frm >= 3, F.least(F.lit(85.0), 50.0 + frm * 5), high(frm >= 5)),
        ("mule_suspect", (F.col("received") > 100_000 * UNITS) & (ratio >= 0.8), F.least(F.lit(95.0), 60.0 + ratio * 30), high(ratio >= 0.95, "CRITICAL", "HIGH")),
    ]
    found = [light.named_alerts(totals.where(when), name, day, risk, level, "day") for name, when, risk, level in patterns]
    income = totals.join(accounts.where("declared_income > 0").select("account", "declared_income"), "account").withColumn("r", F.col("received") / UNITS / F.col("declared_income"))
    level = F.when(F.col("r") > 50, "CRITICAL").when(F.col("r") > 20, "HIGH").otherwise("MEDIUM")
    found.append(light.named_alerts(income.where("r > 10"), "profile_mismatch", day, F.least(F.lit(95.0), 55.0 + F.least("r", F.lit(40.0))), level, "day"))
    return reduce(DataFrame.unionByName, found)


def run_days(stream: DataFrame, accounts: DataFrame, out: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Write the alerts of each day that the watermark passes, under the number of the batch in which it does.

    A batch that is run again after a failure overwrites its own folder, so alerts are there exactly once.
    """

    def write(totals: DataFrame, number: int) -> None:
        alerts_of(totals, accounts).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return day_totals(stream, delay).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
