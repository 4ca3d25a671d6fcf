"""Set operations between ledgers and runs: who is new, who came back, which alerts are stale, what is searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def continuation(before: DataFrame, after: DataFrame) -> DataFrame:
    """account, state: returning, new or left, from the senders of two spans of time."""
    a, b = before.select(F.col("src").alias("account")).distinct(), after.select(F.col("src").alias("account")).distinct()
    both = a.withColumn("old", F.lit(True)).join(b.withColumn("now", F.lit(True)), "account", "full")
    state = F.when(F.col("old") & F.col("now"), "returning").when(F.col("now"), "new").otherwise("left")
    return both.select("account", state.alias("state"))


def keep_last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; order has to be total."""
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")


def complement(all_accounts: DataFrame, matched: DataFrame) -> DataFrame:
    return all_accounts.select("account").distinct().join(matched.select("account"), "account", "left_anti")


def alert_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """alert_id, state, first_day, last_day: new, active again or stale; an alert seen again keeps its first day."""
    both = old.withColumnsRenamed({"first_day": "o_first", "last_day": "o_last"}).join(new.withColumnRenamed("day", "n_day"), "alert_id", "full")
    state = F.when(F.col("o_first").isNull(), "new").when(F.col("n_day").isNull(), "stale").otherwise("active")
    return both.select("alert_id", state.alias("state"), F.coalesce("o_first", "n_day").alias("first_day"), F.greatest("o_last", "n_day").alias("last_day"))


def search(txn: DataFrame, where: Column, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a filtered ledger; the order has to be total, so that pages don't overlap."""
    return txn.where(where).orderBy(*order).offset(offset).limit(limit)


def touching(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers with either side in a scope of accounts, each once; two semi-joins instead of a join on OR."""
    out = txn.join(accounts.select(F.col("account").alias("src")), "src", "left_semi")
    rest = txn.join(accounts.select(F.col("account").alias("dst")), "dst", "left_semi")
    return out.unionByName(rest.join(accounts.select(F.col("account").alias("src")), "src", "left_anti"))
