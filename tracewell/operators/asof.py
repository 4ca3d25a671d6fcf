"""Forward as-of merges: transfers that arrive at an account, and those that leave it, in one stream by account and time.

Accounts are cut into bins of one window's length, an arrival goes to the bin of its time, a departure to its own and the one
before, where the arrivals that it can follow lie. So a merge is one shuffle and one sort of three rows a transfer, whatever
the number of transfers that meet at an account, and a busy account is dealt out over its bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _transfers(txn: DataFrame) -> DataFrame:
    return txn.select("txn_id", "src", "dst", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "amount")


def _stream(e: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """at, bin, t, leaves and columns (of departures; arrivals have txn_id and src as `of` and `came`) of both kinds of rows."""
    bin_of = F.floor(F.col("t") / width)
    dep = F.struct("t", F.col("txn_id").alias("id"), F.col("dst").alias("to"), *columns)
    arrivals = e.select(F.col("dst").alias("at"), bin_of.alias("bin"), "t", F.lit(False).alias("leaves"), F.col("txn_id").alias("of"), F.col("src").alias("came"), F.lit(None).alias("dep"))
    leaves = e.select(
        F.col("src").alias("at"), F.explode(F.array(bin_of, bin_of - 1)).alias("bin"), "t", F.lit(True).alias("leaves"), F.col("txn_id").alias("of"), F.lit(None).alias("came"), dep.alias("dep")
    )
    return leaves.unionByName(arrivals)


def next_departures(txn: DataFrame, window_s: int) -> DataFrame:
    """of (a transfer), next: struct t, id, to, amount of the earliest transfer that leaves its target later, within the window, for
    another account than it came from; ties by id. Transfers with nulls in src, dst or ts have none and are none."""
    width = window_s * 1_000_000
    e = _transfers(txn).dropna(subset=["txn_id", "src", "dst", "t"])
    # latest first; at one time arrivals stand before departures, which they don't see
    back = Window.partitionBy("at", "bin").orderBy(F.desc("t"), "leaves", F.desc("of"))
    before, till = back.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, 0)
    rows = _stream(e, width, ["amount"]).withColumn("first", F.last("dep", ignorenulls=True).over(before))
    # the departure before a change of target is the first to another one
    change = F.when(F.col("leaves") & (F.col("first.to") != F.col("dep.to")), F.col("first"))
    rows = rows.withColumn("other", F.last(change, ignorenulls=True).over(till)).where("not leaves")
    pick = F.when(F.col("first.to") != F.col("came"), F.col("first")).otherwise(F.col("other"))
    return rows.select("of", "t", pick.alias("next")).where(F.col("next.t") <= F.col("t") + width).select("of", "next")


def upcoming(txn: DataFrame, window_s: int, targets: int) -> DataFrame:
    """txn_id, options: the first departures to each of the next `targets` accounts that leave a transfer's target later, within the window.

    options is an array of t, id, to, amount, earliest first, ties by id. A task holds the options of one account and bin at a time.
    """
    width = window_s * 1_000_000
    e = _transfers(txn).where("src <> dst").dropna()
    kinds = dict(e.dtypes)
    option = f"struct<t:bigint,id:{kinds['txn_id']},to:{kinds['dst']},amount:{kinds['amount']}>"
    rows = _stream(e, width, ["amount"]).drop("came").repartition("at", "bin").sortWithinPartitions("at", "bin", F.desc("t"), "leaves", F.desc("of"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            of, options = [], []
            columns = (batch.column(c).to_pylist() for c in ("at", "bin", "t", "leaves", "of", "dep"))
            for at, slot, t, leaves, txn_id, dep in zip(*columns, strict=True):
                if key != (at, slot):
                    key, held = (at, slot), []
                if leaves:
                    held = [dep, *(x for x in held if x["to"] != dep["to"])][:targets]
                elif held and held[0]["t"] <= t + width:
                    of.append(txn_id)
                    options.append([x for x in held if x["t"] <= t + width])
            types = batch.schema
            yield pa.RecordBatch.from_arrays([pa.array(of, types.field("of").type), pa.array(options, pa.list_(types.field("dep").type))], ["txn_id", "options"])

    return rows.select("at", "bin", "t", "leaves", "of", "dep").mapInArrow(merge, f"txn_id {kinds['txn_id']}, options array<{option}>")


def walked(txn: DataFrame, starts: DataFrame, window_s: int, max_hops: int, cut) -> DataFrame:
    """start_id, nodes, times, last_id, first, last, total, n_less of the greedy walk from each start (txn_id).

    A walk goes from transfer to transfer, each time by the earliest that leaves where it is for an account that it hasn't been to, later than
    it came and within the window of its first transfer. Each hop is a join on the last transfer's id, which is unique, so no account is too busy.
    """
    width = window_s * 1_000_000
    options = cut(upcoming(txn, window_s, max_hops + 1).withColumnRenamed("txn_id", "last_id"))
    e = _transfers(txn).where("src <> dst").dropna().join(starts.select("txn_id").distinct(), "txn_id", "left_semi")
    paths = e.select(
        F.col("txn_id").alias("start_id"), F.array("src", "dst").alias("nodes"), F.array("t").alias("times"), F.col("txn_id").alias("last_id"),
        F.col("amount").alias("first"), F.col("amount").alias("last"), F.col("amount").alias("total"), F.lit(0).alias("n_less"),
    )
    ended, open_paths = None, cut(paths)
    for hop in range(1, max_hops):
        free = F.filter("options", lambda x: (x["t"] <= F.col("times")[0] + width) & ~F.array_contains("nodes", x["to"]))
        stepped = cut(open_paths.join(options, "last_id", "left").withColumn("leg", F.get(free, F.lit(0))).drop("options"))
        done = stepped.where("leg is null").drop("leg").select(paths.columns)
        ended = done if ended is None else ended.unionByName(done)
        open_paths = stepped.where("leg is not null").select(
            "start_id", F.array_append("nodes", F.col("leg.to")).alias("nodes"), F.array_append("times", F.col("leg.t")).alias("times"), F.col("leg.id").alias("last_id"),
            "first", F.col("leg.amount").alias("last"), (F.col("total") + F.col("leg.amount")).alias("total"), (F.col("n_less") + (F.col("leg.amount") < F.col("last")).cast("int")).alias("n_less"),
        )
        if open_paths.isEmpty():
            break
        if hop % 8 == 0:
            ended = cut(ended)
    return open_paths if ended is None else ended.unionByName(open_paths)


def transfer_chains(txn: DataFrame, window_s: int, cut, min_hops: int = 3, max_hops: int = 21, max_chains: int | None = None) -> DataFrame:
    """Chains in which no transfer that a chain has used begins another: start_id, nodes, times, first, last, total.

    As if starts were taken one after the other, those of accounts with most departures first (ties by account, time, txn_id), each walked to its end, and left out
    where a chain of min_hops at least has used its accounts and time before. All walks are made at once, as a walk
    doesn't depend on what is used. Then starts are decided in rounds: one is a chain when all before it that use it are left
    out, and left out when one of them is a chain; the earliest that is open is decided in every round.
    """
    e = txn.where("src <> dst").dropna(subset=["txn_id", "src", "dst", "ts", "amount"])
    walks = walked(e, e, window_s, max_hops, cut).where(F.size("nodes") > min_hops)
    busy = e.groupBy(F.col("src").alias("account")).agg((-F.count("*")).alias("less"))
    place = F.struct("less", F.col("nodes")[0].alias("account"), F.col("times")[0].alias("t"), F.col("start_id").alias("id"))
    walks = cut(walks.join(busy, F.col("nodes")[0] == F.col("account")).withColumn("place", place).drop("less", "account", "last_id"))

    leg = lambda x, i: F.struct(x.alias("t"), F.col("nodes")[i].alias("src"), F.col("nodes")[i + 1].alias("dst"))
    uses = walks.select(F.col("place").alias("by"), F.explode(F.transform("times", leg)).alias("leg")).distinct()
    begins = walks.select("place", leg(F.col("times")[0], 0).alias("leg"))
    blocks = cut(begins.join(uses, "leg").where("by < place").select("place", "by"))
    open_ones = cut(walks.select("place"))
    kept = None
    while not open_ones.isEmpty():
        waiting = blocks.select("place").distinct()
        new = cut(open_ones.join(waiting, "place", "left_anti"))
        kept = new if kept is None else cut(kept.unionByName(new))
        gone = blocks.join(new.withColumnRenamed("place", "by"), "by", "left_semi").select("place").distinct()
        gone = cut(gone)
        open_ones = cut(open_ones.join(new, "place", "left_anti").join(gone, "place", "left_anti"))
        blocks = cut(blocks.join(gone, "place", "left_anti").join(gone.withColumnRenamed("place", "by"), "by", "left_anti").select("place", "by"))
    out = walks if kept is None else walks.join(kept, "place", "left_semi")
    out = out if max_chains is None else out.orderBy("place").limit(max_chains)
    return out.select("start_id", "nodes", "times", "first", "last", "total")
