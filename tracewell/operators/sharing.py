"""Pairs of receivers that share senders, with heavy senders kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut

#: Receivers from which on a sender is heavy: its receivers aren't paired.
HEAVY = 1000
#: Pairs that a task counts, about.
PAIRS = 3_000_000


def pairs_sharing(edges: DataFrame, least: int, heavy: int = HEAVY) -> DataFrame:
    """d1, d2, shared: pairs of receivers (d1 < d2) with at least `least` senders in common and the sorted senders; edges: distinct (s, d).

    Receivers of a light sender are paired, heavy * heavy rows a sender at most. A pair is made where it is counted: a receiver gets the
    sorted later receivers of each of its senders, and tasks are as many as the pairs need. Where no sender is heavy, senders are listed for pairs with enough only. The heavy senders of a receiver are one sorted array
    each, as long as there are heavy senders, which are fewer than edges / heavy; pairs that share a light sender look up there what else
    they share. Pairs that share heavy senders only are found by their arrays: equal arrays are one class, and classes
    meet at an element that both have among their first; only classes with enough in common are given out as pairs, which then are results.
    """
    degree = edges.groupBy("s").agg(F.count("*").alias("n"))
    able = edges.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("d")
    e = cut(edges.select("s", "d").join(able, "d", "left_semi").join(degree, "s"))  # receivers of fewer senders are in no pair
    light = e.where(F.col("n") <= heavy).select("s", "d")
    big = cut(e.where(F.col("n") > heavy).groupBy("d").agg(F.array_sort(F.collect_list("s")).alias("big")))
    pairs = light.groupBy("s").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    tasks = max(1, min(int(pairs // PAIRS) + 1, 20_000))
    lists = light.repartition(tasks // 4 + 1, "s").groupBy("s").agg(F.array_sort(F.collect_list("d")).alias("ds")).where(F.size("ds") > 1)  # `heavy` at most
    later = lists.select("s", F.posexplode("ds").alias("at", "d1"), "ds").where(F.col("at") + 1 < F.size("ds"))
    later = later.select("s", "d1", F.slice("ds", F.col("at") + 2, F.size("ds")).alias("ds"))
    if big.isEmpty():
        met = later.select("d1", "ds").repartition(tasks, "d1").select("d1", F.explode("ds").alias("d2")).groupBy("d1", "d2").agg(F.count("*").alias("n"))
        met = cut(met.where(F.col("n") >= least).select("d1", "d2"))
        both = met.join(light.withColumnRenamed("d", "d1"), "d1").join(light.withColumnRenamed("d", "d2"), ["d2", "s"])
        return both.groupBy("d1", "d2").agg(F.array_sort(F.collect_list("s")).alias("shared"))
    met = later.repartition(tasks, "d1").select("s", "d1", F.explode("ds").alias("d2")).groupBy("d1", "d2").agg(F.collect_list("s").alias("few"))
    met = cut(met)
    of = lambda k: big.select(F.col("d").alias(f"d{k}"), F.col("big").alias(f"b{k}"))
    both = met.join(of(1), "d1", "left").join(of(2), "d2", "left")
    both = both.select("d1", "d2", F.concat("few", F.coalesce(F.array_intersect("b1", "b2"), F.array().cast(met.schema["few"].dataType))).alias("shared"))
    classes = cut(big.where(F.size("big") >= least).select("big").distinct())
    starts = classes.select("big", F.explode(F.slice("big", 1, F.size("big") - least + 1)).alias("mark"))
    near = starts.select(F.col("big").alias("b1"), "mark").join(starts.select(F.col("big").alias("b2"), "mark"), "mark").select("b1", "b2").distinct()
    near = near.withColumn("shared", F.array_intersect("b1", "b2")).where(F.size("shared") >= least)
    only = near.join(big.select(F.col("d").alias("d1"), F.col("big").alias("b1")), "b1").join(big.select(F.col("d").alias("d2"), F.col("big").alias("b2")), "b2")
    only = only.where("d1 < d2").select("d1", "d2", "shared").join(met.select("d1", "d2"), ["d1", "d2"], "left_anti")
    return both.unionByName(only).where(F.size("shared") >= least).select("d1", "d2", F.array_sort("shared").alias("shared"))
