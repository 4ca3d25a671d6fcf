"""Exact quantiles of any column and groups from counts by ranges of values: no task holds the values of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut


def exact_quantiles(rows: DataFrame, value: str, quantiles: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """by and a column for each of quantiles (name -> share): interpolated between the two values next to the place (n - 1) * share.

    Equal values are counted before they are shuffled; groups and values are dealt by range, also within a large group, and ranks are sums
    within a range and over the ranges before it, one row a group and range. Null values are left out; a null in by is a group; without
    by there is one row, of nulls where there are no values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v__")).agg(F.count("*").alias("n__"))
    dealt = cut(counts.repartitionByRange(*by, "v__").withColumn("range__", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n__").over(before(Window.partitionBy("range__", *by).orderBy("v__"))), F.lit(0))
    ranges = dealt.groupBy("range__", *by).agg(F.sum("n__").alias("m"))
    group = Window.partitionBy(*(by or (F.lit(0),)))
    ranges = ranges.select(
        F.col("range__").alias("r"), *(F.col(c).alias(f"{c}__") for c in by), F.coalesce(F.sum("m").over(before(group.orderBy("range__"))), F.lit(0)).alias("earlier"), F.sum("m").over(group).alias("all")
    )
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"{c}__")), by, F.col("range__") == F.col("r"))
    placed = dealt.withColumn("within", within).join(ranges, same).withColumn("low", F.col("earlier") + F.col("within"))
    at = lambda k: F.max(F.when((F.col("low") <= k) & (k < F.col("low") + F.col("n__")), F.col("v__")))
    ends = []
    for name, q in quantiles.items():
        place = (F.col("all") - 1) * q
        ends += [at(F.floor(place)).alias(f"{name}__0"), at(F.ceil(place)).alias(f"{name}__1"), F.max(place - F.floor(place)).alias(f"{name}__2")]
    out = placed.groupBy(*by).agg(*ends)
    return out.select(*by, *((F.col(f"{n}__0") + (F.col(f"{n}__1") - F.col(f"{n}__0")) * F.col(f"{n}__2")).alias(n) for n in quantiles))
