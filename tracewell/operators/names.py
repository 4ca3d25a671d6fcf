"""Similarity join of names: pairs whose Ratcliff-Obershelp ratio reaches a bound, by prefix filtering on characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import name_similarity
from tracewell.session import cut

#: Different marks (a character and its count within a name) that are broadcast at most.
BROADCAST_MARKS = 500_000


def marks_of(name: Column) -> Column:
    """The characters of a name, each with how often it has come so far in it, so that equal marks of two names are their shared characters."""
    letters = F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0))
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string")))


def similar_names(rows: DataFrame, min_ratio: float = 0.85, blocks: tuple[str, ...] = ()) -> DataFrame:
    """id_a, id_b, ratio of the pairs of rows (id, name) whose names reach min_ratio, each once, the lesser id first; blocks are columns that both share.

    The ratio is 2 M / (a + b) for lengths a and b and M matched characters, and M is at most what two names have in common of
    each character. So two names need `least` = min_ratio (a + b) / 2 common marks, and when marks are put in one order, the rarest first,
    one of the first a - least + 1 of one name is among the first b - least + 1 of the other. Names meet by pair of lengths and such a
    mark, only at the first they share; then common marks are counted, and only pairs with enough reach the ratio itself. No pair is lost.
    Each different name of a block is compared once, however many rows have it; rows of alike names are paired after that.
    Names are lower-cased and stripped; null and blank ones are left out.
    """
    plain = cut(rows.select("id", F.lower(F.trim("name")).alias("name"), *blocks).where("name <> ''"))
    each = cut(plain.select("name", *blocks).distinct().withColumn("marks", marks_of(F.col("name"))))
    counts = each.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))
    if counts.limit(BROADCAST_MARKS + 1).count() > BROADCAST_MARKS:  # names in more scripts than any: any order is right, this one is only quicker
        counts = counts.limit(0)
    table = F.broadcast(counts.agg(F.map_from_entries(F.collect_list(F.struct("mark", "n"))).alias("often")))
    order = F.array_sort(F.transform("marks", lambda m: F.struct(F.coalesce(F.element_at("often", m), F.lit(0)).alias("n"), m.alias("mark"))))
    named = cut(each.crossJoin(table).select("name", *blocks, F.transform(order, lambda x: x["mark"]).alias("marks"), F.size("marks").alias("size")))

    reach = (2 - min_ratio) / min_ratio  # how much longer the longer name can be
    slack = 1e-9
    side = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("name", "marks")]
    least = F.ceil(min_ratio * (F.col("a") + F.col("b")) / 2 - slack).cast("int")
    first = lambda size: F.slice("marks", 1, F.greatest(F.col(size) - least + 1, F.lit(1)))
    short = named.withColumns({"a": F.col("size"), "b": F.explode(F.sequence(F.col("size"), F.floor(F.col("size") * reach + slack).cast("int")))})
    long = named.withColumns({"b": F.col("size"), "a": F.explode(F.sequence(F.greatest(F.ceil(F.col("size") / reach - slack).cast("int"), F.lit(1)), F.col("size")))})
    short = short.withColumn("prefix_a", first("a")).select(*blocks, "a", "b", *side("a"), "prefix_a", F.explode("prefix_a").alias("mark"))
    long = long.withColumn("prefix_b", first("b")).select(*blocks, "a", "b", *side("b"), "prefix_b", F.explode("prefix_b").alias("mark"))
    met = short.join(long, [*blocks, "a", "b", "mark"]).where((F.col("a") < F.col("b")) | (F.col("name_a") < F.col("name_b")))
    met = met.where(F.array_intersect("prefix_a", "prefix_b")[0] == F.col("mark"))
    met = met.where(F.size(F.array_intersect("marks_a", "marks_b")) >= least)
    alike = met.withColumn("ratio", name_similarity("name_a", "name_b")).where(F.col("ratio") >= min_ratio).select(*blocks, "name_a", "name_b", "ratio")
    of = lambda x: plain.select(*blocks, F.col("id").alias(f"id_{x}"), F.col("name").alias(f"name_{x}"))
    pairs = cut(alike).join(of("a"), [*blocks, "name_a"]).join(of("b"), [*blocks, "name_b"])
    pairs = pairs.where("id_a <> id_b")
    same = of("a").withColumnRenamed("name_a", "name").join(of("b").withColumnRenamed("name_b", "name"), [*blocks, "name"]).where("id_a < id_b")
    pairs = pairs.select("id_a", "id_b", "ratio").unionByName(same.select("id_a", "id_b", F.lit(1.0).alias("ratio")))
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "ratio")
