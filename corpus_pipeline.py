"""Corpus pipeline over `documents`: quality rules, exact dedup, near dedup, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last return
the columns of `documents`. A stage that only decides reads the texts where they lie: the rows it keeps are
joined back, broadcast below a counted bound and shuffled beyond it. A row is decided on by itself, also where
doc_id is null or several rows have the same: such documents are first written with an id of their own a row.

A stage's result reads tables that the stage wrote; it is to be written before the next stage is called, which deletes
what the stages before have left and its own input doesn't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import exact_dedup, jaccard_join, packing, pii, quality_rules
from tracewell.llm.common import broadcast_if_small, drop_all_but, materialise

BROADCAST_IDS = 2_000_000


def _identity(docs: DataFrame) -> str:
    """A name that no column of docs has, for the identity of its rows."""
    name = "row__"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _rows(docs: DataFrame, row: str) -> DataFrame:
    """docs with `row`, a long that no two rows share: doc_id, or the row's place where a doc_id is null or repeated."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    if ids.where("doc_id is null or n > 1").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long"))
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")


def _only(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The documents of rows whose `row` is in kept (column doc_id), without it."""
    ids = materialise(kept.select(F.col("doc_id").alias(row)), "kept-rows")
    return rows.join(broadcast_if_small(ids, BROADCAST_IDS), row, "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, each by its own text."""
    drop_all_but(docs)
    row = _identity(docs)
    rows = _rows(docs, row)
    return _only(rows, row, quality_rules.quality_rules(rows, row).where("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the greatest doc_id, a null one only where there is no other."""
    drop_all_but(docs)
    row = _identity(docs)
    rows = _rows(docs, row)
    groups = exact_dedup.exact_dedup(rows, row).select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))
    last = F.max(F.struct(F.col("doc_id").cast("long").alias("id"), "row"))
    return _only(rows, row, _of_groups(rows, row, groups, last))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least doc_id, a null one only where there is no other."""
    drop_all_but(docs)
    row = _identity(docs)
    rows = _rows(docs, row)
    groups = jaccard_join.near_duplicates(rows, row).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").cast("long").alias("id"), "row"))
    return _only(rows, row, _of_groups(rows, row, groups, first))


def _of_groups(rows: DataFrame, row: str, groups: DataFrame, best: Column) -> DataFrame:
    """The row (as doc_id) that best picks from each group of groups (row, group)."""
    return groups.join(rows.select(F.col(row).alias("row"), "doc_id"), "row").groupBy("group").agg(best.alias("b")).select(F.col("b.row").alias("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    drop_all_but(docs)
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    drop_all_but(docs)
    return packing.pack(docs, packing.default_tokenizer(), digest=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("personal_data", personal_data), ("pack", pack)]

#: Packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
