"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Each text is cut at content-defined places (the shortest run of 1,024 to 8,192 characters that ends at a
blank or line end before one of a few letters; 8,192 at most), so equal texts give equal chunk lists
wherever they lie. A document's recipe is the ordered list of its chunks' SHA-256 digests, a few per cent of
its text. Only recipes shared by several documents are looked at again: their chunks, each once, are
grouped by digest, and where one digest stands for several contents its identifier gets the content's
ordinal, so that an identifier is verified to mean one content. Documents are equal if their verified
identifier lists are. Texts of documents that share no recipe don't move while the ids of those that do are broadcast,
BROADCAST_IDS at most; beyond that, ids and texts are joined by a shuffle.

Defined cases: a null text is equal to an empty one (its recipe has no chunk); of rows with the largest doc_id
all stay (repeated rows); a null doc_id is less than any other; an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, materialise

#: Chunk bounds in characters and the letters before which a chunk may end.
MIN_CHUNK, MAX_CHUNK, CUT_BEFORE = 1024, 8192, "a-eA-E"
BROADCAST_IDS = 2_000_000


def chunks(text: Column) -> Column:
    """The text's chunks in order; put together they are the text."""
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[ \\n])(?=[{CUT_BEFORE}])|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digest(chunk: Column, digest_bytes: int) -> Column:
    return F.substring(F.sha2(chunk, 256), 1, 2 * digest_bytes)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """doc_id, text_sha256 and recipe: the digests of the text's chunks in order, as one binary."""
    digests = F.transform(chunks(F.col("text")), lambda c: _digest(c, digest_bytes))
    return _texts(docs, id_col, text_col).select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), F.unhex(F.array_join(digests, "")).alias("recipe")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    digest_bytes: how much of each chunk's SHA-256 goes into recipes; results don't depend on it, as
    identifiers are verified against the chunks' contents.
    """
    rows = materialise(recipes(docs, id_col, text_col, digest_bytes), "recipes")
    shared = rows.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1").select("recipe")
    suspects = materialise(rows.join(materialise(shared, "shared-recipes"), "recipe", "left_semi").select("doc_id").distinct(), "suspects")
    asked = suspects.withColumnRenamed("doc_id", "suspect")
    texts = _texts(docs, id_col, text_col).join(broadcast_if_small(asked, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi")

    # each distinct chunk of these documents once, under its digest
    contents = texts.select(F.explode(F.array_distinct(chunks(F.col("text")))).alias("chunk")).distinct()
    contents = contents.select(_digest(F.col("chunk"), digest_bytes).alias("digest"), "chunk")
    several = contents.groupBy("digest").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    several = materialise(several.where("least <> most").select("digest"), "ambiguous-digests")
    rows = rows.withColumn("ordinals", F.lit(""))
    if several.limit(1).count():  # never with whole SHA-256 digests, unless they collide
        numbered = contents.join(several, "digest", "left_semi").withColumn(
            "ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("chunk"))
        )
        places = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
        ordinals = (
            places.join(numbered.select("chunk", "ordinal"), "chunk")
            .distinct()
            .groupBy("doc_id", "text_sha256")
            .agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "ordinal")))).alias("o"))
        )
        ordinals = ordinals.select(F.col("doc_id").alias("of"), F.col("text_sha256").alias("sha"), "o")
        same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_sha256") == F.col("sha"))
        rows = rows.join(ordinals, same, "left").withColumn("ordinals", F.coalesce("o", F.lit(""))).drop("o", "of", "sha")
        rows = materialise(rows, "verified-recipes")

    groups = rows.groupBy("recipe", "ordinals").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where("n > 1")
    # groups are few columns and at most half the rows; written, so that a hot group's join can be split by Spark
    groups = materialise(groups, "recipe-groups")
    out = rows.join(groups, ["recipe", "ordinals"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (t)
"""
