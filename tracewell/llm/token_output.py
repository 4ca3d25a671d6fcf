"""Token-ID output: documents encoded once and written as ORC, in ascending document order.

File format: ORC, one row per document with columns doc_id long, ids array<int> (the end id last),
n_tokens long, part int, start_in_part long. ORC stores ids as run-length encoded integers in stripes;
a row index every `row_index` rows and a Bloom filter on doc_id let a reader skip stripes and row groups,
and Spark's reader splits a large file at its stripes. No row holds more than its own document.

Defined cases: a null or empty text gives the end id alone; repeated doc_ids and repeated rows stay, one
row each, ordered by (doc_id, text); null doc_ids come first; an empty table gives an empty folder that reads as no rows; further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, materialise, vocabulary
from tracewell.llm.encoders import library_encoder

#: Parts of a block when their sizes are summed up, and part rows that are broadcast at most.
BLOCK, BROADCAST_ROWS = 1024, 2_000_000
SCHEMA = "doc_id long, ids array<int>, n_tokens long, part int, start_in_part long"


def id_lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """list<int32> column of the given lengths over ids in a row."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def with_end(flat: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with end_id after them."""
    return np.insert(flat, np.cumsum(lengths), end_id).astype(np.int32), lengths + 1


def encode_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts in document order; see SCHEMA for the columns.

    The rows are range-partitioned by document id before encoding, so texts are moved once and ids never.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        encoder = library_encoder(tokenizer, True)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                flat, lengths = with_end(*encoder(rows.column("text").to_pylist()), end_id)
                starts = before + np.cumsum(lengths) - lengths
                before += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), id_lists(flat, lengths), pa.array(lengths, pa.int64()), pa.array(np.full(len(lengths), part, np.int32)), pa.array(starts, pa.int64())],
                    ["doc_id", "ids", "n_tokens", "part", "start_in_part"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, SCHEMA)


def write_tokens(encoded: DataFrame, path: str, row_index: int = 1000, stripe_bytes: int = 16 << 20) -> None:
    """Write encoded documents as ORC with row indexes and a Bloom filter on doc_id."""
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Read token files; with doc_ids, the filter is pushed to ORC's statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows.where(F.col("doc_id").isin(doc_ids)) if doc_ids else rows


def crc_of_lists(ids: pa.Array) -> np.ndarray:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    at = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype("<u4")
    at = at - at[0]
    return np.fromiter((zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)), np.int64, len(ids))


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 from read token files.

    The start of a part is the sum of the parts before it, one row a part, summed by windows within blocks of parts
    and over blocks.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"), pa.array(np.diff(batch.column("ids").offsets.to_numpy()), pa.int64()), pa.array(crc_of_lists(batch.column("ids")), pa.int64())],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"],
            )

    # two levels: sums within blocks of BLOCK parts, and one row a block for the sums of the blocks before
    totals = materialise(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")), "token-parts")
    totals = totals.withColumn("block", F.floor(F.col("part") / BLOCK))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(earlier(Window.orderBy("block"))), F.lit(0)).alias("of_blocks"))
    within = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("block").orderBy("part"))), F.lit(0))
    before = totals.select("part", "block", within.alias("of_parts")).join(blocks, "block")
    before = materialise(before.select("part", (F.col("of_blocks") + F.col("of_parts")).alias("before")), "token-starts")
    rows = tokens.select("doc_id", "part", "start_in_part", "ids").mapInArrow(
        digest, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
    )
    return rows.join(broadcast_if_small(before, BROADCAST_ROWS), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def default_tokenizer() -> str:
    return vocabulary("byte_bpe_50k.json")
