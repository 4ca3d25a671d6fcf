"""Importance resampling: documents drawn by how much likelier a target model makes them than the raw corpus does.

Two generative models over hashed word unigrams and bigrams, BUCKETS numbers each: the target's from the documents
labelled good, the raw one's from all documents. A document's weight is the log of its importance ratio, the sum of its
n-grams' log ratios; with Gumbel noise of its id added, the k greatest keys are a sample without replacement in proportion
to that ratio. Options temper it: `mean` divides the weight by the number of n-grams, `scale` multiplies it. The k-th key is found by histograms of the keys, refined where the k-th lies, and never by moving rows to one
place.

Defined cases: a null or empty text has weight 0; ties of keys go to the lower doc_id, and rows of equal key and id stand or fall
together with the last that fits; documents without a label count as raw only; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bytescan import Words, mix, slices, text_buffers, windows
from tracewell.llm.common import materialise

BUCKETS = 10_000
#: Share of the documents drawn, and seed of the noise.
SHARE, SEED = 0.8, 42
#: Rows among which the last places are settled by a sort.
SETTLE = 10_000
#: Target ids that are broadcast at most; beyond that the join is shuffled.
BROADCAST_IDS = 2_000_000


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of each unigram and bigram."""
    w = Words(data, offsets)
    h = w.hashes(lower=True)
    first, pairs = windows(h, w.per_doc, 2)
    bucket = np.concatenate([mix(h) % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS)]).astype(np.int64)
    return bucket, np.concatenate([w.doc, w.doc[first]])


def models(docs: DataFrame) -> np.ndarray:
    """Log ratio of target to raw for each bucket, from (text, good); 2 * BUCKETS numbers reach the driver per task's sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in slices(offsets):
                bucket, doc = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                totals[0] += np.bincount(bucket, minlength=BUCKETS)
                totals[1] += np.bincount(bucket[good[i:j][doc]], minlength=BUCKETS)
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[0][used]), pa.array(totals[1][used])], ["bucket", "raw", "target"])

    counts = docs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts.collect():  # BUCKETS rows at most
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(seed: int, doc_id: Column) -> Column:
    """Standard Gumbel noise that depends on the seed and the id alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """rows (doc_id, key, ..) with `kept`: the k greatest by key, ties by lower doc_id."""
    bounds = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
    if bounds.n <= k or k <= 0:
        return rows.withColumn("kept", F.lit(k > 0))
    lo, hi, above, cells = bounds.lo, bounds.hi, 0, 4096
    while True:  # all keys over hi are kept, `above` in number; the k-th lies in [lo, hi]
        inside = rows.where((F.col("key") >= lo) & (F.col("key") <= hi))
        width = (hi - lo) / cells
        if width <= 0 or lo + width == lo:
            break
        cell = F.least(F.floor((F.col("key") - lo) / width), F.lit(cells - 1))
        found = {r.c: r for r in inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}  # `cells` rows at most
        for c in sorted(found, reverse=True):
            if above + found[c].n >= k:
                break
            above += found[c].n
        lo, hi = found[c].lo, found[c].hi
        if found[c].n <= SETTLE or lo == hi:
            break
    inside = rows.where((F.col("key") >= lo) & (F.col("key") <= hi))
    if lo < hi:  # SETTLE rows at most
        last = inside.orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).limit(k - above).select("key", "doc_id").collect()[-1]
        edge_key, edge_id = last.key, last.doc_id
    else:  # equal keys: the ids are searched in the same way
        ids = inside.select(F.col("doc_id"), (-F.col("doc_id").cast("double")).alias("key"))
        edge_key = lo
        kept = top_k(ids, k - above).where("kept").agg(F.max("doc_id")).first()[0]
        edge_id = kept
    tie = (F.col("key") == edge_key) & (F.coalesce(F.col("doc_id") <= edge_id, F.lit(edge_id is None)) if edge_id is not None else F.lit(True))
    return rows.withColumn("kept", (F.col("key") > edge_key) | tie)


def importance_resample(
    docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED, mean: bool = False, scale: float = 1.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, weight, key, kept of each document; labels: (doc_id, quality), all rows of quality 1 are the target."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    good = materialise(good, "target-ids")
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good  # texts stay where they lie, but for a longer list
    marked = texts.join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    shared = docs.sparkSession.sparkContext.broadcast(models(marked))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in slices(offsets):
                bucket, doc = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total, n = np.bincount(doc, ratio[bucket], j - i), np.bincount(doc, minlength=j - i)
                weight = total / np.maximum(n, 1) if mean else total
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(weight.astype(np.float64))], ["doc_id", "weight"])

    weights = texts.mapInArrow(weigh, "doc_id long, weight double")
    keyed = materialise(weights.withColumn("key", scale * F.col("weight") + gumbel(seed, F.coalesce("doc_id", F.lit(-1)))), "importance-keys")
    return top_k(keyed, int(np.ceil(share * keyed.count())))
