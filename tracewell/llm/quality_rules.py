"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Each document gets counts from one scan of its bytes. Each group's distribution of a signal is kept as a
relative-error quantile sketch: counts of logarithmic buckets, which merge by adding, so partial sketches are
built before the shuffle, a hot source costs no more than a rare one, and the result doesn't depend on how
rows are dealt. A threshold is an upper fence of the group, high + FENCE * (high - median), where `high` is an upper
quantile of the group: the signal's own, as marks of layout and long words are rare in ordinary text, while single
repeated lines and phrases aren't. Where nine documents in ten have no symbol at all, one symbol is over the fence;
where every second has some, it takes many. Groups of under MIN_GROUP documents use the merged sketch of their
language, and languages of under MIN_GROUP that of all documents. The thresholds, a few numbers per group, are joined
back to filter.

Defined cases: a null text has no words (and fails the base rule); a null language or source is a group
of its own; a very long text is scanned whole, with some 5 bytes of memory a byte and 100 a word; repeated rows are judged alike; an empty table gives no rows; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bytescan import Words, counts_before, run_hashes, slices, text_buffers, windows
from tracewell.llm.common import materialise
from tracewell.llm.encoders import release

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Signals in parts per 10,000 (long_words in hundredths of a character), as SQL over the counts, with the upper quantile of each.
SIGNALS = {
    "symbols": ("10000 * n_symbols div greatest(n_words, 1)", 0.9),
    "dup_lines": ("10000 * n_dup_lines div greatest(n_lines, 1)", 0.98),
    "repeats": ("10000 * n_repeat_words div greatest(n_words, 1)", 0.98),
    "long_words": ("100 * word_chars div greatest(n_words, 1)", 0.9),
}
FENCE = 3.0
MIN_GROUP = 100
#: Buckets per unit of natural logarithm: a quantile is off by half a per cent at most.
RESOLUTION = 100
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def count_signals(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS and the number of lines with a word, for each text."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    word_chars = np.diff(counts_before((data & 0xC0 != 0x80) & w.inside, offsets))
    n_symbols = np.diff(counts_before(_SYMBOL[data], offsets))

    # lines: a text of k line ends has k + 1; those without a word don't count
    ends = np.flatnonzero(data == 0x0A)
    edges = np.union1d(offsets, ends + 1)
    start, end = edges[:-1], edges[1:]
    end = np.where((end > start) & (data[np.maximum(end - 1, 0)] == 0x0A), end - 1, end)
    full = counts_before(w.inside, end) > counts_before(w.inside, start)
    start, end = start[full], end[full]
    line_doc = np.searchsorted(offsets, start, "right") - 1
    hashes = run_hashes(data, start, end)
    n_lines = np.bincount(line_doc, minlength=n)
    kinds = np.unique(np.rec.fromarrays([line_doc, hashes])) if len(start) else np.rec.fromarrays([line_doc, hashes])
    n_dup = n_lines - np.bincount(kinds["f0"], minlength=n)

    # words in windows of three that are found twice or more in their text
    first, key = windows(w.hashes(), w.per_doc, 3)
    covered = np.zeros(len(w.start) + 2, bool)
    if len(first):
        order = np.lexsort((key, w.doc[first]))
        k, d = key[order], w.doc[first][order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        again = first[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        for i in range(3):
            covered[again + i] = True
    repeats = np.bincount(w.doc[covered[: len(w.start)]], minlength=n)
    return [w.per_doc, word_chars, n_symbols, n_dup, repeats, n_lines]


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, lang, source, COUNTS and n_lines of each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]]
                counts = count_signals(part, offsets[i : j + 1] - offsets[i])
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("lang"), rows.column("source"), *(pa.array(c.astype(np.int64)) for c in counts)],
                    ["doc_id", "lang", "source", *COUNTS, "n_lines"],
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(keys[0]).cast("string").alias("lang"), F.col(keys[1]).cast("string").alias("source"),
    )
    return rows.mapInArrow(count, ", ".join(["doc_id long, lang string, source string", *(f"{c} long" for c in [*COUNTS, "n_lines"])]))


def _bucket(value: Column) -> Column:
    """The sketch's bucket: 0 for 0, else 1 + floor(RESOLUTION * ln(value))."""
    return F.when(value <= 0, F.lit(0)).otherwise(1 + F.floor(RESOLUTION * F.log(value.cast("double"))).cast("int"))


def _from_bucket(bucket: Column) -> Column:
    """The bucket's upper edge, 0 for bucket 0."""
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.exp(bucket / RESOLUTION))


def sketches(signals: DataFrame) -> DataFrame:
    """signal, lang, source, bucket, n: the mergeable sketch of each group."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), _bucket(F.col(s)).alias("bucket")) for s in SIGNALS)))
    return signals.select("lang", "source", pairs.alias("x")).groupBy("x.signal", "lang", "source", "x.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and a fence per signal, from merged sketches; the number of buckets bounds each group's rows."""

    def fences(merged: DataFrame, keys: list[str]) -> DataFrame:
        # each sketch as one sorted array, of at most a few thousand buckets
        one = merged.groupBy("signal", *keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))

        def quantile(q: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("at"))
            step = lambda a, x: F.struct(
                (a["seen"] + x["n"]).alias("seen"),
                F.when((a["at"] < 0) & (a["seen"] + x["n"] >= q * F.col("total")), x["bucket"]).otherwise(a["at"]).alias("at"),
            )
            return _from_bucket(F.aggregate("b", start, step, lambda a: a["at"]))

        upper = reduce(lambda c, s: F.when(F.col("signal") == s, F.lit(SIGNALS[s][1])).otherwise(c), SIGNALS, F.lit(1.0))
        high, median = quantile(upper), quantile(F.lit(0.5))
        per = one.select("signal", *keys, "total", (high + FENCE * (high - median)).alias("fence"))
        return per.groupBy(*keys).agg(F.max("total").alias("total"), *(F.max(F.when(F.col("signal") == s, F.col("fence"))).alias(s) for s in SIGNALS))

    def merge(keys: list[str]) -> DataFrame:
        return sketch.groupBy("signal", *keys, "bucket").agg(F.sum("n").alias("n"))

    by_group = fences(sketch, ["lang", "source"])
    by_lang = fences(merge(["lang"]), ["lang"]).select(F.col("lang").alias("l"), F.struct("total", *SIGNALS).alias("of_lang"))
    of_all = fences(merge([]).withColumn("every", F.lit(1)), ["every"]).select(F.struct("total", *SIGNALS).alias("of_all"), F.lit(1).alias("k"))
    joined = by_group.withColumn("k", F.lit(1)).join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(of_all), "k")
    enough = lambda c: F.col(c) >= MIN_GROUP
    pick = lambda s: F.when(enough("total"), F.col(s)).when(enough("of_lang.total"), F.col(f"of_lang.{s}")).otherwise(F.col(f"of_all.{s}"))
    return joined.select("lang", "source", *(pick(s).alias(f"{s}_fence") for s in SIGNALS))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, and the first signal over its fence as `reason`."""
    counts = quality_counts(docs, id_col, text_col, keys)
    counts = materialise(counts.withColumns({s: F.expr(e) for s, (e, _) in SIGNALS.items()}), "quality-counts")
    fences = thresholds(sketches(counts)).select(F.col("lang").alias("l"), F.col("source").alias("s"), *(f"{s}_fence" for s in SIGNALS))
    # one row per language and source, written so that a hot group's side of the join can be split
    fences = materialise(fences, "quality-fences")
    joined = counts.join(fences, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    over = {s: F.col(s) > F.col(f"{s}_fence") for s in SIGNALS}
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    reason = F.when(base, F.lit("base"))
    for s, bad in over.items():
        reason = reason.when(bad, F.lit(s))
    bad = reduce(lambda a, b: a | b, over.values())
    return joined.select("doc_id", *COUNTS, base.alias("base_failed"), (~(base | bad)).alias("kept"), reason.alias("reason"))


_SIGNAL_SQL = {s: e.replace(" div ", " // ") for s, (e, _) in SIGNALS.items()}
SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
li AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
wi AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
re AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM wi) WHERE c > 1)
  GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN li USING (doc_id) LEFT JOIN re USING (doc_id)),
s AS (SELECT *, {", ".join(f"{e} AS {s}" for s, e in _SIGNAL_SQL.items())} FROM c),
v AS ({" UNION ALL ".join(f"SELECT '{s}' AS signal, lang, source, {s} AS x FROM s" for s in SIGNALS)}),
sk AS (
  SELECT signal, lang, source, CASE WHEN x <= 0 THEN 0 ELSE 1 + floor({RESOLUTION} * ln(x)) END AS bucket, count(*) AS n FROM v GROUP BY ALL),
lv AS (
  SELECT 0 AS level, signal, lang, source, bucket, n FROM sk
  UNION ALL SELECT 1, signal, lang, NULL, bucket, sum(n) FROM sk GROUP BY ALL
  UNION ALL SELECT 2, signal, NULL, NULL, bucket, sum(n) FROM sk GROUP BY ALL),
cu AS (
  SELECT *, sum(n) OVER (PARTITION BY level, signal, lang, source ORDER BY bucket) AS seen,
         sum(n) OVER (PARTITION BY level, signal, lang, source) AS total FROM lv),
q AS (
  SELECT level, signal, lang, source, max(total) AS total, min(bucket) FILTER (seen >= 0.5 * total) AS bm,
         min(bucket) FILTER (seen >= CASE signal {" ".join(f"WHEN '{s}' THEN {q}" for s, (_, q) in SIGNALS.items())} END * total) AS bh
  FROM cu GROUP BY ALL),
e AS (
  SELECT *, CASE WHEN bm = 0 THEN 0 ELSE exp(bm / {RESOLUTION}) END AS med, CASE WHEN bh = 0 THEN 0 ELSE exp(bh / {RESOLUTION}) END AS high FROM q),
f AS (SELECT level, signal, lang, source, total, high + {FENCE} * (high - med) AS fence FROM e),
g AS (
  SELECT a.signal, a.lang, a.source,
         CASE WHEN a.total >= {MIN_GROUP} THEN a.fence WHEN b.total >= {MIN_GROUP} THEN b.fence ELSE o.fence END AS fence
  FROM f a JOIN f b ON b.level = 1 AND a.signal = b.signal AND a.lang IS NOT DISTINCT FROM b.lang
  JOIN f o ON o.level = 2 AND o.signal = a.signal WHERE a.level = 0),
h AS (
  SELECT doc_id, bool_or(s.x > g.fence) AS bad
  FROM (SELECT doc_id, lang, source, unnest([{", ".join(f"'{s}'" for s in SIGNALS)}]) AS signal, unnest([{", ".join(SIGNALS)}]) AS x FROM s) s
  JOIN g ON s.signal = g.signal AND s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source GROUP BY doc_id)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR h.bad) AS kept
FROM s JOIN h USING (doc_id)
"""
