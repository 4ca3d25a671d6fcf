"""Spelling variants: a trie self-join with active-node sets over the corpus vocabulary, and the forms that variants belong to.

Two words at distance one differ in one place, before or behind the middle of the shorter: behind it they share a prefix, and meet
in one subtree of the vocabulary's trie, before it a suffix, and meet in one subtree of the trie of reversed words. So
the tries are partitioned by prefix (and suffix), each word going to four subtrees whatever the size of the vocabulary. A subtree that many words share
is cut again, at the middle of what its words don't share, until it is small; where one place is left, the
alphabet bounds it. In each subtree the nodes within distance one of a node, its active nodes, are propagated downwards:
those of a child are its parent, its siblings, its own children, and the children by the same letter of its parent's active nodes. Where a
word and an active node end, they are a pair.

A word's form is its near word of most occurrences, if it has FACTOR times the word's; occurrences grow by that factor
with each step, so roots are found by doubling in a few rounds. A word has at most 90 (2 length + 1) near words, 90 the
letters of the alphabet, which bounds every group.

Defined cases: a null text has no words; a null doc_id is written as nothing where a run's hash is taken; repeated rows
count each time; very long runs are words like others, and bound with their letters how much one task takes; of near words with equal occurrences
the least in code-point order is the form; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, materialise

MIN_LENGTH, MIN_COUNT, FACTOR, TYPO_EVERY = 6, 5, 5, 199
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters of one subtree's trie at most, unless one place of its words is left; letters of partial counts, and 40 a word, that a task holds.
SUBTREE, HELD = 200_000, 12_000_000
BROADCAST_ROWS = 500_000


def count_runs(doc_id: int | None, text: str, counts: Counter, typo_every: int, min_length: int) -> int:
    """Add the text's words of min_length letters at least to counts; a run whose hash typo_every divides loses one letter.

    Returns how many letters, and 40 a word, the new words take.
    """
    taken = 0
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lowered = text.encode().lower().decode()
    for run, n in Counter(_RUN.findall(lowered)).items():
        if len(run) >= min_length:
            h = zlib.crc32(run.encode(), start)
            if h % typo_every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
                if len(run) < min_length:
                    continue
            if run not in counts:
                taken += len(run) + 40
            counts[run] += n
    return taken


def vocabulary(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """word, n: the words of the documents with min_count occurrences at least; counted in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held += count_runs(doc_id, text.as_py() or "", counts, typo_every, min_length)
                if held > HELD:
                    yield out()
                    counts.clear()
                    held = 0
        yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _frames(words: DataFrame, min_length: int) -> DataFrame:
    """word, n and the frame (size, lo, hi) of each subtree: words of size letters, or one more, that share their first lo letters and those behind hi."""
    size = F.length("word")
    sizes = F.explode(F.when(size > min_length, F.array(size, size - 1)).otherwise(F.array(size))).alias("size")
    whole = words.select("word", "n", sizes).withColumns({"lo": F.lit(0), "hi": F.col("size")})
    return _cut(whole)


def _cut(frames: DataFrame) -> DataFrame:
    """Each frame cut at its middle: what differs lies behind it, and the prefix is shared, or before it, and the suffix is."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(middle.alias("lo"), F.col("hi")), F.struct(F.col("lo"), middle.alias("hi")))
    return frames.select("word", "n", "size", F.explode(parts).alias("p")).select("word", "n", "size", "p.lo", "p.hi")


def _shared() -> list[Column]:
    """The columns that a subtree's words share."""
    return [
        F.col("size"), F.col("lo"), F.col("hi"), F.substring("word", F.lit(1), F.col("lo")).alias("prefix"),
        F.expr("right(word, size - hi)").alias("suffix"),
    ]


def _subtrees(words: DataFrame, min_length: int) -> DataFrame:
    """The frames of all words, cut until no subtree is too large."""
    done, frames = None, _frames(words, min_length)
    while True:
        counts = frames.groupBy(*_shared()).agg(F.count("*").alias("k")).where(((F.col("hi") - F.col("lo")) > 1) & (F.col("k") > 1) & (F.col("k") * (F.col("hi") - F.col("lo") + 1) > SUBTREE))
        large = materialise(counts.drop("k"), "large-subtrees")
        keyed = frames.select("word", "n", *_shared())
        keys = ["size", "lo", "hi", "prefix", "suffix"]
        if large.isEmpty():
            return keyed if done is None else done.unionByName(keyed)
        keys_of = broadcast_if_small(large, BROADCAST_ROWS)
        rest = keyed.join(keys_of, keys, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        frames = materialise(_cut(keyed.join(keys_of, keys, "left_semi").drop("prefix", "suffix")), "cut-subtrees")


def trie_pairs(words: list[tuple[str, str, int]], size: int) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """Pairs ((word, n), (word, n)) at distance one, of (letters, word, n); letters are what a word doesn't share. One of each pair has size letters."""
    root: dict = {}
    for letters, *word in words:
        node = root
        for c in letters:
            node = node.setdefault(c, {})
        node[""] = tuple(word)
    stack = [(root, [v for c, v in root.items() if c != ""])]
    while stack:
        node, active = stack.pop()
        for c, child in node.items():
            if c == "":
                continue
            near = {id(node): node} | {id(v): v for b, v in node.items() if b not in ("", c)} | {id(v): v for b, v in child.items() if b != ""}
            for v in active:
                if c in v:
                    near[id(v[c])] = v[c]
            near.pop(id(child), None)
            if "" in child:
                own = child[""]
                for v in near.values():
                    other = v.get("")
                    if other and own < other and (len(own[0]) == size or len(other[0]) == size):
                        yield own, other
            if len(child) > ("" in child):
                stack.append((child, list(near.values())))


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, near, near_n: both directions of every pair of words at distance one, perhaps more than once."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out: tuple[list, list, list] = ([], [], [])

        def pairs() -> None:
            size, lo, hi = key[:3]
            if len(group) > 1 and any(len(w) == size for w, _ in group):
                for x, y in trie_pairs([(w[lo : len(w) - size + hi], w, n) for w, n in group], size):
                    for a, b in ((x, y), (y, x)):
                        for column, value in zip(out, (a[0], *b), strict=True):
                            column.append(value)

        def batch_of() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
            for column in out:
                column.clear()
            return got

        for batch in batches:
            for word, n, size, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "size", "lo", "hi")), strict=True):
                new = (size, lo, hi, word[:lo], word[len(word) - size + hi :])
                if new != key:
                    if key:
                        pairs()
                    key, group = new, []
                    if len(out[0]) > 10_000:
                        yield batch_of()
                group.append((word, n))
        if key:
            pairs()
        yield batch_of()

    keys = ["size", "lo", "hi", "prefix", "suffix"]
    dealt = _subtrees(words, min_length).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select("word", "n", "size", "lo", "hi").mapInArrow(join, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): each word's last form; every round looks twice as far."""
    current = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = current.select(F.col("word").alias("w"), F.col("root").alias("r"))
        after = current.join(broadcast_if_small(then, BROADCAST_ROWS), F.col("root") == F.col("w"), "left")
        after = materialise(after.select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        current = after.drop("moved")


def variants(words: DataFrame, min_length: int = MIN_LENGTH, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    words = materialise(words, "vocabulary")
    best = F.struct((-F.col("near_n")).alias("less"), F.col("near"))
    near = near_pairs(words, min_length).groupBy("word").agg(F.collect_set(best).alias("all"))
    near = near.select(F.col("word").alias("w"), F.size("all").cast("long").alias("n_near"), F.array_min("all").alias("best"))
    rows = words.join(near, F.col("word") == F.col("w"), "left")
    has = -F.col("best.less") >= factor * F.col("n")
    rows = materialise(
        rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "near-words"
    )
    roots = _roots(rows.where("form is not null")).select(F.col("word").alias("w"), "root")
    out = rows.join(broadcast_if_small(roots, BROADCAST_ROWS), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of all documents, see variants()."""
    return variants(vocabulary(docs))


#: Words at distance one: both without the same place are equal, or one without a place is the other.
SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
tok AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS k, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM tok WHERE length(run) >= {MIN_LENGTH} GROUP BY doc_id, run),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i:
           16 * (instr('0123456789ABCDEF', substr(x, i, 1)) - 1) + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM runs, tab),
w AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.v = b.word),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FACTOR} * n THEN near END AS form, CASE WHEN near_n >= {FACTOR} * n THEN near_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS d FROM f UNION ALL SELECT walk.word, f.form, d + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL)
SELECT f.word, form, r.here AS root, n, n_near, form_n
FROM f JOIN (SELECT word, here FROM walk QUALIFY row_number() OVER (PARTITION BY word ORDER BY d DESC) = 1) r USING (word)
"""
