"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by a fold of native expressions.

Each row gets its fault from flags: blank and truncated from its text, duplicate from the first place of its role and text
in the conversation, illegal neighbours from a window. A fold, `aggregate()` over sorted structs of turns, carries four
(cost, audit) structs, one for each state that the roles so far can be in (nothing yet, after system, after user, after
assistant), and takes the least of all edits that lead to a state: of equal costs the least audit. Prefixes of equal cost and
state are never one the beginning of the other (only insertions could follow, and they cost), so the least prefix gives the
least whole audit.

Rows carry a digest in place of their text until the end. They are put in order by one range shuffle, also within a
conversation, and folded in blocks of BLOCK rows: a block of a conversation is folded once for each state it can be entered
in, and the blocks' results, 4 x 4 structs, are put together in order. So a conversation of any number of turns is never one
array of its turns, nor one task's, until its audit, which the result has as one value, and its hash: texts of kept
rows move once, by conversation, and are hashed one after the other as they stream by, as SHA-256 can't be put together from parts.

Defined cases: nulls in conv_id, turn, role and text count as one space where they are read as text; an empty role, like any other
that begins with neither s, u nor a, can't be kept; rows of a null conv_id are
one conversation; a null turn comes first; rows of the same turn are ordered by the SHA-256 of role and text; repeated rows are
duplicates; very long texts move whole; a conversation without rows after damage has zeros, an empty audit and the hash of
nothing; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_if_small, materialise

#: Rows of a conversation that are folded as one array.
BLOCK = 256
BROADCAST_ROWS = 500_000
#: Costs of edits, and more than any repair costs.
REROLE, DELETE, INSERT, UNFINISHED, NEVER = 1, 2, 5, 5, 1 << 50
#: States by number: nothing yet, after system, after user, after assistant. A repaired conversation ends in the first or last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_SPACE = " \t\n\x0b\f\r"
_IN_PART = (1 << 33) - 1


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with the faults that crc32(`conv_id:turn`) % 20 deals out: dropped, emptied, without sentence ends, repeated, or given to the user."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def _keyed(turns: DataFrame) -> DataFrame:
    """turns with `key`, a digest that stands for role and text, and `body`, the text without white space at its end."""
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return turns.withColumns({"key": key, "body": F.rtrim(F.col("text"), F.lit(_SPACE))})


def _ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, key, initial, blank, unfinished and `pos`, the row's place in the order of conversations and turns."""
    rows = _keyed(turns).select(
        "conv_id", "turn", "key", F.substring("role", 1, 1).alias("initial"), (F.col("body") == "").alias("blank"),
        (~F.substring("body", -1, 1).isin(".", "!", "?")).alias("unfinished"),
        (F.monotonically_increasing_id() % 1009).alias("salt"),
    )
    # the salt deals out copies of one row, which may change places
    rows = rows.repartitionByRange("conv_id", "turn", "key", "salt").sortWithinPartitions("conv_id", "turn", "key").drop("salt")
    rows = rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PART))})
    rows = materialise(rows, "turns-in-order")
    # one row a part of the shuffle
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(parts.select("part", before.alias("start")), "turn-starts")
    rows = rows.join(broadcast_if_small(starts, BROADCAST_ROWS), "part")
    return rows.withColumn("pos", F.col("start") + F.col("at")).drop("part", "at", "start")


def _flagged(rows: DataFrame) -> DataFrame:
    """rows with each row's first fault: blank, duplicate, truncated; and block."""
    firsts = rows.where("not blank").groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    firsts = materialise(firsts.where("n > 1").drop("n"), "turns-said-again")
    joined = rows.join(broadcast_if_small(firsts, BROADCAST_ROWS), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    return joined.select(
        "conv_id", "turn", "key", "initial", "pos", F.floor(F.col("pos") / BLOCK).alias("block"), "blank", duplicate.alias("duplicate"),
        (~F.col("blank") & ~duplicate & F.col("unfinished")).alias("truncated"),
    )


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _with(state: Column, cost: Column | int, letter: str) -> Column:
    """A state after one more edit."""
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def _entered(entry: Column) -> Column:
    """The four states of a fold that is entered in the state `entry`, with insertions before the first row."""
    never = _state(F.lit(NEVER), F.lit(""))
    start = lambda x: F.when(entry == x, _state(F.lit(0), F.lit("")))
    one, two = _state(F.lit(INSERT), F.lit("I")), _state(F.lit(2 * INSERT), F.lit("II"))
    return F.array(start(EMPTY).otherwise(never), start(SYSTEM).otherwise(never), start(USER).otherwise(one), start(ASSISTANT).when(entry == USER, one).otherwise(two))


def _after(states: Column, row: Column) -> Column:
    """The four states after one row and insertions behind it."""
    was = [states[k] for k in range(4)]
    wait = F.when(row["truncated"], UNFINISHED).otherwise(0)
    stays = ~(row["blank"] | row["duplicate"])
    keep = lambda initial: F.when(stays & (row["initial"] == initial), wait).otherwise(NEVER)
    rerole = F.when(stays, wait + REROLE).otherwise(NEVER)
    to_user = F.least(was[EMPTY], was[SYSTEM], was[ASSISTANT])  # the same letter after each of them keeps their order
    drop = [_with(s, DELETE, "D") for s in was]
    system = F.least(drop[SYSTEM], _with(was[EMPTY], keep("s"), "K"))
    user = F.least(drop[USER], _with(to_user, keep("u"), "K"), _with(to_user, rerole, "R"))
    assistant = F.least(drop[ASSISTANT], _with(was[USER], keep("a"), "K"), _with(was[USER], rerole, "R"))
    user = F.least(user, _with(F.least(drop[EMPTY], system, assistant), INSERT, "I"))
    assistant = F.least(assistant, _with(user, INSERT, "I"))
    return F.array(drop[EMPTY], system, user, assistant)


def _folded(flagged: DataFrame) -> DataFrame:
    """A row for each conversation and block: counts of faults, its ends, its turns, and `ways`: for each state to enter in, the four states to leave in."""
    within = Window.partitionBy("conv_id", "block").orderBy("pos")
    flagged = flagged.withColumns({
        "illegal": F.concat(F.lag("initial").over(within), "initial"),
        "fresh": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(within)),
    }).withColumn("illegal", F.coalesce(~F.col("illegal").isin("su", "ua", "au"), F.lit(False)))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    row = F.struct("pos", "turn", "initial", "key", "blank", "duplicate", "truncated")
    blocks = flagged.groupBy("conv_id", "block").agg(
        *(count(c) for c in ("blank", "duplicate", "truncated", "illegal", "fresh")),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.array_sort(F.collect_list(row)).alias("turns"),
    )
    # only a block's first conversation can have begun in an earlier block
    goes_on = F.col("turns")[0]["pos"] % BLOCK == 0
    entries = F.when(goes_on, F.array(*(F.lit(k) for k in range(4)))).otherwise(F.array(F.lit(EMPTY)))
    ways = F.transform(entries, lambda x: F.struct(x.alias("entry"), F.aggregate("turns", _entered(x), _after).alias("out")))
    return blocks.withColumn("ways", ways)


def _joined(blocks: DataFrame) -> DataFrame:
    """A row for each conversation that has turns: faults, cost, audit and path, the states at the blocks' ends as digits."""
    end = lambda k: F.struct(F.col("turns")[k]["initial"].alias("initial"), F.col("turns")[k]["turn"].alias("turn"))
    part = F.struct("block", "ways", end(0).alias("first"), F.element_at("turns", -1).alias("last"))
    convs = blocks.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "fresh")), F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    # neighbours across the edges of blocks
    n = F.size("parts")
    edges = F.zip_with(F.slice("parts", 1, n - 1), F.slice("parts", 2, n - 1), lambda x, y: F.struct(x["last"].alias("x"), y["first"].alias("y")))
    illegal = F.size(F.filter(edges, lambda e: ~F.concat(e["x"]["initial"], e["y"]["initial"]).isin("su", "ua", "au")))
    same = F.size(F.filter(edges, lambda e: F.coalesce(e["x"]["turn"] == e["y"]["turn"], F.lit(False))))

    def step(states: Column, part: Column) -> Column:
        def way(x: Column, to: Column) -> Column:
            was, then = F.element_at(states, x["entry"] + 1), F.element_at(x["out"], to + 1)
            return F.struct((was["cost"] + then["cost"]).alias("cost"), F.concat(was["audit"], then["audit"]).alias("audit"), F.concat(was["path"], x["entry"].cast("string")).alias("path"))

        return F.transform(F.array(*(F.lit(k) for k in range(4))), lambda to: F.array_min(F.transform(part["ways"], lambda x: way(x, to))))

    start = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path"))
    states = F.aggregate("parts", F.array(start(0), *(start(NEVER) for _ in range(3))), step)
    convs = convs.withColumn("s", states)
    ended = lambda k: F.struct(F.col("s")[k]["cost"].alias("cost"), F.col("s")[k]["audit"].alias("audit"), F.concat(F.col("s")[k]["path"], F.lit(str(k))).alias("path"))
    return convs.select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("fresh") - same), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", (F.col("illegal") + illegal).alias("illegal"), F.least(ended(EMPTY), ended(ASSISTANT)).alias("best"),
        F.transform("parts", lambda p: p["block"]).alias("blocks"),
    )


def _lines(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each turn of the repaired conversations: conv_id, block and j for its place, key (null if inserted), role (null: its own)."""
    ways = convs.select(F.col("conv_id").alias("c"), "best.path", F.posexplode("blocks").alias("k", "b"))
    ways = ways.select("c", "b", *(F.substring("path", F.col("k") + i, F.lit(1)).cast("int").alias(s) for i, s in ((1, "enter"), (2, "leave"))))
    own = blocks.join(ways, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    way = F.filter("ways", lambda x: x["entry"] == F.col("enter"))[0]
    own = own.select("conv_id", "block", "turns", "enter", F.element_at(way["out"], F.col("leave") + 1)["audit"].alias("audit"))
    letters = F.transform(F.sequence(F.lit(1), F.length("audit")), lambda i: F.substring("audit", i, F.lit(1)))

    def step(a: Column, letter: Column) -> Column:
        row = F.get("turns", a["i"])
        system = (letter == "K") & (row["initial"] == "s")
        state = F.when(letter == "D", a["state"]).when(system, SYSTEM).when(a["state"] == USER, ASSISTANT).otherwise(USER)
        role = F.when(letter != "K", F.when(state == USER, "user").otherwise("assistant"))
        line = F.struct(F.size(a["out"]).alias("j"), F.when(letter != "I", row["key"]).alias("key"), role.alias("role"))
        out = F.when(letter == "D", a["out"]).otherwise(F.concat(a["out"], F.array(line)))
        return F.struct((a["i"] + F.when(letter == "I", 0).otherwise(1)).alias("i"), state.alias("state"), out.alias("out"))

    none = F.array().cast("array<struct<j:int,key:binary,role:string>>")
    out = F.aggregate(letters, F.struct(F.lit(0).alias("i"), F.col("enter").alias("state"), none.alias("out")), step, lambda a: a["out"])
    return own.select("conv_id", "block", F.explode(out).alias("x")).select("conv_id", "block", "x.*")


class Repair:
    """One repair of a table of turns: `convs` has a row for each conversation with turns, `turns()` the repaired conversations."""

    def __init__(self, turns: DataFrame):
        self.source = turns
        self.blocks = materialise(_folded(_flagged(_ordered(turns))), "folded-blocks")
        self.convs = materialise(_joined(self.blocks), "repaired-conversations")

    def turns(self) -> DataFrame:
        """conv_id, block, j, role, text of the repaired conversations, dealt by conv_id and in order of conv_id, block, j in each partition."""
        lines = _lines(self.blocks, self.convs).select("conv_id", "key", F.struct("block", "j", "role").alias("line"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        texts = _keyed(self.source).where(F.col("body") != "").select("conv_id", "key", F.lit(None).cast(lines.schema["line"].dataType).alias("line"), "role", "text")
        # a line and the texts of its key meet in the conversation's partition, the line first; of equal texts one is enough
        both = lines.unionByName(texts).repartition("conv_id")
        own = Window.partitionBy("conv_id", "key").orderBy(F.col("line").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumns({"place": F.first("line").over(own), "n": F.sum(F.col("line").isNull().cast("int")).over(own)})
        inserted = F.col("key").isNull()
        both = both.where(inserted | (F.col("place").isNotNull() & (F.col("n") == 1)))
        place = lambda c: F.when(inserted, F.col("line")[c]).otherwise(F.col("place")[c])
        out = both.select("conv_id", place("block").alias("block"), place("j").alias("j"), F.coalesce(place("role"), "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        return out.sortWithinPartitions("conv_id", "block", "j")


def text_hashes(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of each conversation's lines `role:text`; turns as `Repair.turns` deals them, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = (), hashlib.sha256()
        for batch in batches:
            ids, hashes = [], []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role"), batch.column("text"), strict=True):
                if at != (conv,):
                    if at:
                        ids, hashes = [*ids, at[0]], [*hashes, digest.hexdigest()]
                    at, digest = (conv,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role.as_py()}:{text.as_py()}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return turns.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the table: faults after damage, the cheapest repair's cost and audit, and the repaired text's hash."""
    turns = turns_of(conversations)
    repair = Repair(damaged(turns))
    hashes = text_hashes(repair.turns()).select(F.col("conv_id").alias("h"), "repaired_sha256")
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(repair.convs, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("h")), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias("conv_id"), *(number(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), number("best.cost").alias("cost"),
        F.coalesce("best.audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


#: crc32 by its table of 256 values, then one row a step with the four states as texts of fixed cost width, so that least() compares both.
SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
dealt AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS d
  FROM src, tab),
dam AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM dealt WHERE d <> 0),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text), copy) AS i,
         regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM dam),
fl AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
         substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM pos),
ro AS (
  SELECT *, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, NOT blank AND NOT duplicate AS stays FROM fl),
co AS (
  SELECT *, CASE WHEN truncated THEN 5 ELSE 0 END AS w FROM ro),
fold AS (
  SELECT conv_id, 0::BIGINT AS i, '100000000' AS e, '900000000' AS s, '100000005I' AS u, '100000010II' AS a FROM (SELECT DISTINCT conv_id FROM co)
  UNION ALL
  SELECT conv_id, i, e, s, u2, least(a1, (left(u2, 9)::BIGINT + 5)::VARCHAR || substr(u2, 10) || 'I')
  FROM (SELECT *, least(u1, (left(f, 9)::BIGINT + 5)::VARCHAR || substr(f, 10) || 'I') AS u2
  FROM (SELECT *, least(e, s, a1) AS f
  FROM (SELECT c.conv_id, c.i,
               (left(f.e, 9)::BIGINT + 2)::VARCHAR || substr(f.e, 10) || 'D' AS e,
               least((left(f.s, 9)::BIGINT + 2)::VARCHAR || substr(f.s, 10) || 'D',
                     CASE WHEN stays AND r = 's' THEN (left(f.e, 9)::BIGINT + w)::VARCHAR || substr(f.e, 10) || 'K' ELSE '950000000' END) AS s,
               least((left(f.u, 9)::BIGINT + 2)::VARCHAR || substr(f.u, 10) || 'D',
                     CASE WHEN stays AND r = 'u' THEN (left(least(f.e, f.s, f.a), 9)::BIGINT + w)::VARCHAR || substr(least(f.e, f.s, f.a), 10) || 'K' ELSE '950000000' END,
                     CASE WHEN stays THEN (left(least(f.e, f.s, f.a), 9)::BIGINT + w + 1)::VARCHAR || substr(least(f.e, f.s, f.a), 10) || 'R' ELSE '950000000' END) AS u1,
               least((left(f.a, 9)::BIGINT + 2)::VARCHAR || substr(f.a, 10) || 'D',
                     CASE WHEN stays AND r = 'a' THEN (left(f.u, 9)::BIGINT + w)::VARCHAR || substr(f.u, 10) || 'K' ELSE '950000000' END,
                     CASE WHEN stays THEN (left(f.u, 9)::BIGINT + w + 1)::VARCHAR || substr(f.u, 10) || 'R' ELSE '950000000' END) AS a1
        FROM fold f JOIN co c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.i = f.i + 1)))),
best AS (SELECT conv_id, least(e, a) AS b FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
walk AS (
  SELECT conv_id, substr(b, 10) AS audit, left(b, 9)::BIGINT - 100000000 AS cost, unnest(range(1, length(b) - 8)) AS j FROM best),
ed AS (
  SELECT conv_id, j, substr(audit, j, 1) AS x, length(replace(substr(audit, 1, j), 'I', '')) AS i,
         length(replace(substr(audit, 1, j - 1), 'D', '')) AS kept FROM walk),
ln AS (
  SELECT ed.conv_id, j, x, kept, c.role, c.text, first_value(x = 'K' AND c.r = 's') OVER (PARTITION BY ed.conv_id ORDER BY j) AS led
  FROM ed LEFT JOIN co c ON x <> 'I' AND c.conv_id IS NOT DISTINCT FROM ed.conv_id AND c.i = ed.i WHERE x <> 'D'),
rep AS (
  SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (kept - led::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
  FROM ln GROUP BY conv_id),
st AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM co GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(b, 9)::BIGINT - 100000000, 0) AS cost,
       coalesce(substr(b, 10), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM o.conv_id
"""
