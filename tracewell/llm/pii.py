"""Personal data: exact base spans, and more by bootstrapped contextual extraction; DataFrame functions only.

Base spans (email, ip, card, phone) are the seeds. With `secrets`, so are keys: runs of 32 hexadecimal digits or more, of a kind of
their own, `secret`, behind the others; `find_pii` leaves them out unless asked, `mask_pii` masks them. Every candidate (a token with an @, a token of 16 letters and digits or more, a stretch of six
digits or more with separators) gives lexical patterns from the text around it: the two words before; the word
before; the word before with the word after; the word before with the value's shape. Patterns and candidate values
form a graph. In each round a pattern's mean confidence over all its values is known for each kind, and its score is the
lower end of the Wilson interval of that mean, so how many values a pattern needs follows from how pure it is: seven
known ones if all are of one kind, more otherwise. A value not known yet takes the score of its best pattern of
CONFIDENCE or more. Rounds go on until no value is added; scores only grow, so they end. Counts are combined before each shuffle, scores are broadcast
below a counted bound, and so a frequent pattern is one row per task.

Cost: linear in a text's length, and in its matches up to a square over GROUP**2. No length is capped.

Offsets are code points, end exclusive. Defined cases: a null text is empty; an empty text has no span; repeated
rows get equal results; a null doc_id stays; an empty table gives no rows; further columns are ignored by
`find_pii` and kept by `mask_pii`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, broadcast_if_small

KINDS = ["email", "ip", "card", "phone"]
#: All names of spans: those of the base patterns, and keys.
NAMES = [*KINDS, "secret"]
_LOCAL = "A-Za-z0-9._%+-"
#: The contract's patterns, with possessive repeats and a look behind that only skip starts which must fail.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = "|".join([
    r"(?<![^\s@])[^\s@]++@[^\s@]++",
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+",
    r"(?<![A-Za-z0-9])\+?\(?[0-9]++(?:[\x20().-]*+[0-9]++)*+",
])
SECRET = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
#: Least score of a pattern, and the normal quantile of its interval.
CONFIDENCE, Z = 0.7, 1.645
BROADCAST_ROWS = 2_000_000
#: Matches whose places are found by one running sum, and characters of a piece that is masked by itself.
GROUP, PIECE = 64, 4096
SPAN = "array<struct<k:int,s:int,e:int>>"
MATCH = "array<struct<s:int,e:int,value:string,left:string,right:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where the body uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, size: Callable[[Column], Column], make: Callable[[Column, Column], Column], kind: str) -> Column:
    """make(item, sum of the sizes before it) of each item; kind is the type of the result."""

    def one(group: Column, start: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.array_append(a["out"], make(x, a["at"])).alias("out"))
        return F.aggregate(group, F.struct(start.alias("at"), F.expr(f"cast(array() AS {kind})").alias("out")), step, lambda a: a["out"])

    def by_group(groups: Column) -> Column:
        total = lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + size(x))
        start = F.expr("struct(0 AS at, cast(array() AS array<int>) AS out)")
        grow = lambda a, t: F.struct((a["at"] + t).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        return F.flatten(F.zip_with(groups, F.aggregate(F.transform(groups, total), start, grow, lambda a: a["out"]), one))

    def cut(all_items: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_items) / GROUP).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(all_items, g * GROUP + 1, F.lit(GROUP)))

    return _let(_let(items, cut), by_group)


def _found(text: Column, pattern: str, around: bool = False) -> Column:
    """array of (s, e, value, left, right) of all matches, left to right: what lies between matches gives their places.

    left and right are the texts up to the matches next to it, if asked for.
    """

    def places(gaps: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        none = F.lit("")
        pairs = F.zip_with(values, F.slice(gaps, 1, F.size(gaps) - 1), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("n"), (g if around else none).alias("l")))
        items = F.zip_with(pairs, F.slice(gaps, 2, F.size(gaps)), lambda p, g: F.struct(p["v"].alias("v"), p["n"].alias("n"), p["l"].alias("l"), (g if around else none).alias("r")))
        size = lambda x: x["n"] + F.length(x["v"])
        make = lambda x, at: F.struct((at + x["n"]).alias("s"), (at + size(x)).alias("e"), x["v"].alias("value"), x["l"].alias("left"), x["r"].alias("right"))
        return _running(items, size, make, MATCH)

    return F.when(text.rlike(pattern), _let(F.split(text, pattern, -1), places)).otherwise(F.expr(f"cast(array() AS {MATCH})"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(16, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array of (k, s, e) by kind and then start; k is the kind's place in KINDS."""

    def of_kind(k: int, kind: str) -> Column:
        good = F.filter(_found(text, PATTERNS[kind]), lambda x: valid(kind, x["value"]))
        return F.transform(good, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    return F.concat(*(of_kind(k, kind) for k, kind in enumerate(KINDS))).cast(SPAN)


def candidates(text: Column) -> Column:
    """array of (s, e, value, before, after): what may be an identifier, with two words before it and one after it."""

    def words(x: Column) -> Column:
        before = F.regexp_extract(F.lower(x["left"]), r"(?<!\S)((?:\S++\s++)?\S++)\s*+$", 1)
        after = F.regexp_extract(F.lower(x["right"]), r"^\s*+(\S++)", 1)
        spaced = F.regexp_replace(before, r"\s+", " ")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"), spaced.alias("before"), after.alias("after"))

    found = F.filter(_found(text, CANDIDATE, True), lambda x: x["value"].contains("@") | (F.length(_digits(x["value"])) >= 6) | (F.length(x["value"]) >= 16))
    return F.transform(found, words)


def context_patterns(x: Column) -> Column:
    """The lexical patterns of a candidate, each with a mark of its form."""
    last = F.regexp_extract(x["before"], r"(\S++)$", 1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["value"], "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    shape = F.regexp_replace(shape, "[9aA]{3,}", "x")  # keys mix digits and letters at will
    return F.array(
        F.concat(F.lit("2 "), x["before"]), F.concat(F.lit("1 "), last),
        F.concat(F.lit("r "), last, F.lit(" _ "), x["after"]), F.concat(F.lit("s "), last, F.lit(" "), shape),
    )


def wilson(share: Column, n: Column, z: float = Z) -> Column:
    """Lower end of the Wilson interval of a share of n."""
    centre = share + z * z / (2 * n)
    return (centre - z * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def discovered(scanned: DataFrame, lasting: Scratch, confidence: float = CONFIDENCE, secrets: bool = False) -> DataFrame:
    """key, more: the spans that high-confidence patterns, and keys if asked for, add to a document, from (key, base, cands)."""
    scratch = Scratch()
    rows = scanned.where("size(cands) > 0").dropDuplicates(["key"]).select("key", "base", F.explode("cands").alias("x"))
    hit = F.filter("base", lambda b: (b["s"] < F.col("x.e")) & (F.col("x.s") < b["e"]))
    kind = F.when(F.size(hit) > 0, F.element_at(hit, 1)["k"])
    kind = kind.when(F.col("x.value").rlike(SECRET), len(KINDS)) if secrets else kind
    rows = scratch(rows.select("key", "x.s", "x.e", "x.value", kind.alias("kind"), context_patterns(F.col("x")).alias("patterns")), "pii-candidates")
    graph = rows.select("value", "kind", F.explode("patterns").alias("pattern")).groupBy("value", "pattern").agg(F.max("kind").alias("kind"))
    seeds = scratch(rows.where("kind is not null").groupBy("value").agg(F.max("kind").alias("as_kind"), F.lit(1.0).alias("c")), "pii-seeds")
    graph = scratch(graph.select("value", "pattern"), "pii-graph")
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    sizes = scratch(sizes.where(wilson(F.lit(1.0), F.col("n")) >= confidence), "pii-patterns")
    known, added = seeds, 0
    while True:
        scores = graph.join(broadcast_if_small(known, BROADCAST_ROWS), "value").groupBy("pattern", "as_kind").agg(F.sum("c").alias("c")).join(sizes, "pattern")
        scores = scores.withColumn("score", wilson(F.least(F.col("c") / F.col("n"), F.lit(1.0)), F.col("n"))).where(F.col("score") >= confidence)
        scores = scratch(scores.select("pattern", "as_kind", "score"), "pii-scores")
        best = graph.join(broadcast_if_small(scores, BROADCAST_ROWS), "pattern").groupBy("value").agg(F.max(F.struct("score", (-F.col("as_kind")).alias("k"))).alias("b"))
        new = best.join(broadcast_if_small(seeds.select("value"), BROADCAST_ROWS), "value", "left_anti")
        new = scratch(new.select("value", (-F.col("b.k")).alias("as_kind"), F.col("b.score").alias("c")), "pii-new")
        known, before, added = seeds.unionByName(new), added, new.count()
        if added == before:
            break
    found = rows.where(f"kind is null or kind >= {len(KINDS)}").drop("kind").join(broadcast_if_small(scratch(known, "pii-known"), BROADCAST_ROWS), "value")
    span = F.struct(F.col("as_kind").alias("k"), F.col("s"), F.col("e"))
    more = lasting(found.groupBy("key").agg(F.array_sort(F.collect_set(span)).cast(SPAN).alias("more")), "pii-more")
    scratch.drop()
    return more


def _key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with `key__`, an identity of id and text, and `text__`, the text or the empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), text), 256), 1, 32))
    return docs.withColumns({"text__": text, "key__": key})


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = _key(docs, id_col, text_col)
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col("key__").alias("key"), base_spans(F.col("text__")).alias("base"), candidates(F.col("text__")).alias("cands"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", secrets: bool = False) -> DataFrame:
    """doc_id, key__, base and spans: arrays of (k, s, e), base ones in their order and all, by kind and start."""
    lasting = Scratch()
    scanned = lasting(_scanned(docs, id_col, text_col), "pii-scan")
    more = broadcast_if_small(discovered(scanned, lasting, secrets=secrets), BROADCAST_ROWS)
    joined = scanned.select("doc_id", "key", "base").join(more, "key", "left")
    spans = F.array_sort(F.array_union("base", F.coalesce("more", F.expr(f"cast(array() AS {SPAN})"))))
    return joined.select("doc_id", F.col("key").alias("key__"), "base", spans.alias("spans"))


def spell(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = (count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS))
    return found.select("doc_id", *counts, F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first to start names the gap.

    Pieces of the text are masked by themselves: a span is named in the piece in which it starts.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in NAMES))

    def of_piece(piece: Column, begin: Column, sorted_spans: Column) -> Column:
        here = F.filter(sorted_spans, lambda x: (x["s"] < begin + PIECE) & (x["e"] > begin))
        start = F.expr("struct(0 AS at, cast(array() AS array<string>) AS out)")

        def step(a: Column, x: Column) -> Column:
            s, e = x["s"] - begin, F.least(x["e"] - begin, F.lit(PIECE))
            named = F.concat(a["out"], F.array(F.substring(piece, a["at"] + 1, s - a["at"]), F.get(names, x["k"])))
            return F.struct(F.greatest(a["at"], e).alias("at"), F.when(s < a["at"], a["out"]).otherwise(named).alias("out"))

        rest = lambda a: F.array_join(F.array_append(a["out"], F.substring(piece, a["at"] + 1, F.lit(PIECE))), "")
        return F.when(F.size(here) == 0, piece).otherwise(F.aggregate(here, start, step, rest))

    def whole(sorted_spans: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return F.when(F.size(sorted_spans) == 0, text).otherwise(F.array_join(F.transform(pieces, lambda p, i: of_piece(p, i * PIECE, sorted_spans)), ""))

    return _let(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))), whole)


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", secrets: bool = True) -> DataFrame:
    """The documents with personal data in their texts replaced; documents without any are as they were.

    Base spans are found anew where a text lies; only what patterns add is joined to it, broadcast below a counted bound.
    """
    scratch, lasting = Scratch(), Scratch()
    more = discovered(scratch(_scanned(docs, id_col, text_col).where("size(cands) > 0"), "pii-scan"), lasting, secrets=secrets)
    scratch.drop()
    named = [F.col(f"`{c}`") for c in docs.columns]  # as one struct, so that no column's name clashes
    rows = _key(docs.select(F.struct(*named).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")
    rows = rows.join(broadcast_if_small(more.select(F.col("key").alias("key__"), "more"), BROADCAST_ROWS), "key__", "left")
    spans = F.concat(base_spans(F.col("text__")), F.coalesce("more", F.expr(f"cast(array() AS {SPAN})")))
    own = F.col("row").getField(text_col)
    text = F.when(own.isNull(), own).otherwise(masked(F.col("text__"), spans))
    return rows.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
