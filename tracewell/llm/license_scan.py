"""License scans: fuzzy search of short notices by exact seeds, verified by bounded-error matching.

Texts are reduced to their words, lower-cased and joined by single spaces. A notice of m characters may differ from the text by k edits,
a tenth of m. Cut into k + 1 pieces, at least one piece of it stands in every such place unchanged (pigeonhole), so one
automaton over all pieces (Aho-Corasick) finds all candidates in one pass over the text. The seeds of one notice that lie
within k of one diagonal are one candidate, a window of m + 3k characters at most; there the regex library's bounded-error
matching looks for the best match, counts its edits and gives its span. Nothing with at most k edits is missed, and no
window is longer than a notice allows, however often seeds repeat.

Of overlapping matches that with the least share of edits stays (ties: the longer notice, then the earlier in NOTICES), so that a
notice isn't reported for its close relatives too. The score of a document is 1 where a base phrase stands, else the greatest
1 - edits / m of its matches, 0 without any.

Defined cases: a null or empty text has no words, empty labels and score 0; texts are read whole, with some ten bytes of memory
a byte; repeated rows give repeated results; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and labels, fixed values.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Short notices of known licenses as words, with the method's labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("licensed under a creative commons attribution", "cc-by"),
]
#: A notice of m characters may differ by m / EDIT_SHARE edits.
EDIT_SHARE = 10
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string,notice:int,first_word:long,end_word:long,start:long,end:long,edits:int>>"
)
#: Everything between words becomes a space, A-Z lower case.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_words(text: bytes) -> bytes:
    """The text's words in lower case, with a space between each two."""
    return re.sub(b"  +", b" ", text.translate(_PLAIN)).strip(b" ")


def base_places(words: bytes, phrases: list[tuple[str, str]] = BASE) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand one after the other, in no order of phrases."""
    found = []
    for phrase, label in phrases:
        needle, seen, index = phrase.encode(), 0, 0
        at = words.find(needle)
        while at >= 0:
            index, seen = index + words.count(b" ", seen, at), at
            end = at + len(needle)
            if (not at or words[at - 1] == 0x20) and (end == len(words) or words[end] == 0x20):
                found.append((index, label))
            at = words.find(needle, at + 1)
    return found


class NoticeSearch:
    """Finds the places of notices with few edits in texts of plain words."""

    def __init__(self, notices: tuple[str, ...], edit_share: int = EDIT_SHARE):
        import ahocorasick
        import regex

        self.notices, self.edits = notices, [max(1, len(n) // edit_share) for n in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for n, k in zip(notices, self.edits, strict=True)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, k) in enumerate(zip(notices, self.edits, strict=True)):
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(notice[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def candidates(self, words: str) -> Iterator[tuple[int, int, int]]:
        """(notice, start, end) of each window that can hold a match."""
        diagonals: dict[int, list[int]] = {}
        for last, (length, uses) in self.automaton.iter(words):
            for i, offset in uses:
                diagonals.setdefault(i, []).append(last - length + 1 - offset)
        for i, own in diagonals.items():
            m, k = len(self.notices[i]), self.edits[i]
            own.sort()
            first = last = own[0]
            for d in [*own[1:], None]:
                if d is None or d > first + k:
                    yield i, max(0, first - k), min(len(words), last + m + k)
                    first = d
                last = d

    def matches(self, words: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of the best match of each window that has one, before overlaps are resolved."""
        found = set()
        for i, start, end in self.candidates(words):
            if m := self.patterns[i].search(words, start, end):
                found.add((i, m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(found)

    def resolved(self, words: str) -> list[tuple[int, int, int, int]]:
        """matches() without those that a better one overlaps, in order of place."""
        taken: list[tuple[int, int, int, int]] = []
        of = self.matches(words)
        of.sort(key=lambda x: (x[3] / len(self.notices[x[0]]), -len(self.notices[x[0]]), x[0], x[1]))
        starts: list[int] = []
        for x in of:
            j = bisect_left(starts, x[1])
            before, behind = taken[j - 1] if j else None, taken[j] if j < len(taken) else None
            if (before is None or before[2] <= x[1]) and (behind is None or behind[1] >= x[2]):
                insort(starts, x[1])
                taken.insert(j, x)
        return taken


@lru_cache(maxsize=4)
def _search(notices: tuple[str, ...], edit_share: int) -> NoticeSearch:
    return NoticeSearch(notices, edit_share)


def _places(text: bytes, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (start, end) in text of word ranges that stand in order."""
    out, k, at, points = [], 0, 0, 0
    edges = {}
    need = sorted({i for a, b in wanted for i in (a, b - 1)})
    for i, w in enumerate(_WORD.finditer(text)):
        if i == need[k]:
            points += len(text[at : w.start()].decode(errors="replace"))
            width = len(w.group().decode(errors="replace"))
            edges[i], at, points = (points, points + width), w.end(), points + width
            k += 1
            if k == len(need):
                break
    for a, b in wanted:
        out.append((edges[a][0], edges[b - 1][1]))
    return out


def scan_text(text: bytes, search: NoticeSearch, labels: list[str], phrases: list[tuple[str, str]] = BASE) -> tuple:
    """One document's columns after doc_id, see SCHEMA."""
    words = plain_words(text)
    base = base_places(words, phrases)
    at = [i for i, _ in base]
    plain = words.decode(errors="replace")
    found = search.resolved(plain)
    matches, index, seen = [], 0, 0
    for i, start, end, edits in found:
        # from the match's first letter to its last, without spaces at its ends
        start, end = start + (plain[start] == " "), end - (plain[end - 1] == " ")
        index, seen = index + plain.count(" ", seen, start), start
        matches.append((i, index, index + plain.count(" ", start, end) + 1, edits))
    spans = _places(text, [(a, b) for _, a, b, _ in matches]) if matches else []
    base_labels = {label for _, label in base}
    score = 1.0 if base else max([0.0, *(1 - e / len(search.notices[i]) for i, _, _, e in matches)])
    rows = [
        {"label": labels[i], "notice": i, "first_word": a, "end_word": b, "start": s, "end": e, "edits": k}
        for (i, a, b, k), (s, e) in zip(matches, spans, strict=True)
    ]
    every = base_labels | {r["label"] for r in rows}
    return (
        words.count(b" ") + 1 if words else 0, len(base), min(at, default=None), max(at, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(every)), score, rows,
    )


def scan_licenses(
    docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: list[tuple[str, str]] = BASE, edit_share: int = EDIT_SHARE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document, see SCHEMA: words, places of base phrases, labels, score, and each match of a notice with its label,
    its number in notices, its words (end exclusive), its code points in the whole text (end exclusive) and its edits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(tuple(n for n, _ in notices), edit_share)
        labels = [label for _, label in notices]
        types = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", match)])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("text").cast(pa.large_binary())
                rows = [scan_text(t.as_py() or b"", search, labels, phrases) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", *types.names]
                )

    match = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), *((c, pa.int64()) for c in ("first_word", "end_word", "start", "end")), ("edits", pa.int32())]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, SCHEMA)


def license_digest(found: DataFrame) -> DataFrame:
    """The columns of scan_licenses with the matches as text, label:start:end:edits joined by commas."""
    one = lambda m: F.concat_ws(":", m["label"], m["start"].cast("string"), m["end"].cast("string"), m["edits"].cast("string"))
    return found.withColumn("spans", F.array_join(F.transform("matches", one), ",")).drop("matches")
