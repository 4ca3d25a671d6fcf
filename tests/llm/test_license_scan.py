import random
import re

import pytest

from tracewell.llm import license_scan as L

SEARCH = L.NoticeSearch(tuple(n for n, _ in L.NOTICES))


def least_edits(notice, text):
    """Edits of the best place of notice in text, by the whole table of distances."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[0], 0
        for i, x in enumerate(notice, 1):
            before, row[i] = row[i], min(before + (c != x), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def worn(rng, text, edits):
    for _ in range(edits):
        i, c = rng.randrange(len(text)), rng.choice("abc xyz0é")
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + c + text[i + 1 :], text[:i] + c + text[i:]])
    return text


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(4)
    filler = lambda n: " ".join("".join(rng.choices("adeilnrst é", k=rng.randint(2, 9))) for _ in range(n))
    texts = [filler(rng.randint(0, 12)) + " " + worn(rng, rng.choice(L.NOTICES)[0], rng.randint(0, 9)) + " " + filler(rng.randint(0, 12)) for _ in range(150)]
    texts += [" ".join(worn(rng, rng.choice(L.NOTICES)[0], rng.randint(0, 4)) for _ in range(6)) for _ in range(20)]
    texts += ["licensed under the " * 200, "license " * 500, " ".join(["mit license"] * 50), "Mit-LICENSE; mit\nlicense: (general) public_LICENSE mitlicense mit licenses"]
    return texts


def test_no_place_is_missed(samples):
    for text in samples:
        words = " ".join(words_of(text))
        assert L.plain_words(text.encode()).decode() == words
        found = {}
        for i, start, end, edits in SEARCH.matches(words):
            assert least_edits(SEARCH.notices[i], words[start:end]) <= edits <= SEARCH.edits[i]
            found[i] = min(edits, found.get(i, 99))
        for i, notice in enumerate(SEARCH.notices):
            least = least_edits(notice, words)
            assert found.get(i) == (least if least <= SEARCH.edits[i] else None), (notice, text)


def test_windows_are_short_and_overlaps_resolved(samples):
    for text in samples:
        words = L.plain_words(text.encode()).decode()
        assert all(e - s <= len(SEARCH.notices[i]) + 3 * SEARCH.edits[i] for i, s, e in SEARCH.candidates(words))
        kept, every = SEARCH.resolved(words), SEARCH.matches(words)
        assert all(x[2] <= y[1] for x, y in zip(kept, kept[1:], strict=False))
        share = lambda x: x[3] / len(SEARCH.notices[x[0]])
        for x in every:
            assert x in kept or any(y[1] < x[2] and x[1] < y[2] and share(y) <= share(x) for y in kept)


def brute(text):
    words = words_of(text)
    base = [(i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base}))


def test_scan_equals_brute_force(spark, samples, docs, repeated):
    own = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(samples)], "doc_id long, text string, labels string, matches array<int>")
    for frame in (docs, repeated, own):
        text = {(r.doc_id, r.text) for r in frame.collect()}
        rows = L.scan_licenses(frame).collect()
        assert len(rows) == frame.count()
        got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows}
        assert got == {(i, *brute(t)) for i, t in text}
        texts = dict(text)
        for r in rows:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
            for m in r.matches:
                words = words_of(texts[r.doc_id])[m.first_word : m.end_word]
                assert words_of(texts[r.doc_id][m.start : m.end]) == words
                assert least_edits(L.NOTICES[m.notice][0], " ".join(words)) <= len(L.NOTICES[m.notice][0]) // L.EDIT_SHARE
    assert L.scan_licenses(docs.limit(0)).collect() == []
    assert {r.score for r in L.scan_licenses(docs).collect()} == {0.0}


def test_labels(spark):
    texts = [
        "Code: licensd under CC BY-NC 4.0!", "Licensed under CC BY-SA 4.0", "Relased undr the MIT-licence.", "redistribution and use in sourc and binary form", None,
        "é " * 5 + "released under the MIT License.", "nothing of the kind is licensed here",
    ]
    rows = L.license_digest(L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].labels for i in range(7)] == ["cc-by-nc", "cc-by-sa", "mit", "bsd", "", "mit", ""]
    assert by_id[2].base_labels == "" and 0.8 < by_id[2].score < 1 and by_id[5].score == 1.0
    assert by_id[5].spans == "mit:10:40:0" and by_id[0].spans == "cc-by-nc:6:32:1" and by_id[4].spans == ""
