import random

import corpus_pipeline


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """(doc_id, text) after quality, exact and near; no signal of these texts passes its fence, so only the base rule rejects."""
    rows = [(d, t) for d, t in rows if t and len(t.split()) >= 50]
    of_text = {}
    for d, t in rows:
        of_text.setdefault(t, []).append(d)
    rows = [(max((d for d in ids if d is not None), default=None), t) for t, ids in of_text.items()]
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 75 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    # least id of each class, null last
    return {min(((d is None, d or 0), (d, t)) for k, (d, t) in enumerate(rows) if group[k] == g)[1] for g in set(group)}


def cases():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    texts = [" ".join(word() for _ in range(90)) for _ in range(14)]
    near = lambda k: texts[k] + " " + word()
    rows = list(enumerate(texts[:6], 10))
    rows += [(None, texts[6]), (None, texts[7]), (None, texts[7]), (None, texts[0])]  # alone, twice, beside an id
    rows += [(20, texts[8]), (20, "too short"), (20, texts[9]), (21, texts[9])]  # a rejected namesake, a kept copy
    rows += [(22, texts[10]), (22, texts[10])]  # the same row twice
    rows += [(None, near(1)), (None, texts[12]), (30, near(12))]  # a null near an id
    # near copies of one id, or of none: either may stay, but one only
    return rows, [(24, near(11))], [[(23, texts[11]), (23, near(11))], [(None, texts[13]), (None, texts[13] + " end")]]


def after(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.repartition(3)
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = out
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_null_and_repeated_ids_equal_brute_force(spark):
    rows, later, ties = cases()
    got = after(spark, rows + later + sum(ties, []))
    for tie in ties:
        assert sum(r in tie for r in got) == 1
    want = brute(rows)
    assert sorted((r for r in got if r not in sum(ties, [])), key=str) == sorted(want, key=str)
    assert {t for d, t in want if d is None} and len({d for d, _ in want}) < len(want)


def test_all_stages_with_clashing_columns_and_without_rows(spark):
    """Every stage takes the columns of the one before, also under names that it uses itself; texts are masked and packed whole."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    text = lambda: " ".join(word() for _ in range(80))
    base = [text() for _ in range(8)]
    rows = [(i, t + " mail x.y@host.org now") for i, t in enumerate(base)] + [(50, base[0] + " mail x.y@host.org now"), (51, base[1] + " end"), (52, "short"), (53, None), (None, text())]
    named = "doc_id long, text string, lang string, source string, n_chars long, row__ string, group__ int, text__ string, key__ int, more string, kept string"
    frame = [(d, t, "en", "s", len(t or ""), "r", 1, "t", 2, "m", "k") for d, t in rows]
    for given in (frame, []):
        docs = spark.createDataFrame(given, named).repartition(3)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            if name == "pack":
                before = {r.doc_id: r.text for r in docs.collect()}
            out = stage(spark, docs, "")
            assert name == "pack" or out.columns == columns, name
            docs = corpus_pipeline.materialise(out, "test-stage")
        pieces = docs.collect()
        if not given:
            assert pieces == []
            continue
        assert set(before) == {50, *range(1, 8), None} and all("@" not in t and (d is None or "[EMAIL]" in t) for d, t in before.items())
        assert all(r.n_chars == len(r.text) for r in corpus_pipeline.personal_data(spark, spark.createDataFrame(frame[:1], named), "").collect())
        of = {}
        for p in pieces:
            of.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
        for own in of.values():
            own.sort()
            assert [s for s, *_ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]
        assert set(of) == set(before)
