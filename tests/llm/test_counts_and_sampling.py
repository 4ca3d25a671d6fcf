import math
import random

import numpy as np
import pytest

from tracewell.llm import importance, piece_codec, token_counts


def greedy(word, begins, goes_on):
    at, n, known = 0, 0, begins
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in known:
                at, n, known = end, n + 1, goes_on
                break
        else:
            return 1
    return n


def test_automaton_equals_greedy_search():
    rng = random.Random(2)
    for _ in range(40):
        pieces = {("▁" if rng.random() < 0.5 else "") + "".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 25))}
        machine = token_counts.LongestMatch(pieces)
        begins, goes_on = {p[1:] for p in pieces if p[0] == "▁"}, {p for p in pieces if p[0] != "▁"}
        for _ in range(100):
            word = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
            assert machine.count(word) == greedy(word, begins, goes_on), (pieces, word)


def test_token_counts(repeated):
    model = piece_codec.default_model()
    got = token_counts.token_counts(repeated, model).collect()
    assert len(got) == repeated.count() and token_counts.token_counts(repeated.limit(0), model).collect() == []
    machine = token_counts.automaton(model)
    texts = {r.doc_id: r.text for r in repeated.collect()}
    for r in got:
        assert r.n_tokens == sum(map(machine.count, (texts[r.doc_id] or "").split()))


@pytest.mark.parametrize("k", [0, 1, 17, 300, 600, 900])
def test_top_k(spark, k):
    rng = random.Random(k)
    rows = [(i, float(rng.choice([1.0, 2.0, rng.random()]))) for i in range(600)]
    got = {r.doc_id for r in importance.top_k(spark.createDataFrame(rows, "doc_id long, key double"), k).where("kept").collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_importance_prefers_the_target(spark, repeated):
    rng = random.Random(9)
    good, bad = ["the", "of", "and", "thing"], ["$$$", "%%%", "zzz", "!!"]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=40)), "k") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200)], "doc_id long, quality int")
    got = importance.importance_resample(docs, labels, share=0.5).collect()
    kept = [r for r in got if r.kept]
    assert len(got) == 400 and len(kept) == 200 and sum(r.doc_id % 2 for r in kept) >= 190
    again = {r.doc_id for r in importance.importance_resample(docs.repartition(7), labels, share=0.5).collect() if r.kept}
    assert again == {r.doc_id for r in kept}
    assert importance.importance_resample(docs.limit(0), labels).collect() == []
    odd = importance.importance_resample(repeated, labels).collect()
    assert len(odd) == repeated.count() and all(math.isfinite(r.key) for r in odd)


def test_weights_equal_brute_force(spark, monkeypatch):
    """Log ratios of both models' shares of each number, summed over a text's words and pairs of words; also by a shuffled join."""
    monkeypatch.setattr(importance, "BROADCAST_IDS", 0)
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(["The", "of", "zzz", "q%", "thing"], k=rng.randint(0, 30))) for i in range(80)}
    good = {i for i in texts if i % 3 == 0}
    numbers = {}

    def number(gram):
        if gram not in numbers:
            data = np.frombuffer(" ".join(gram).encode(), np.uint8)
            numbers[gram] = int(importance._features(data, np.array([0, len(data)]))[0][-1])
        return numbers[gram]

    def grams(text):
        w = text.lower().split()
        return [number((x,)) for x in w] + [number(p) for p in zip(w, w[1:], strict=False)]

    raw, target = [1] * importance.BUCKETS, [1] * importance.BUCKETS
    for i, t in texts.items():
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    ratio = [math.log(b / sum(target)) - math.log(a / sum(raw)) for a, b in zip(raw, target, strict=True)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")
    got = {r.doc_id: r.weight for r in importance.importance_resample(docs, labels).collect()}
    assert all(abs(got[i] - sum(ratio[g] for g in grams(t))) < 1e-6 for i, t in texts.items())
    mean = {r.doc_id: r.weight for r in importance.importance_resample(docs, labels, mean=True).collect()}
    assert all(abs(mean[i] * max(len(grams(t)), 1) - got[i]) < 1e-6 for i, t in texts.items())
