import hashlib
import random
import re

from tracewell.llm import pii

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def naive(text):
    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(RULES) for m in re.finditer(p, text or "") if passes(kind, m[0])]


def odd_texts():
    rng = random.Random(4)
    bits = ["a@b.c", "a@b", "_d@e.f", "1.2.3.4", "001.02.3.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "4465758382889437", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49", "é", "😀", " ", " ", "\n", "x", "@", ".", "-", "+", "7", "12"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)] + ["9" * 20000, "a" * 20000 + "@", "1 " * 9000, "+" + "1-" * 9000]


def test_base_spans_equal_the_rules(spark, repeated):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    texts = dict(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.find_pii(docs).select("doc_id", "base").collect()}
    assert got == {i: naive(t) for i, t in texts.items()}
    digest = {r.doc_id: r for r in pii.pii_digest(pii.find_pii(docs)).collect()}
    for i, t in rows[:50]:
        spelt = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in naive(t))
        assert digest[i].base_sha256 == hashlib.sha256(spelt.encode()).hexdigest()
        assert digest[i].n_email == sum(k == 0 for k, _, _ in naive(t))
    assert pii.find_pii(repeated).count() == repeated.count()
    assert pii.find_pii(docs.limit(0)).collect() == []


def test_patterns_find_what_the_rules_miss(spark):
    rng = random.Random(1)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"please call me at {phone()} today") for i in range(40)]
    rows += [(100, "please call me at (743) 555-3824 today"), (101, "the serial number 743 555 3824 is old"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_digest(pii.find_pii(docs)).collect()}
    assert spans[100] == "phone:18:32" and spans[101] == "" and spans[102] == ""


def test_masking(spark):
    rows = [(1, "to a@b.c from 1.2.3.4!", "k"), (2, "clean", "k"), (3, None, "k"), (1, "to a@b.c from 1.2.3.4!", "k"), (None, "x@y.z", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.mask_pii(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.select("text").collect())) == sorted(map(str, spark.createDataFrame([("to [EMAIL] from [IP]!",), ("clean",), (None,), ("to [EMAIL] from [IP]!",), ("[EMAIL]",)], "text string").collect()))


def shape(value):
    out = re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]+", "9", value)))
    return re.sub("[9aA]{3,}", "x", out)


def brute_force(docs):
    """Spans beyond the base ones, by dictionaries instead of joins; docs: texts by id."""
    found, graph, seeds = [], {}, {}
    for i, text in docs.items():
        base, at = naive(text), 0
        matches = list(re.finditer(pii.CANDIDATE, text))
        for m, after in zip(matches, [*matches[1:], None], strict=False):
            left, at = text[at : m.start()].lower(), m.end()
            right = text[m.end() : after.start() if after else len(text)].lower()
            value = m[0]
            if not ("@" in value or len(re.sub("[^0-9]", "", value)) >= 6 or len(value) >= 16):
                continue
            kind = next((k for k, s, e in base if s < m.end() and m.start() < e), None)
            if kind is None and re.search(pii.SECRET, value):
                kind = 4
            words = left.split()[-2:]
            before, last = " ".join(words), words[-1] if words else ""
            nxt = right.split()[0] if right.split() else ""
            found.append((i, m.start(), m.end(), value, kind))
            for p in ("2 " + before, "1 " + last, f"r {last} _ {nxt}", f"s {last} {shape(value)}"):
                graph.setdefault(p, set()).add(value)
            if kind is not None:
                seeds[value] = max(seeds.get(value, -1), kind)

    def low(p, n, z=pii.Z):
        return (p + z * z / (2 * n) - z * ((p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5)) / (1 + z * z / n)

    known = {v: (k, 1.0) for v, k in seeds.items()}
    while True:
        best = {}
        for p, values in graph.items():
            for kind in {known[v][0] for v in values if v in known}:
                score = low(min(sum(known[v][1] for v in values if v in known and known[v][0] == kind) / len(values), 1.0), len(values))
                if score >= pii.CONFIDENCE:
                    for v in values - set(seeds):
                        best[v] = max(best.get(v, (0, 0)), (score, -kind))
        grown = {v: (k, 1.0) for v, k in seeds.items()} | {v: (-k, s) for v, (s, k) in best.items()}
        if len(grown) == len(known):
            known = grown
            break
        known = grown
    return {i: sorted({(known[v][0], s, e) for d, s, e, v, k in found if d == i and v in known and (k is None or k == 4)}) for i in docs}


def test_pattern_graph_equals_brute_force(spark):
    rng = random.Random(12)
    phone = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    texts = [f"please {rng.choice(['call', 'ring'])} me at {rng.choice(['+1 '] * 8 + [''])}{phone()} today" for _ in range(60)]
    texts += [f"the {rng.choice(['serial', 'part'])} number {phone()} is old" for _ in range(30)]
    texts += [f'token = "{key()}" ok' for _ in range(30)] + [f'TOKEN = "{key().upper()}" ok' for _ in range(3)]
    texts += [f"from {rng.choice(['a', 'b'])}{i}@x{i}.org and b{i}@localhost now" for i in range(25)] + ["", "call", "reach 5551234567 ring me at 5559876543 today"]
    docs = dict(enumerate(texts))
    got = pii.find_pii(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4), secrets=True).collect()
    want = brute_force(docs)
    base = {i: set(naive(t)) for i, t in docs.items()}
    more = {r.doc_id: sorted({tuple(x) for x in r.spans} - base[r.doc_id]) for r in got}
    assert more == {i: sorted(set(v) - base[i]) for i, v in want.items()}
    kinds = [k for v in more.values() for k, _, _ in v]
    assert kinds.count(3) >= 3 and kinds.count(4) == 33  # phones without a prefix, keys in capitals
    assert all(not more[i] for i in range(60, 90))  # serial numbers of the same shape stay


def test_unseen_forms_are_found_by_their_contexts(spark):
    """Phones without a prefix and addresses without a dot, which no base rule takes, among numbers and handles of the same shapes elsewhere."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    filler = lambda: " ".join(word() for _ in range(rng.randint(3, 30)))
    local = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    contexts = {"phone": ["please call me at", "you reach us under", "fax or phone:"], "email": ["write a mail to", "contact our desk via"]}
    others = ["serial number", "invoice", "the part with code", "follow the handle"]
    texts, planted = [], set()
    for i in range(1500):
        kind = rng.choice(["phone", "email", None])
        lead = filler() + " " + (rng.choice(contexts[kind]) if kind else rng.choice(others)) + " "
        usual = rng.random() < 0.9
        if kind == "phone":
            value = ("+1 " if usual else "") + local()
        elif kind == "email":
            value = f"{word()}{rng.randint(10, 99)}@{word()}" + (".org" if usual else "")
        else:
            value = local() if rng.random() < 0.5 else f"{word()}@{word()}"
        if kind and not usual:
            planted.add((i, ["email", "ip", "card", "phone"].index(kind), len(lead), len(lead) + len(value)))
        texts.append(lead + value + " " + filler())
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    base = {(i, *x) for i, t in enumerate(texts) for x in naive(t)}
    more = {(r.doc_id, *x) for r in got for x in r.spans} - base
    assert len(planted) > 60
    assert len(more & planted) >= 0.9 * len(planted) and len(more & planted) >= 0.9 * len(more)


def test_keys_are_seeds_only_if_asked_for(spark):
    docs = spark.createDataFrame([(1, "key 0123456789abcdef0123456789abcdef here")], "doc_id long, text string")
    assert pii.pii_digest(pii.find_pii(docs)).first().spans == ""
    assert pii.pii_digest(pii.find_pii(docs, secrets=True)).first().spans == "secret:4:36"
    assert pii.mask_pii(docs).first().text == "key [SECRET] here"


def test_many_matches_in_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)  # and the shuffled joins
    text = " ".join(f"mail{i}@host{i % 9}.org" for i in range(9000)) + " " + "x" * 30_000 + " é 1.2.3.4"
    docs = spark.createDataFrame([(1, text, "t"), (2, "none", "t"), (None, None, "t"), (None, text[:40], "t")], "doc_id long, text string, text__ string")
    spans = {r.doc_id: [tuple(x) for x in r.base] for r in pii.find_pii(docs).collect() if r.doc_id}
    assert spans == {1: naive(text), 2: []}
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns
    got = {r.doc_id: r.text for r in masked.where("doc_id is not null").collect()}
    assert got[1] == " ".join(["[EMAIL]"] * 9000) + " " + "x" * 30_000 + " é [IP]" and got[2] == "none"
