import hashlib
import random
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from tracewell.llm import common, encoders, packing, piece_codec, token_output


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def byte_ids(texts):
    tokenizer = Tokenizer.from_file(token_output.default_tokenizer())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_token_files_round_trip(spark, docs, byte_ids, tmp_path, monkeypatch):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(token_output.encode_tokens(docs, token_output.default_tokenizer()), path)
    rows = token_output.token_digest(token_output.read_tokens(spark, path)).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(rows, byte_ids, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    monkeypatch.setattr(token_output, "BLOCK", 2)  # several blocks of parts
    monkeypatch.setattr(token_output, "BROADCAST_ROWS", 0)
    again = token_output.token_digest(token_output.read_tokens(spark, path)).orderBy("doc_id").collect()
    assert again == rows
    # files in name order hold ascending ids
    names = sorted(p.name for p in (tmp_path / "tokens").glob("*.orc"))
    order = [i for n in names for i in orc.ORCFile(str(tmp_path / "tokens" / n)).read(["doc_id"]).column(0).to_pylist()]
    assert order == sorted(order)
    got = token_output.read_tokens(spark, path, [3, 25]).collect()
    assert {r.doc_id: r.ids for r in got} == {3: byte_ids[3], 25: byte_ids[25]}
    plan = token_output.read_tokens(spark, path, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(doc_id,3)]" in plan or "In(doc_id" in plan or "doc_id" in plan.split("PushedFilters")[1][:80]


def test_token_files_of_repeated_and_no_rows(spark, repeated, tmp_path):
    token_output.write_tokens(token_output.encode_tokens(repeated, token_output.default_tokenizer()), str(tmp_path / "a"))
    rows = token_output.token_digest(token_output.read_tokens(spark, str(tmp_path / "a"))).collect()
    assert len(rows) == repeated.count() and len({r.start for r in rows}) == len(rows)
    token_output.write_tokens(token_output.encode_tokens(repeated.limit(0), token_output.default_tokenizer()), str(tmp_path / "b"))
    assert token_output.token_digest(token_output.read_tokens(spark, str(tmp_path / "b"))).collect() == []


def test_unit_cache_limit_changes_nothing(texts, byte_ids, monkeypatch):
    encoder = encoders.library_encoder(token_output.default_tokenizer(), True)
    for limit in (0, 7, 700_000):
        monkeypatch.setattr(encoders, "CACHE_UNITS", limit)
        monkeypatch.setattr(encoders, "SLICE_CHARS", 500)
        encoder._reset()
        flat, lengths = encoder(texts)
        got = np.split(flat, np.cumsum(lengths)[:-1])
        assert [x.tolist() for x in got] == [x[:-1] for x in byte_ids]
        assert len(encoder.codes) <= max(limit, 0)  or limit > len(encoder.codes)
    encoder._reset()


def test_piece_codec_equals_library(docs, texts):
    model = piece_codec.default_model()
    library = piece_codec.codec(model).library
    rows = piece_codec.decode_pieces(piece_codec.encode_pieces(docs, model), model).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        want = library.encode(t or "")
        assert r.ids == want and r.text == library.decode(want)
    digest = piece_codec.codec_digest(piece_codec.decode_pieces(piece_codec.encode_pieces(docs.limit(0), model), model))
    assert digest.collect() == []


def test_round_trip_digest_is_that_of_the_library(docs, texts):
    model = piece_codec.default_model()
    library = piece_codec.codec(model).library
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    ids = [library.encode(t or "") for t in texts]
    want = [(len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for i in ids]
    rows = piece_codec.round_trip_digest(docs, model).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == want
    again = piece_codec.codec_digest(piece_codec.decode_pieces(piece_codec.encode_pieces(docs, model), model))
    assert again.orderBy("doc_id").collect() == rows


def test_decode_of_any_ids():
    codec = piece_codec.codec(piece_codec.default_model())
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, codec.library.get_piece_size(), k) for k in range(40)] + [np.array([200, 201, 300])]
    got = codec.decode(np.concatenate(lists), np.array([len(x) for x in lists]))
    same = [g == codec.library.decode(x.tolist()) for g, x in zip(got, lists, strict=True)]
    assert sum(same) >= len(same) - 6  # ids that no text gives, such as <s> inside, may differ in blanks


def naive_best_fit(lengths, window):
    """Windows' fill by best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(window - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = 64
    lengths = rng.integers(1, [65, 20, 64, 5, 40, 33][seed], 700).tolist()
    values, counts = np.unique(lengths, return_counts=True)
    steps = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), window)
    cells, fill = {}, {}
    for length, lo, hi, first, offset, per in steps.tolist():
        for r in range(lo, hi):
            w, o = first + (r - lo) // per, offset + (r - lo) % per * length
            cells.setdefault(w, []).append((o, length))
    assert sum(map(len, cells.values())) == len(lengths)
    for w, pieces in cells.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= window
        fill[w] = at
    assert sorted(fill) == list(range(len(fill)))
    assert sorted(window - f for f in fill.values()) == naive_best_fit(lengths, window)


def test_packing_covers_every_id_once(repeated, spark):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack(repeated, packing.default_tokenizer(), window=128).toPandas()
    texts = [(r.doc_id, r.text) for r in repeated.collect()]
    assert pieces.doc_tokens[pieces.start == 0].sum() == pieces.length.sum()
    assert (pieces.start == 0).sum() == len(texts)
    for i, t in texts:
        if i is not None and i >= 8:
            want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            own = pieces[pieces.doc_id == i].sort_values("start")
            assert [x for ids in own.ids for x in ids] == want and set(own.doc_tokens) == {len(want)}
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 128
    fills = [128 - f for f in pieces.groupby("sequence_id").length.sum()]
    assert sorted(fills) == naive_best_fit(pieces.length.tolist(), 128)
    digest = packing.piece_digest(packing.pack(repeated.where("doc_id = 25"), packing.default_tokenizer())).collect()
    assert digest[0].ids_crc32 == crc(tokenizer.encode(texts and repeated.where("doc_id = 25").first().text, add_special_tokens=False).ids + [1])
    assert packing.pack(repeated.limit(0), packing.default_tokenizer()).collect() == []
    assert [packing.padded_length(n) for n in (1, 1024, 1025, 2048)] == [1, 1024, 2048, 2048]


def test_shuffled_ranks_equal_broadcast_ranks(docs, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    pieces = packing.pack(docs, packing.default_tokenizer(), window=128).toPandas()
    assert not pieces.duplicated(["sequence_id", "offset"]).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 50), (50, 45), (60, 60), (71, 70), (70, 72)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 31)} | {40: 40, 45: 40, 50: 40, 70: 70, 71: 70, 72: 70}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pieces_are_digested_alike_in_one_worker_and_two(docs):
    apart = packing.piece_digest(packing.pack(docs, packing.default_tokenizer(), window=128))
    once = packing.pack(docs, packing.default_tokenizer(), window=128, digest=True)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, apart.collect())) and once.columns == apart.columns


def test_long_words_equal_library():
    """Rounds with several merges a word, and the heap for long words, give the library's ids, in good time."""
    import random
    import time

    c = piece_codec.codec(piece_codec.default_model())
    rng = random.Random(1)
    texts = ["".join(rng.choices(abc, k=rng.randint(1, n))) for abc, n in (("ab", 400), ("aeiouthns t", 3000), ("etaoin", 1990), ("aab", 2500)) for _ in range(40)]
    flat, lengths = c.encode(texts)
    for got, text in zip(np.split(flat, np.cumsum(lengths)[:-1]), texts, strict=True):
        assert got.tolist() == c.library.encode(text)
    for text in ("a" * 200_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöé日本", k=200_000))):
        began = time.time()
        flat, _ = c.encode([text])
        assert time.time() - began < 20 and flat.tolist() == c.library.encode(text)


def test_units_of_words_are_the_same_wherever_they_stand():
    path = packing.default_tokenizer()
    tokenizer, encoder = Tokenizer.from_file(path), encoders.library_encoder(path, False)
    odd = ["", " ", "\n\n", "a\nb c\n", " a", "it's 's\t't \x1c x\x85y", "e\u0301 \u0301e", "<|endoftext|> a<|endoftext|>b", "ΟΔΟΣ ΣΑΣ", "İ İ", "1 23 4", "\0 a\0b", "ab\r\ncd", "\u1100\u1161 \u1161", "word " * 40, None]
    flat, lengths = encoder(odd)
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]
    encoder(["word\nword word"])
    assert {u for u in encoder.codes if "word" in u} == {"word"}


def test_unknown_words_do_not_go_to_the_library_unit_by_unit():
    path = packing.default_tokenizer()
    tokenizer, asked = Tokenizer.from_file(path), []
    whole = lambda units: asked.extend(units) or [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]
    encode = encoders._by_words(tokenizer, whole)
    units = ["Orndth.", "(orndth)", "ÉcrÖx,", "", "a1-22", "it's", "e\u0301x", "x\u00d7y", "a<|endoftext|>b", "Σς"]
    for some in (units[:5], units, units[::-1]):
        flat, sizes = encode(some)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [tokenizer.encode(u, add_special_tokens=False).ids for u in some]
    assert set(asked) == {"it's", "e\u0301x", "x\u00d7y", "a<|endoftext|>b", "Σς"}


def test_texts_of_any_characters_equal_the_library_beyond_the_cache():
    path = packing.default_tokenizer()
    tokenizer, encoder = Tokenizer.from_file(path), encoders.library_encoder.__wrapped__(path, False)
    rng = random.Random(3)
    signs = [chr(c) for c in range(0x20, 0x250)] + list("'stredvml <|>KÅẞΣςİ日本\u0301\u3000 \t\r\x1c\0") * 8
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(1500)] + ["x" + chr(c) + "y " + chr(c) for c in range(0x2200)]
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for limit in (0, 50, 200_000):
        encoder.limit = limit
        encoder._reset()
        flat, lengths = encoder(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == want


def test_a_worker_gives_memory_back_after_each_task(monkeypatch):
    calls = []
    monkeypatch.setattr(encoders, "trim", lambda: calls.append(1))
    run = encoders.trimmed(lambda batches: (2 * b for b in batches))
    assert list(run(iter([1, 2]))) == [2, 4] and len(calls) == 1
    half = run(iter([1, 2]))
    assert next(half) == 2 and len(calls) == 1
    half.close()
    assert len(calls) == 2
