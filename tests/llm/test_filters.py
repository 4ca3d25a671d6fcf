import random
import hashlib
import re
from collections import Counter

import duckdb
import pandas as pd

from tracewell.llm import exact_dedup, quality_rules, url_filter


def by_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.sql(sql).df()


def same_rows(got, want):
    columns = sorted(want.columns)
    key = lambda f: sorted(tuple(map(str, r)) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False))
    assert sorted(got.columns) == columns
    assert key(got) == key(want)


def test_exact_dedup_equals_grouping(docs, repeated):
    for frame in (docs, repeated):
        rows = [(r.doc_id, r.text or "") for r in frame.collect()]
        last, size = {}, Counter(t for _, t in rows)
        for i, t in rows:
            last[t] = i if last.get(t) is None else last[t] if i is None else max(i, last[t])
        want = sorted((str(i), str(last[t]), size[t], i == last[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        for digest_bytes in (32, 1):  # one byte: digests collide, and only the check of contents tells chunks apart
            got = exact_dedup.exact_dedup(frame, digest_bytes=digest_bytes).collect()
            assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_dedup(docs.limit(0)).collect() == []


def test_texts_of_null_ids_are_verified_too(spark):
    texts = [f"text number {i} " + "word " * (i % 40) for i in range(300)]
    rows = [*enumerate(texts), (None, texts[5]), (900, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for digest_bytes in (32, 1):
        got = exact_dedup.exact_dedup(docs, digest_bytes=digest_bytes).collect()
        assert sorted((str(r.doc_id), r.keep_id, r.kept) for r in got if r.group_size == 3) == [("5", 900, False), ("900", 900, True), ("None", 900, False)]
        assert sum(r.group_size == 1 for r in got) == 299


def test_chunks_put_together_are_the_text(spark, docs):
    from pyspark.sql import functions as F

    rows = docs.where("text is not null").select("text", exact_dedup.chunks(F.col("text")).alias("c")).collect()
    for r in rows:
        assert "".join(r.c) == r.text and all(len(x) <= exact_dedup.MAX_CHUNK for x in r.c)
    long = next(r for r in rows if len(r.text) > 30000)
    moved = spark.createDataFrame([("Yyy " + long.text,)], "text string").select(exact_dedup.chunks(F.col("text")).alias("c")).first().c
    assert len(set(moved) & set(long.c)) > len(long.c) // 2  # cuts follow the content


def naive_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {t for t, n in Counter(triples).items() if n > 1}
    covered = {i + k for i, t in enumerate(triples) if t in twice for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_fences(docs, repeated):
    for frame in (docs, repeated):
        got = quality_rules.quality_rules(frame).toPandas()
        texts = sorted((naive_counts(r.text) for r in frame.collect()))
        assert sorted(map(tuple, got[quality_rules.COUNTS].itertuples(index=False))) == texts
        base = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
        assert (got.base_failed == base).all() and not (got.kept & base).any()
    want = by_duckdb(quality_rules.SQL, documents=docs.select("doc_id", "text", "lang", "source").toPandas())
    same_rows(quality_rules.quality_rules(docs).drop("reason").toPandas(), want)
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []


def test_quality_adapts_to_its_group(spark):
    plain = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "prose") for i in range(200)]
    table = [(1000 + i, " | ".join(f"w{i}x{k}" for k in range(60)), "en", "tables") for i in range(200)]
    stray = [(2000, " | ".join(f"v{k}" for k in range(60)), "en", "prose")]
    docs = spark.createDataFrame(plain + table + stray, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert not kept.pop(2000) and all(kept.values())


def test_each_signal_finds_the_odd_document_of_its_group(spark):
    rng = random.Random(5)
    word = lambda n=5: "".join(rng.choices("abcdefghij", k=n))
    lines = lambda k, n=5: [" ".join(word(n) for _ in range(6)) for _ in range(k)]
    rows = [(i, "\n".join(lines(12))) for i in range(150)]
    rows[0] = (0, "\n".join([*lines(12)[:11], "#" * 9 + " a b c d e"]))
    twice = lines(6)
    rows[1] = (1, "\n".join([w for line in twice for w in (line.split()[0] + word() + " " + word() + " " + word(), "x y")] + lines(9)))
    rows[2] = (2, "\n".join(lines(12, 14)))
    same = " ".join(word() for _ in range(9))
    rows[3] = (3, "\n".join([*lines(11), same + " " + word() + " " + same]))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    reasons = {r.doc_id: r.reason for r in quality_rules.quality_rules(docs).collect() if r.reason}
    assert reasons == {0: "symbols", 1: "dup_lines", 2: "long_words", 3: "repeats"}


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7?x#y", "http://a.b.example.com/en/8#t", "http://xexample.net/de/8", "http://example.net/de/8.html",
        "http://www.q.io/p.html?utm_source=a", "http://q.io/p/", "HTTP://Q.IO/p#z", "http://q.io/other", "ftp://m.org/es/?utm_source=1", "a://b://c/d", "http://x.io?utm_source=2", "http://x.io", "http://h.net:80/de/1\n2",
    ]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(9, urls[9], "h"), (None, "http://q.io/p", "h")]
    pages = spark.createDataFrame([(*r, "c", True) for r in rows], "page_id long, url string, html string, canonical string, listed boolean")
    got = url_filter.url_filter(pages, url_filter.tracked_urls(pages)).toPandas()
    by_id = {int(r.page_id): r for r in got[got.page_id.notna()].itertuples()}
    assert (by_id[4].host, by_id[4].path, by_id[4].rule, by_id[4].verdict) == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert by_id[5].rule == "com/en/" and by_id[6].rule == "net/de/" and by_id[7].verdict == "block"
    assert [by_id[i].verdict for i in (8, 9, 10, 11, 14, 15)] == ["block", "block", "block", "allow", "block", "block"]
    assert (by_id[0].host, by_id[2].path) == ("", "")
    assert len(got) == len(rows)
    plain = pages.where("page_id is not null").select("page_id", "url", "html").dropDuplicates()
    want = by_duckdb(url_filter.SQL, pages=plain.toPandas())
    same_rows(url_filter.url_filter(plain, url_filter.tracked_urls(plain)).drop("canonical", "listed").toPandas(), want)
    assert url_filter.url_filter(pages.limit(0), url_filter.tracked_urls(pages.limit(0))).collect() == []


def test_bloom_filter_loses_nothing_and_passes_little(spark):
    listed = spark.range(3000).selectExpr("concat('q.io/', id) AS canonical")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://q.io/', id) AS url")
    got = url_filter.url_filter(pages, listed).toPandas()
    assert got[got.listed].page_id.sort_values().tolist() == list(range(3000))
    assert isinstance(got, pd.DataFrame)
