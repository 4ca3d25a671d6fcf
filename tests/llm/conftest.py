import random

import pytest

ODD = [
    None, "", "a", " ", "\n", " \n a\n\n b ", "x  y", "\t\ta  b\t c", "<|endoftext|> a<|endoftext|>", "é é ́x",
    "日本語 \U0001d11e\U0001f600", "\0a\0 b", "▁▁a ▁b", "it's we'LL I'd", "a\r\nb", "x\u00a0 y", "ΑΣ ΣΑΣ", "12345 67", "a" * 3000,
]


def make_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "edan", "onha", "Thre.", "ing,", "nder", "###", "x1", "größe", "é", "42", "la"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(n)]
    texts += [t + "." for t in texts[:5]] + texts[:6]
    texts.append(" ".join(rng.choices(words, k=9000)))
    return ODD + texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Odd, long, repeated and ordinary texts, with further columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}" if i % 5 else None, len(t or ""), "x", i, [1]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, part string, recipe long, ids array<int>"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def repeated(docs):
    """The documents with each row of an id under 8 twice and a null id."""
    return docs.unionByName(docs.where("doc_id < 8")).unionByName(docs.where("doc_id = 30").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
