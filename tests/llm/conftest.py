import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(7)
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and very long texts, ties, odd white space, letters beyond ASCII."""
    return [None, "", " ", "\n\n", "A", "a", "É", "é", "x" * 30_000, "word " * 5_000, "\t a\x0bb  c ", "日本語 のテキスト", "İstanbul ſtraße", "\0nul", "<|endoftext|> end", "a b", "😀 emoji"]


def table(spark, texts, start=0, **columns):
    rows = [(start + i, t, columns.get("lang", "en"), f"s{i % 3}", None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
