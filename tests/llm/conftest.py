import random

import pytest

SCHEMA = "doc_id long, text string, n_tokens string, key string, labels string, size int, ids string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names clash with results."""
    r = random.Random(11)
    words = ["the", "Of", "and", "été", "naïve", "x1", "GNU", "MIT", "license", "日本", "a.b", "don't"]
    para = [" ".join(r.choice(words) for _ in range(n)) for n in (3, 40, 90, 150, 400)]
    texts = [None, "", " ", "\n\t", "a", "A b c", "a b  C", *para, para[2], para[3] + " tail", "pre " + para[3], para[2].upper(), "x" * 5000, " ".join(para) * 20, "<|endoftext|> mid <|endoftext|>", "\x00\x1f\x7f", para[4], para[4]]
    rows = [(k, t, "7", None, "z", k, None, "0") for k, t in enumerate(texts)]
    rows += [(3, "\n\t", None, "k", None, None, None, None), (None, para[1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[9], rows[9]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
