import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, count long, kept boolean"


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty and very long texts, ties, repeated rows, a null and repeated identifiers."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "  ", "one", "two words", base, base, " ".join(near), base.upper(), text(30_000), "é 日本 \n x", "!!! ... 123", None, "tie", "tie", "tie", *[text(60) for _ in range(30)]]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}", len(t or ""), "clash", 1, True) for k, t in enumerate(texts)]
    return [*rows, rows[5], (5, "another text under a known id", "en", "s", 29, None, None, None), (None, "tie", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
