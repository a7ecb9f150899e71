"""Small document tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join(rng.choice(["ab", "Cd", "efg", "über", "日本", "x1"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with passages of over 50 words in common, exact and near copies, one very long word and a very long text."""
    rng = random.Random(7)
    passage = words(rng, 60)
    base = [words(rng, rng.randrange(0, 160)) for _ in range(40)]
    texts = base + [f"{a} {passage} {b}" for a, b in zip(base[:12], base[12:24], strict=True)] + [base[5], base[5], base[30] + " tail", "und " * 90, None, "", " \n\t ", "a", "x" * 3000, words(rng, 6000)]
    out = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id here " * 8, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns with the names that the operators use inside."""
    return spark.createDataFrame([(1, "one two three", 5, "k", "p", 1, 2.0, "h"), (2, None, None, None, None, None, None, None)], "doc_id bigint, text string, did int, key string, places string, fp int, size double, source string")
