import pytest

LONG = " ".join(f"word{i % 977} other{i % 13}" for i in range(30_000))
TEXTS = [
    None, "", "   ", "one", "one two", "a\n\n b\t c  d ", "tie tie tie", LONG, LONG + " tail", "É Ü ß x <|endoftext|> y's don't 'Tis\r\n",
    "x" * 70_000, "The same shared boilerplate line here.\nown line number one of it", "no\nThe same shared boilerplate line here.",
    " ".join(["again and again the very same eight words return"] * 9), "Zero \U0001d518 | # % $ & < > *",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with those in use."""
    rows = [(i, t, ["en", None][i % 2], ["s0", "s1", None][i % 3], len(t) if t is not None else None, i, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], rows[7], (None, "null id text", None, None, None, 1, "y"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, TEXT2 string").withColumnRenamed("TEXT2", "_row")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
