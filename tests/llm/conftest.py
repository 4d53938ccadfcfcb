import random

import pytest

SMALL = "/root/testdata/sf0.001"

#: Texts at the edges: null, empty, blank, repeated, long, odd characters, and lone cases of each operator.
EDGES = [
    None,
    "",
    " \t\n ",
    "a",
    "a b",
    "a b c",
    "A  B\nC",
    "a b c",
    "word " * 300,
    "x" * 3000,
    "1" * 2000,
    "1.1.1.1 256.1.1.1 0010.2.3.4 +1 (017) 555-7713 4111 1111 1111 1111 a@b.co b@@c.d",
    "İstanbul ΣΑΣ ß ²³ ½ naïve 'll we've 漢字 \U0001f600 ▁ <|endoftext|>",
    " \x85\x1c tabs\tand\x0bothers",
    "line one\nline one\nline two\n\nline one",
    "one two three four five six seven eight nine one two three four five six seven eight nine",
    "<0x0A> </s> \x00 nul",
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge texts, with repeated rows, a null doc_id and columns whose names clash with ours."""
    data = [(k, t, "en", 1, "s") for k, t in enumerate(EDGES)]
    data += [(5, "a b c", "en", 1, "s"), (None, "no id at all", None, None, None)]
    schema = "doc_id long, text string, lang string, node long, score string"
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def rng():
    return random.Random(7)
