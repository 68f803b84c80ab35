import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 701}" for i in range(60_000))  # one very long line
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nA second line that is long enough to count here.", "a"),
    (2, "The quick brown fox jumps over the lazy dog.\nA second line that is long enough to count here.", "a"),
    (3, "", "b"), (4, None, "b"), (5, " \n\t ", None), (6, LONG, "b"), (7, LONG + " end", "a"),
    (8, "one", None), (8, "one", None), (9, "ONE", "ß"), (10, "double  space and <|endoftext|> <s> ▁ mark\r\n", "ß"),
    (11, "tab\tand\x0bvertical \u3000 wide é ﬁ 😀 end", "Z"), (None, "no id at all", "a"), (12, "no id at all", None),
    (13, "short\n\n\nshort\nshort\n\n\nshort", "a"), (14, "x " * 5000, "a"), (15, "\n".join(["same line of six words here"] * 9), "b"),
]


@pytest.fixture(scope="session")
def texts(spark):
    """Nulls in each column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t, s, "en", 0, 1, "x", 2.0) for i, t, s in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, lang string, n_chars long, size int, rid string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_texts(texts):
    return texts.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return spark.read.parquet(f"{SF}/documents.parquet")


def vocabulary(name: str) -> str:
    return pytest.importorskip("public_tokenizers").path(name)
