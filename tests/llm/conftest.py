import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def odd_texts():
    """Rows that every operator must survive: nulls anywhere, empty and very long texts, repeated rows."""
    long = "lorem ipsum dolor sit amet " * 4000
    return [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, "", "en", "a", 0),
        (3, None, "en", "a", None),
        (None, "a text without a number of its own", "en", None, 34),
        (4, "   \n\t ", None, "a", 6),
        (5, long, "en", "b", len(long)),
        (6, "!!! ### ???", "fr", "b", 11),
        (7, "日本語のテキスト и русский текст 😀", None, "b", 30),
        (8, "one", "xx", "b", 3),
        (9, "x" * 50_000, "en", "b", 50_000),
        (10, "tab\tand\rreturn  　▁mark  two  spaces ", "en", "b", 40),
    ]


@pytest.fixture
def odd(spark):
    """The odd rows with extra columns whose names the operators use themselves."""
    rows = spark.createDataFrame(odd_texts(), DOCS)
    return rows.selectExpr("*", "1 as keep", "'x' as score", "2 as root", "3 as is_trusted", "4 as ids", "5 as rep", "6 as gone", "7 as n_grams")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
