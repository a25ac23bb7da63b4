import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def documents(spark, smallest):
    return spark.read.parquet(f"{smallest}/documents.parquet").persist()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns named like the operators' own."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "word " * 30_000, "de", "a", None), (5, "same text here for a test", "en", "a", 1), (5, "same text here for a test", "en", "a", 1),
        (6, "same text here for a test", "en", "a", 1), (None, "same text here for a test", "en", "a", 1), (None, None, "en", "a", 1), (7, "x" * 50_000, "fr", "b", 2), (8, "é\x00﷐😀 ‍ ﷐ '#$ 1.2.3.4", "fr", "b", 3),
    ]
    more = [(*r, "clash", 1.5, 7) for r in rows]
    return spark.createDataFrame(more, SCHEMA + ", spans string, score double, length long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
