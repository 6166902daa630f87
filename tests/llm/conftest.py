import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark, docs_schema):
    """Nulls in every column, empty, wordless, very long and repeated texts."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (None, "a text whose id is null, with words enough to be kept by the rules here", "en", "s", 1),
        (2, "", "en", "", 0), (3, " \n\t ", "en", "s", 4), (4, long_text, "en", "s", len(long_text)),
        (5, "one two three", "en", "s", 13), (6, "one two three", "de", "t", 13), (7, "ONE two\tthree", "de", "t", 13),
        (8, "été 中文 \U0001f44d ok " * 200, "fr", "t", 2600), (8, "été 中文 \U0001f44d ok " * 200, "fr", "t", 2600),
    ]
    return spark.createDataFrame(rows, docs_schema)


@pytest.fixture
def no_docs(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)
