import pytest

SF = "/root/testdata/sf0.001"

#: doc_id, text, lang, source, n_chars, and a column whose name clashes with results
AWKWARD = [
    (1, None, "en", "a", 0, "x"),
    (2, "", None, None, 0, "x"),
    (3, " \t\n\x0b\x0c\r ", "en", "b", 7, None),
    (4, "the same words of the same text and the same lines in it for a test", "en", "a", 1, "x"),
    (4, "the same words of the same text and the same lines in it for a test", "en", "a", 1, "x"),
    (5, "THE same words OF the same text and the same lines in it for a test", "en", None, 1, "y"),
    (None, "a row without an id, but with some words of its own in it", "de", "b", 1, "x"),
    (7, "one two three", "fr", "c", 1, "x"),
    (8, "spam " * 400, "en", "a", 1, "x"),
    (9, "line of words\nline of words\n\nline of words\r\nother", "en", "a", 1, "x"),
    (10, "été 12345 <|endoftext|> ### 日本語のテキスト ½ 🙂 á", "fr", "é", 1, "x"),
    (11, "no" + "letters" * 3000 + " end", "en", "a", 1, "x"),
    (12, "1 2 3 4 5 ** $$ --", None, "b", 1, "x"),
    (13, " ".join(f"w{i * i % 997}" for i in range(6000)), "es", "a", 1, "x"),
    (0, "line of words\nother words\nline of words", "en", "c", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none_at_all(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
