import pytest

AWKWARD = [
    (1, "The cat sat on the mat. The cat sat on the mat.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "   \n\t ", "fr", "b"),
    (5, "word " * 30_000, "en", "b"),
    (6, "x" * 50_000, "de", None),
    (7, "don't ''s <|endoftext|> ½² 漢字かな　a\x1cb  İΣ", "es", "c"),
    (7, "don't ''s <|endoftext|> ½² 漢字かな　a\x1cb  İΣ", "es", "c"),
    (None, "no id here, but some words", "en", "a"),
    (8, "12345 !!! $$$", "en", "c"),
    (9, "line one\nline one\n\nline two\r\nline one", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ("ids", "decoded", "n_tokens", "fp", "_fp", "size", "_size", "score", "lang_pred", "rate", "hash", "block", "component_id", "_stat_n_words", "_lang_score", "_lang_pred")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the operators' own names."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    for c in CLASHING:
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
