import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from tuples (doc_id, text, lang, source), with further columns whose names operators use."""

    def make(rows, clash=True):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        if clash:
            df = df.selectExpr("*", "'x' AS score", "1 AS n", "'y' AS key", "2 AS copy", "3 AS shard", "'z' AS fp", "'w' AS fingerprint", "4 AS size", "'v' AS lang_pred", "5 AS rate", "6 AS parts", "'u' AS segments", "7 AS pos")
        return df

    return make


@pytest.fixture(scope="session")
def sf():
    return SF


#: Rows with nulls everywhere, empty and blank texts, a very long one, ties and repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again", None, "b"),
    (None, "the quick brown fox jumps over the lazy dog again and again", "en", None),
    (3, None, "en", "a"),
    (4, "", "en", "a"),
    (5, " \t\n ", None, None),
    (6, "word " * 60_000, "en", "b"),
    (7, "x" * 50_000, "en", "b"),
    (8, "1234 5678 ###", "de", "b"),
    (None, None, None, None),
]
