import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and repeated rows, one long text, an extra column with a clashing name."""
    rows = [
        (1, "a b c d e f g", "en", "s1", 13, 0),
        (2, "a b c d e f g", "en", "s1", 13, 0),
        (2, "a b c d e f g", "en", "s1", 13, 0),
        (3, None, None, None, None, None),
        (4, "", "en", "s2", 0, 1),
        (5, "word " * 30000, "en", "s2", 150000, 1),
        (6, "  \t\n ", "en", "s3", 5, 1),
        (7, "ünïcödé ẞtraße <|endoftext|> 漢字 don't", "de", "s3", 30, 1),
        (None, "no id here", "en", "s1", 10, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int")
