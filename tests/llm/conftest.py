import pytest

EDGE_TEXTS = [None, "", " ", "one", "Same text of the pair, twice in full length for the shingles to meet here.",
              "Same text of the pair, twice in full length for the shingles to meet here.", "ünïcode straße ÀÉ 中文 text", "x" * 60 + " " + "y " * 500]


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def edges(spark):
    """Nulls in every column, empty and long texts, repeated rows and an extra column with a clashing name."""
    rows = [(i, t, "en", "a", len(t or ""), "k") for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "a text without an id", None, None, None, None), (3, "one", "en", "a", 3, "k"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")


@pytest.fixture
def nothing(spark):
    return frame(spark, [])
