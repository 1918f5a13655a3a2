import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """documents from (doc_id, text) pairs, with a clashing extra column."""

    def make(rows):
        data = [(i, t, "en", "s", len(t) if t is not None else None, 1, "x") for i, t in rows]
        return spark.createDataFrame(data, ROWS + ", part int, at string")

    return make
