import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that clash with names which the operators use inside.
CLASH = ", fp string, n int, links string, words string, score string, length string, key string, grp int, y int, s string, p string, prior string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs, with extra columns of clashing names."""

    def make(*pairs):
        rows = [(i, t, "en", "src", len(t) if t is not None else None, *[None] * 12) for i, t in pairs]
        return spark.createDataFrame(rows, DOC + CLASH)

    return make


