import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, fp string, block string, words string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use inside."""
    def make(rows, parts=3):
        full = [(i, t, "en", s, 0, 7, "x", "y", "z", "w") for i, t, s in ((*r, "s0")[:3] if len(r) == 2 else r for r in rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)
    return make
