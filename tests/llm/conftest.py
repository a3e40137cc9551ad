import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """doc_id, text of the smallest fixture, as plain rows."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) rows, with the other columns of the table
    and two that clash with names used inside the operators."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None, "x", 1) for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, id string, key int")
    return make
