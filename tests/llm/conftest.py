import pytest

from corpuscle.llm.shared import workers_import


@pytest.fixture(autouse=True)
def importable(spark):
    workers_import(spark)


DOCS = "doc_id long, text string, lang string, source string, extra string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and long texts, repeated rows, null ids, columns with clashing names."""
    long = "the quick idea of things that are there and everywhere " * 4000
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, long, "en", "a"), (5, "same words here again", "en", "b"), (5, "same words here again", "en", "b"), (6, "same words here again", "en", None), (None, "no id", "en", "a"), (None, None, None, None), (7, "12 34 !!! ---", "xx", "b"), (8, "日本語のテキスト", None, "c")]
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
