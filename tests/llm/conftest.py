import pytest

from llm.samples import ODD, SF


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, one of them under a repeated id, one without an id, beside columns whose names clash."""
    rows = [(i, t, "en" if i % 2 else None, None, i) for i, t in enumerate(ODD)] + [(4, "a", None, None, 0), (None, "no id", None, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 AS _id", "2 AS _text", "3 AS ids", "4 AS score", "5 AS _fp", "6 AS lang_pred", "7 AS spans")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")
