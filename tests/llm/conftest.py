import pytest
from cases import SCHEMA, SF


@pytest.fixture
def frame(spark):
    """Documents from ``(doc_id, text)`` pairs, with columns that clash with results."""
    def build(pairs, clash=True):
        rows = [(i, t, None, "s", len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        names = "score lang_pred kept_text spans hash row doc fp ids own ranges n_words start word"
        from pyspark.sql import functions as F
        return df.withColumns({n: F.lit("clash") for n in names.split()}) if clash else df
    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
