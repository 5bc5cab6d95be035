import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def docs(spark):
    """Makes a documents table from (id, text) pairs, with columns whose names clash with inner ones."""
    def make(pairs, extra=True):
        rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F
            for name in ("score", "row", "fp", "label", "key", "n", "words", "ids"):
                df = df.withColumn(name, F.lit("x"))
        return df
    return make


@pytest.fixture(scope="session")
def sample():
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
