import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns that clash with the operators' own names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), T.StructField("rid", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n", T.StringType()), T.StructField("key", T.StringType())])

    def make(rows, lang="en", source="src0"):
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", "x", "x", "x") for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
