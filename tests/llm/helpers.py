"""Rows with every awkward case that the documents table can hold."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("sha", T.StringType()),
    ]
)


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
