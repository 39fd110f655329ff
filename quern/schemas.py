"""Output schemas shared by readers, operators and sinks."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("format_rank", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

# Columns that, in this order, give the order of documents read from files.
FILE_ORDER = ("format_rank", "path", "block", "row")

PHRASE_HIT = T.StructType(
    [
        T.StructField("phrase", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("severity", T.IntegerType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("context", T.StringType()),
    ]
)

NEIGHBOURS = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("d2", T.DoubleType()),
    ]
)
