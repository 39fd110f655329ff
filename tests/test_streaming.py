import pytest

from quern.functions.text import prompt
from quern.operators import encoding, flagging
from quern.streaming.runs import run_available, stream_table, without_repeats
from pyspark.sql import functions as F

PATTERNS, KEYWORDS = (r"licen[cs]e[ds]?", r"all rights reserved"), ("from",)
PHRASES = ("license", "all rights reserved")

OPERATORS = {
    "normalise": flagging.normalise,
    "flag": lambda df: flagging.flagged(df, PATTERNS, KEYWORDS),
    "retain": lambda df: flagging.retained(df, PATTERNS, KEYWORDS),
    "banned": lambda df: flagging.filter_banned(df, PHRASES),
    "banned_long": lambda df: flagging.filter_banned(df, PHRASES, contains_limit=0),
    "scan": lambda df: flagging.scan_phrases(df.select("doc_id", "text"), PHRASES),
    "redact": lambda df: flagging.redact(df, PHRASES),
    "prefix": lambda df: encoding.add_prefix(df, "Read: "),
    "prompt": lambda df: df.select("doc_id", prompt(F.col("text"), F.col("lang")).alias("prompt")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_stream_equals_batch(spark, documents, tmp_path, name):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    operator = OPERATORS[name]
    first, second = documents.filter("doc_id < 100"), documents.filter("doc_id >= 100")
    first.repartition(3).write.mode("append").parquet(source)
    run = f"{name}-{tmp_path.name}"
    for more in (None, second):
        if more is not None:
            more.repartition(2).write.mode("append").parquet(source)
        stream = stream_table(spark, source, documents.schema, max_files=1)
        run_available(stream, operator, output, run)
    want = operator(documents)
    got = spark.read.schema(want.schema).parquet(output)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty()


def test_repeats_across_runs(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "n long, text string, digest string, day long"

    def deliver(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = stream_table(spark, source, spark.createDataFrame([], schema).schema).withColumn("at", F.timestamp_seconds(F.col("day") * 86_400))
        run_available(stream, lambda df: without_repeats(df, "at", "3 days"), output, tmp_path.name)
        return sorted(r.n for r in spark.read.parquet(output).collect())

    assert deliver((1, "a", "x", 1), (2, "b", "x", 1), (3, None, "x", 1), (4, "", "x", 1)) == [1, 2, 3, 4]
    assert deliver((5, "a", "y", 2), (6, None, "x", 2), (7, "c", "x", 2), (8, "", "x", 2)) == [1, 2, 3, 4, 7]
    assert deliver((9, "a", "x", 9)) == [1, 2, 3, 4, 7]  # the watermark moves after this delivery
    assert deliver((10, "a", "x", 10), (11, "d", "x", 5), (12, "c", "x", 9)) == [1, 2, 3, 4, 7, 10, 12]  # 11 is late
    assert deliver() == [1, 2, 3, 4, 7, 10, 12]


def test_repeats_of_a_table(spark, documents):
    rows = documents.unionByName(documents)
    found = without_repeats(rows, "n_chars", "1 day")
    assert found.count() == documents.select("text").distinct().count() and found.columns == documents.columns
    assert without_repeats(rows, "n_chars", "1 day", keys=["source"]).count() == documents.select("text", "source").distinct().count()
