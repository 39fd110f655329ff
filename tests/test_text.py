import random
import sys

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import flagging

SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def _one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()]


def test_whitespace_constant_is_complete():
    assert sorted(T.WHITESPACE) == SPACES


def test_strip_equals_python(spark):
    rng = random.Random(7)
    alphabet = [*SPACES, *"aé😀.​"]
    values = ["".join(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(500)]
    values += [c + "x" + c for c in SPACES]
    assert _one(spark, values, T.strip) == [v.strip() for v in values]


def test_normalise_drops_blank_and_null(spark):
    df = spark.createDataFrame([(1, " a "), (2, "\x1c "), (3, None), (4, "")], "i int, text string")
    assert [tuple(r) for r in flagging.normalise(df).collect()] == [(1, "a")]


def test_excerpt(spark):
    values = ["a\nb" * 200, "😀" * 301, "", "short"]
    assert _one(spark, values, T.excerpt) == [v.replace("\n", " ")[:300] for v in values]


def test_join_cells(spark):
    df = spark.createDataFrame([(" a ", "", "b"), (" ", None, ""), ("x", "y", None)], "a string, b string, c string")
    joined = df.select(T.join_cells([F.col(c) for c in df.columns]).alias("o"))
    assert [r.o for r in joined.collect()] == ["a | b", None, "x | y"]


def test_prompt_keeps_braces_and_percent(spark):
    df = spark.createDataFrame([("c {query} %s", "q {context} $1")], "c string, q string")
    got = df.select(T.prompt(F.col("c"), F.col("q")).alias("o")).first().o
    assert got == (
        "Answer the question using the context below:\n\nc {query} %s\n\nQuestion: q {context} $1"
    )


def test_names(spark):
    names = ["org/Meta-Llama-3", "Qwen2", "gemma-2b", "dphn_x", "cognitive-dolphin-llama", "DeepSeek", "bert", "x_dphn_"]
    families = ["meta-llama", "qwen", "gemma", "dolphin", "dolphin", "meta-llama", "generic", "generic"]
    assert _one(spark, names, T.name_family) == families
    assert _one(spark, ["a/b/c"], T.safe_name) == ["a_b_c"]
    assert _one(spark, ["a/b"], lambda c: T.cache_name(c, F.lit("media"))) == ["spaces--a--b"]
    assert _one(spark, ["a/b"], lambda c: T.cache_name(c, F.lit(None))) == ["models--a--b"]


def test_timestamps(spark):
    ts = spark.sql("select timestamp'2024-03-05 06:07:08.0091' ts")
    row = ts.select(T.file_timestamp(F.col("ts")), T.log_timestamp(F.col("ts"))).first()
    assert tuple(row) == ("20240305_060708", "2024-03-05T06:07:08.009Z")
