import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plain import record_text
from quern.functions.records import joined_responses, pick_text, row_text, with_json_text

LINES = [
    '{"text":"","content":0,"instruction":false,"prompt":"  "}',
    '{"text":1.50}', '{"text":1.0}', '{"text":1e5}', '{"text":12345678901234567890123}',
    '{"text":true}', '{"text":false,"content":true}', '{"text":null,"content":"c"}', '{"text":-0.0}',
    '{"text":[],"content":{},"prompt":"p"}', '{"z":"zz","a":" ","b":"bb","n":3}', '{"n":1}', "{}",
    "5", '"str"', '""', "null", "true", "false", "not json", "  padded  ", "", "   ",
    '{"a":"x","a":"y","text":"t"}', '{"text":"a","text":"b"}', '{"text":"\\u00e9\\n"}', ' {"text":" sp "} ',
    '{"text":"a"} x', "1],[2", "5,7", "{'text':'x'}", '{"text":"tab\there"}', '{"text": "open', '{"content":"é😀"}',
    '{"b":"second","instruction":"i","text":""}', '{"TEXT":"upper"}', "01", "[1",
]


def _texts(spark, lines, **options):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    return [r.text for r in with_json_text(df, "line", **options).orderBy("i").collect()]


@pytest.mark.parametrize("fallback", ["first", "join"])
def test_json_lines_equal_plain_loop(spark, fallback):
    got = dict(zip(LINES, _texts(spark, LINES, fallback=fallback)))
    assert got == {line: record_text(line, fallback=fallback) for line in LINES}


def test_random_objects(spark):
    rng = random.Random(3)
    values = ["", " ", "a", "é😀", 0, 7, -1, 2.5, True, False, None, "it's \"q\"", "x\ny"]
    names = ["text", "content", "instruction", "prompt", "other", "z", "a b"]
    lines = []
    for _ in range(300):
        keys = rng.sample(names, rng.randint(0, 5))
        lines.append(json.dumps({k: rng.choice(values) for k in keys}, ensure_ascii=rng.random() < 0.5))
    for fallback in ("first", "join"):
        assert _texts(spark, lines, fallback=fallback) == [record_text(x, fallback=fallback) for x in lines]


def test_containers_come_as_json(spark):
    lines = ['{"text":[1,"a"]}', '{"text":{"b":1,"a":2}}', "[1,2]", '[{"text":"in"}]']
    assert _texts(spark, lines) == ['[1,"a"]', '{"b":1,"a":2}', "[1,2]", '[{"text":"in"}]']


def test_bad_parameters(spark):
    df = spark.createDataFrame([("x",)], "line string")
    with pytest.raises(ValueError):
        with_json_text(df, "line", fallback="other")
    with pytest.raises(ValueError):
        with_json_text(df, "line", keys=["a'b"])


def test_typed_rows(spark):
    df = spark.createDataFrame(
        [
            Row(i=0, text="t", prompt="p", n=1, flag=True, note="x"),
            Row(i=1, text="", prompt="p", n=1, flag=True, note="x"),
            Row(i=2, text=None, prompt="", n=0, flag=False, note=" "),
            Row(i=3, text="", prompt=None, n=0, flag=True, note="only"),
        ],
        "i int, text string, prompt string, n int, flag boolean, note string",
    )
    def got(**kw):
        return [r.o for r in df.select("i", row_text(df, **kw).alias("o")).orderBy("i").collect()]

    assert got() == ["t", "p", None, "only"]
    assert got(keys=("n", "flag", "text")) == ["1", "1", None, "True"]
    assert got(keys=(), fallback="join") == ["t p x", "p x", None, "only"]
    assert got(keys=(), fallback="first") == ["t", "p", None, "only"]


def test_pick_text(spark):
    df = spark.createDataFrame([(1, "b", "i")], "n int, body string, input string")
    assert df.select(pick_text(df)).first().text == "i"
    other = df.drop("input").withColumn("gone", F.lit(None).cast("string"))
    assert other.select(pick_text(other)).first().text == '{"n":1,"body":"b","gone":null}'


def test_joined_responses(spark):
    body = (
        '{"response":"a"}\n\nbad\r\n{"response":5}\r{"response":" b "}\n{"other":1}\n{"response":null}\n'
        '{"response":"t"} x\n{"response":"t"},5\n[{"response":"q"}]\n  {"response":"\\u00e9","done":true}  '
    )
    repeated = '{"response":"a","response":"b"}\n{"response":"c"}\n{"response":"d","response":1}\n{"response":"e"},{"response":"f"}'
    df = spark.createDataFrame([(body,), ("",), ("x",), (repeated,)], "b string")
    assert [r.o for r in df.select(joined_responses(F.col("b")).alias("o")).collect()] == ["a b é", "", "", "bc"]
