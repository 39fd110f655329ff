"""Every registered query, its SQL, and the pipeline against brute-force stages."""

import random
from collections import Counter

import plain_llm as plain
import pytest
from conftest import SMALL

import __spark_entry__ as contract
import corpus_pipeline
from compare import compare, connect
from quern.llm import decontamination
from quern.llm.queries import QUERIES, SQL

N_DOCUMENTS = 200
ROWS = {"op12_centroid_clusters": 500}


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_keys():
    assert [name.split("_")[0] for name in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
    assert set(SQL) <= set(QUERIES) and {*QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    ok, note = compare(spark, connection, SMALL, name)
    assert ok, note
    if name != "op6_benchmark_leaks":
        assert note.startswith(f"{ROWS.get(name, N_DOCUMENTS)} rows")


def table(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")


def brute_force(rows, items):
    """Rows after the first four stages, and the byte sums their shards must have."""
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    rows = plain.first_of_classes(rows)
    bad = {doc_id for doc_id, _ in plain.leaks(rows, items, decontamination.UNITS)}
    rows = [r for r in rows if r["doc_id"] not in bad]
    return [r for r, n in zip(rows, plain.mix(rows), strict=True) for _ in range(n)]


def test_pipeline_as_brute_force(spark, tmp_path):
    given = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [r.asDict() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    draw = random.Random(4)
    n = 10_000
    more = []
    for text in (None, "", "123 456", given[0]["text"], given[1]["text"] + " tail", items[3]["text"] + " " + given[2]["text"], items[5]["text"]):
        n += 1
        more.append(dict(doc_id=n, text=text, lang=None, source=draw.choice([None, "src1", "rare"]), n_chars=None))
    rows = given + more
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, tmp_path, [tuple(r.values()) for r in rows])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_force(rows, items)
    columns = list(given[0])
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(tuple(r.values()) for r in want)
    own, capacity, _ = plain.shard_loads(want, 40)
    loads = Counter()
    for r in got:
        loads[r.shard] += len(r.text.encode()) + 16
    assert max(loads.values()) == max([capacity, *own])
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, tmp_path, [])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and got.count() == 0
