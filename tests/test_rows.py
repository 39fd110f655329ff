"""Duplicates, order, limits, splits and mixing."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from plain import first_occurrences
from quern.operators import dedup, mixing, ordering


def test_dedup_keeps_first(documents, document_rows):
    unique, _ = first_occurrences([d["text"] for d in document_rows])
    kept = dedup.dedup_exact(documents.repartition(7), order=["doc_id"])
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == unique
    assert dedup.dedup_exact(kept, order=["doc_id"]).count() == len(unique)


def test_dedup_by_compound_order(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("a", 2, "x"), ("a", 1, "x"), ("a", 1, None), ("b", 1, None)], "p string, r int, text string")
    kept = dedup.dedup_exact(df, order=["p", "r"])
    assert sorted((r.p, r.r, str(r.text)) for r in kept.collect()) == [("a", 1, "None"), ("a", 1, "x")]


def test_dedup_of_one_hot_text(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    kept = dedup.dedup_exact(df.repartition(8), order=["id"])
    assert kept.count() == 20_001 and kept.filter("text = 'same'").first().id == 1
    report = dedup.dedup_report(df, "text", "id")
    assert report.filter("is_duplicate").count() == 39_999


def test_dedup_report(spark):
    names = ["a/b", " a/b", "A/B", "c", "a/b", "c "]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "seq int, name string")
    for lower in (False, True):
        keys = [n.strip().lower() if lower else n.strip() for n in names]
        _, duplicates = first_occurrences(keys)
        rows = dedup.dedup_report(df, "name", lower=lower).collect()
        assert sorted(r.seq for r in rows if r.is_duplicate) == duplicates
        assert sorted((r.seq, r.name) for r in rows) == list(enumerate(names))


def key(seed, *ids):
    return hashlib.md5("|".join(map(str, (seed, *ids))).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 7, 199, 200, 500])
def test_first_rows_by_either_way(documents, n):
    ids = sorted(range(200), key=lambda i: key(42, i))[:n]
    for limit in (1000, 0):
        got = [r.doc_id for r in ordering.first_rows(documents, n, ["doc_id"], 42, top_k_rows=limit).collect()]
        assert got == ids


def test_first_rows_in_order(documents):
    for limit in (1000, 0):
        got = ordering.first_rows(documents.repartition(5), 37, ["doc_id"], top_k_rows=limit).collect()
        assert sorted(r.doc_id for r in got) == list(range(37))
        assert got[0].asDict().keys() == set(documents.columns)


def test_exact_split(documents):
    for share in (0.1, 0.25, 0.0, 1.0):
        rows = ordering.split_exact(documents, ["doc_id"], share, seed=5).collect()
        test = {r.doc_id for r in rows if r.split == "test"}
        want = sorted(range(200), key=lambda i: key(5, i))[: math.ceil(share * 200)]
        assert test == set(want) and len(rows) == 200
    again = ordering.split_exact(documents.repartition(5), ["doc_id"], 0.1, seed=5)
    once = ordering.split_exact(documents, ["doc_id"], 0.1, seed=5)
    assert again.exceptAll(once).isEmpty()
    assert ordering.split_exact(documents.limit(0), ["doc_id"]).count() == 0


def test_exact_split_with_stored_ids(documents):
    ids = documents.select("doc_id")
    plain = ordering.split_exact(documents, ["doc_id"])
    assert ordering.split_exact(documents, ["doc_id"], ids=ids).exceptAll(plain).isEmpty()


def test_bucket_split_is_close(spark):
    counts = ordering.split_by_bucket(spark.range(20_000), ["id"], 0.1).groupBy("split").count().collect()
    test = {r.split: r["count"] for r in counts}["test"]
    assert 1800 < test < 2200


def test_head_per_source(documents):
    want = {(r.source, r.doc_id) for r in documents.collect() if r.doc_id // 20 < 3}
    small = ordering.head_per_source(documents, 3, "source", ["doc_id"])
    assert {(r.source, r.doc_id) for r in small.collect()} == want
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_head_per_source_beyond_spark_rule(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("source"))
    kept = ordering.head_per_source(df, 1500, "source", ["id"], salts=8)
    rows = kept.groupBy("source").agg(F.count("*").alias("n"), F.max("id").alias("last")).collect()
    assert {r.source: (r.n, r.last) for r in rows} == {"hot": (1500, 2248), "cold": (1500, 4499)}


def test_assign_seq(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("t").alias("t")).repartition(9)
    rows = ordering.assign_seq(df, ["x"]).collect()
    assert len(rows) == 5000 and all(r.seq == r.x for r in rows)


def frame(spark, name, n):
    return spark.createDataFrame([(i, f"{name}{i}") for i in range(n)], "seq int, text string")


def test_concat(spark):
    a, b = frame(spark, "a", 2), frame(spark, "b", 1).withColumn("extra", F.lit(1))
    rows = mixing.concat_sources([a, None, b]).collect()
    assert sorted((r.text, r.source_rank, r.extra) for r in rows) == [("a0", 0, None), ("a1", 0, None), ("b0", 1, 1)]
    with pytest.raises(ValueError):
        mixing.concat_sources([None])


def test_mix(spark):
    parts = [frame(spark, "a", 5), frame(spark, "b", 1), frame(spark, "c", 3)]
    rows = mixing.mix_sources(parts, 2).collect()
    assert [r.text for r in rows] == ["a0", "a1", "b0", "c0", "c1"]
    mixed = mixing.mix_sources(parts, 2, shuffle=True, seed=9).collect()
    ids = [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)]
    want = sorted(ids, key=lambda i: key(9, *i))
    assert [(r.source_rank, r.seq) for r in mixed] == want
    everything = mixing.concat_sources(parts)
    assert len(mixing.order_and_cap(everything, 4, True, 9).collect()) == 4
