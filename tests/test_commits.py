import json

import pytest
from pyspark.sql import functions as F

from quern import commits, sinks
from quern.plans import corpus
from quern.sources import paths, registry


def rows(df):
    return sorted(map(tuple, df.collect()))


def numbers(spark, n, parts=3):
    return spark.range(n, numPartitions=parts).select("id", F.col("id").cast("string").alias("text"))


def test_commit_tells_rows_files_and_digest(spark, tmp_path):
    path = str(tmp_path / "custom_dataset_1")
    assert commits.write_committed(numbers(spark, 100), path, kind="custom") == 100
    told = commits.record(spark, path)
    assert (told["rows"], told["kind"], told["files"]) == (100, "custom", 3)
    stored = commits.read_committed(spark, path)
    assert rows(stored) == [(i, str(i)) for i in range(100)]
    assert stored.agg(commits.row_digest(stored)).first()[0] == told["digest"]
    assert rows(commits.damage(spark, path)) == []
    with pytest.raises(FileExistsError):
        commits.write_committed(numbers(spark, 5), path)


def test_digest_ignores_order_and_sees_values(spark, tmp_path):
    a, b, c = numbers(spark, 50), numbers(spark, 50, 7).orderBy(F.desc("id")), numbers(spark, 50).withColumn("text", F.lit("1"))
    digests = [df.agg(commits.row_digest(df)).first()[0] for df in (a, b, c)]
    assert digests[0] == digests[1] != digests[2]


@pytest.mark.parametrize("schema", ["id long, text string", "id long, m map<string,int>", "m map<string,int>", "`a b` long, `c``d` string"])
def test_empty_and_odd_columns(spark, tmp_path, schema):
    path = str(tmp_path / "made")
    assert commits.write_committed(spark.createDataFrame([], schema), path) == 0
    assert commits.read_committed(spark, path).count() == 0
    assert rows(commits.damage(spark, path)) == []


def test_lost_and_changed_files_are_found(spark, tmp_path):
    path = tmp_path / "custom_dataset_1"
    commits.write_committed(numbers(spark, 90), str(path))
    sorted(path.glob("part-*"))[0].unlink()
    found = commits.damage(spark, str(path)).collect()
    assert sorted(r.file is None for r in found) == [False, True]
    assert [(r.expected, r.found) for r in found if r.file] == [("30", None)]


def test_unfinished_writes_are_passed_over_and_replaced(spark, tmp_path):
    root = str(tmp_path)
    broken = f"{root}/sanitized_dataset_2"
    fails = numbers(spark, 10).withColumn("text", F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        commits.write_committed(fails, broken)
    commits.write_committed(numbers(spark, 4), f"{root}/custom_dataset_1")
    assert commits.is_unfinished(spark, broken)
    with pytest.raises(FileNotFoundError):
        registry.read_dataset(spark, broken)
    known = registry.stored_datasets(spark, root)
    assert [(r.kind, r.created_at) for r in known.collect()] == [("custom", "1")]
    assert registry.preferred_dataset(known).first().path.endswith("/custom_dataset_1")
    commits.write_committed(numbers(spark, 3), broken)
    assert registry.read_dataset(spark, broken).count() == 3
    assert registry.preferred_dataset(registry.stored_datasets(spark, root)).first().kind == "sanitized"


def test_folders_of_others_are_read_and_never_replaced(spark, tmp_path):
    path = str(tmp_path / "custom_dataset_1")
    numbers(spark, 6).write.parquet(path)
    assert registry.read_dataset(spark, path).count() == 6
    assert registry.stored_datasets(spark, str(tmp_path)).count() == 1
    with pytest.raises(FileExistsError):
        commits.write_committed(numbers(spark, 2), path)
    assert registry.read_dataset(spark, path).count() == 6


@pytest.mark.parametrize("step", ["write_quarantine", "write_metadata"])
def test_repeated_build_after_an_end_half_way(spark, tmp_path, monkeypatch, step):
    source, root = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, text in enumerate(["one", "two secret", "three", "one"]):
        (source / f"{i}.txt").write_text(text)
    policy = corpus.Policy([r"secret"])

    def build():
        return corpus.build_corpus(spark, str(source), str(root), policy, stamp="s")

    def ended(*args, **kwargs):
        raise RuntimeError("ended")

    with monkeypatch.context() as patch:
        patch.setattr(sinks, step, ended)
        with pytest.raises(RuntimeError, match="ended"):
            build()
    assert commits.is_unfinished(spark, f"{root}/metadata/build_s")
    done = build()
    assert (done.documents, done.flagged) == (3, 1)
    assert sorted(r.text for r in registry.read_dataset(spark, done.sanitized).collect()) == ["one", "three"]
    told = json.loads("".join(r.value for r in spark.read.text(done.metadata).collect()))
    assert told["document_count"] == 3 and commits.is_committed(spark, done.metadata)
    with pytest.raises(FileExistsError):
        build()
    assert registry.read_dataset(spark, done.dataset).count() == 3


def test_small_files_are_replaced_whole(spark, tmp_path):
    name = str(tmp_path / "a" / "_x.json")
    paths.put_text(spark, name, "é")
    assert paths.read_text(spark, name) == "é"
    paths.delete(spark, name)
    paths.delete(spark, name)
    assert not paths.exists(spark, name)
