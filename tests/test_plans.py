import csv
import json
from pathlib import Path

import pytest

from plain import counting_matches, excerpt, first_occurrences
from quern import sinks
from quern.operators import validation
from quern.plans import checks, corpus, mixture
from quern.sources.registry import SourceRegistry, SourceSpec

POLICY = corpus.Policy((r"licen[cs]e[ds]?", r"all rights reserved"), ("from",))


def read_csv_parts(path):
    rows = []
    for part in sorted(Path(path).glob("part-*")):
        with part.open(newline="", encoding="utf-8") as handle:
            rows += list(csv.reader(handle))[1:]
    return rows


def read_json_parts(path):
    return [json.loads(x) for p in sorted(Path(path).glob("part-*")) for x in p.read_text().splitlines()]


def test_build_corpus(spark, tmp_path, document_rows):
    folder = tmp_path / "docs"
    folder.mkdir()
    texts = [d["text"] for d in document_rows[:60]] + [document_rows[0]["text"], 'He said "license", | twice', " "]
    for i, text in enumerate(texts):
        (folder / f"{i:03d}.txt").write_text(text, encoding="utf-8", newline="")
    done = corpus.build_corpus(spark, str(folder), str(tmp_path / "out"), POLICY, stamp="20240101_000000")
    stripped = [t.strip() for t in texts if t.strip()]
    unique = [stripped[i] for i in first_occurrences(stripped)[0]]
    stored = [(r.seq, r.text) for r in spark.read.parquet(done.dataset).orderBy("seq").collect()]
    assert stored == list(enumerate(unique))
    want = []
    for i, text in enumerate(unique):
        found = counting_matches(text, POLICY.patterns, POLICY.context_keywords)
        if found:
            want.append([str(i), "|".join(found), excerpt(text)])
    assert want and read_csv_parts(done.quarantine) == want
    assert (done.documents, done.flagged) == (len(unique), len(want))
    clean = {r.seq for r in spark.read.parquet(done.sanitized).collect()}
    assert clean == set(range(len(unique))) - {int(row[0]) for row in want}
    assert done.dataset.endswith("custom_dataset_20240101_000000")
    assert done.sanitized.endswith("sanitized_dataset_20240101_000000")
    assert read_json_parts(done.metadata) == [
        {
            "created_at": "20240101_000000",
            "source_documents_dir": str(folder),
            "document_count": len(unique),
            "sanitized_dataset": done.sanitized,
            "flagged_count": len(want),
            "quarantine_report": done.quarantine,
        }
    ]
    assert read_json_parts(tmp_path / "out/metadata/sanitization_20240101_000000") == [
        {
            "source_dataset": done.dataset,
            "created_at": "20240101_000000",
            "quarantine_report": done.quarantine,
            "flagged_examples": len(want),
            "retained_examples": len(unique) - len(want),
        }
    ]


def test_clean_copy_by_either_way(spark, documents, tmp_path):
    path = str(tmp_path / "data")
    documents.withColumnRenamed("doc_id", "seq").write.parquet(path)
    copies = [
        spark.read.parquet(corpus.sanitize(spark, path, POLICY, str(tmp_path / str(n)), broadcast_flagged=n).dataset)
        for n in (0, 1000)
    ]
    assert copies[0].exceptAll(copies[1]).isEmpty() and copies[0].count() == copies[1].count() < 200


def test_empty_folder_writes_nothing(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    done = corpus.build_corpus(spark, str(tmp_path / "docs"), str(tmp_path / "out"), POLICY)
    assert done == corpus.CorpusResult() and not (tmp_path / "out").exists()


def test_build_without_policy(spark, tmp_path):
    (tmp_path / "a.txt").write_text("license")
    done = corpus.build_corpus(spark, str(tmp_path), str(tmp_path / "out"))
    assert (done.documents, done.flagged, done.sanitized, done.quarantine) == (1, 0, None, None)


def test_everything_flagged_still_writes_a_clean_copy(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.createDataFrame([(0, "license", 5)], "seq long, text string, extra int").write.parquet(path)
    done = corpus.sanitize(spark, path, POLICY)
    assert (done.flagged, done.retained) == (1, 0)
    copy = spark.read.parquet(done.dataset)
    assert copy.count() == 0 and copy.columns == ["seq", "text", "extra"]
    report = corpus.sanitize(spark, path, POLICY, str(tmp_path / "other"), save=False)
    assert report.dataset is None


@pytest.fixture
def sources(spark):
    made = SourceRegistry()
    made.add("mixed", lambda s: s.createDataFrame(
        [(1, "one", None), (2, "", "two"), (3, None, None), (4, "four", None)], "id int, text string, content string"))
    made.add("split", lambda s: s.createDataFrame([(1, "only"), (2, "more")], "id int, text string"), "validation")
    return made


def test_prepare_mixture(spark, sources, tmp_path):
    jsonl = tmp_path / "clean.jsonl"
    jsonl.write_text('{"text":"three"}\n{"prompt":"é \\"four\\""}\n{"text":"late"}\n')
    lines = tmp_path / "own.txt"
    lines.write_text("five\n\nsix\nlate\n")
    specs = [SourceSpec("mixed"), SourceSpec("split", "train", 1)]
    args = dict(sanitized=str(jsonl), custom=str(lines), max_examples=2)
    want = ["one", "two", "only", "three", 'é "four"', "five"]
    out = str(tmp_path / "out.jsonl")
    got = [r.text for r in mixture.prepare_mixture(spark, specs, sources, output=out, **args).collect()]
    assert got == want
    assert [r["text"] for r in read_json_parts(out)] == want
    assert "é" in "".join(p.read_text() for p in Path(out).glob("part-*"))
    mixed = [r.text for r in mixture.prepare_mixture(spark, specs, sources, shuffle=True, **args).collect()]
    assert sorted(mixed) == sorted(want)
    assert mixture.prepare_mixture(spark, [], sources, custom=str(tmp_path / "none.txt")).collect() == []
    assert mixture.prepare_mixture(spark, [], sources).collect() == []


def test_mixture_reads_stored_datasets(spark, sources, tmp_path):
    path = str(tmp_path / "stored")
    spark.createDataFrame([(0, "zero"), (1, "one")], "seq long, text string").coalesce(1).write.parquet(path)
    assert [r.text for r in mixture.prepare_mixture(spark, [], sources, sanitized=path, max_examples=1).collect()] == ["zero"]


def test_csv_and_json_lines_keep_odd_text(spark, tmp_path):
    phrases = [['a "quoted"', " b,c "], ["line"]]
    df = spark.createDataFrame([(i, p, ' x\t"y",z ') for i, p in enumerate(phrases)], "seq long, phrases array<string>, excerpt string")
    sinks.write_quarantine(df.coalesce(1), str(tmp_path / "q.csv"))
    assert read_csv_parts(tmp_path / "q.csv") == [["0", 'a "quoted"| b,c ', ' x\t"y",z '], ["1", "line", ' x\t"y",z ']]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_quarantine(df, str(tmp_path / "q.csv"))


def test_validation(spark, documents, tmp_path):
    path = str(tmp_path / "data")
    documents.write.parquet(path)
    good = validation.validate(spark, path, ["text"], 200)
    assert good.valid and good.length == 200 and good.columns == documents.columns
    bad = validation.validate(spark, path, ["text", "summary"], 201)
    assert not bad.valid and set(bad.errors) == {"size", "columns"}
    assert set(validation.validate(spark, str(tmp_path / "none")).errors) == {"path"}
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.parquet").write_text("no table")
    assert set(validation.validate(spark, str(tmp_path / "odd")).errors) == {"load"}
    out = tmp_path / "meta"
    assert not checks.record_validation(spark, path, str(out), ["summary"]).valid and not out.exists()
    assert checks.record_validation(spark, path, str(out), ["text"]).valid
    assert read_json_parts(out) == [{"length": 200, "columns": documents.columns}]
    report = {r.check: r for r in validation.validation_report(documents, ["summary"], 201).collect()}
    assert report["size"].message == bad.errors["size"] and not report["size"].ok
    assert "summary" in report["columns"].message
    assert all(r.ok and r.message == "" for r in validation.validation_report(documents, ["text"]).collect())
    assert validation.estimated_length(spark.range(5000)).first().length == 1000
    assert validation.estimated_length(spark.range(5)).first().length == 5
    meta = validation.dataset_metadata(documents).first()
    assert (meta.length, meta.columns) == (200, documents.columns)


def test_rejects_end_a_build_or_are_stored(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("fine")
    (tmp_path / "docs/b.docx").write_text("no archive")
    with pytest.raises(ValueError, match="1 files cannot be read.*b.docx"):
        corpus.build_corpus(spark, str(tmp_path / "docs"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    done = corpus.build_corpus(spark, str(tmp_path / "docs"), str(tmp_path / "out"), stamp="now", accept_rejects=True)
    assert done.documents == 1 and done.fields["rejected_files"] == 1
    assert spark.read.parquet(str(tmp_path / "out/rejects_now")).first().reason.startswith("broken: ")


def test_a_build_leaves_no_intermediate_tables(spark, tmp_path):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("license")
    before = set(folder.iterdir())
    corpus.build_corpus(spark, str(tmp_path / "docs"), str(tmp_path / "out"), POLICY)
    assert set(folder.iterdir()) == before
