import os
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.schemas import FILE_ORDER
from quern.sources import documents as D
from quern.sources.paths import first_files
from quern.sources.registry import SourceRegistry, load_source
from quern.sources import lines as L
from quern.sources import registry as R
from quern.suite.queries import QUERIES


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def texts(df, order=FILE_ORDER):
    return [r.text for r in df.orderBy(*order).collect()]


def test_csv_text_column(spark, tmp_path):
    write(tmp_path, "a.csv", 'id,TEXT,text\n1,  a b ,zz\n2,,q\n3,"x\ny, ""z""",w\n\n4,last\n')
    assert texts(D.read_csv_documents(spark, str(tmp_path))) == ["a b", 'x\ny, "z"', "last"]


def test_csv_joined_cells(spark, tmp_path):
    write(tmp_path, "a.CSV", "a,b\n1, \n , \nx,y\np,q,r\n\n")
    assert texts(D.read_csv_documents(spark, str(tmp_path))) == ["1", "x | y", "p | q | r"]


def test_csv_without_header(spark, tmp_path):
    write(tmp_path, "a.csv", "\na, b\n\nc,,d\n")
    assert texts(D.read_csv_documents(spark, str(tmp_path))) == ["a | b", "c | d"]


def test_csv_byte_order_mark_hides_the_text_header(spark, tmp_path):
    mark = b"\xef\xbb\xbf"
    write(tmp_path, "a.csv", mark + b"text,b\n1,2\n")
    write(tmp_path, "b.csv", mark + b"text,b\r\n3,4")
    write(tmp_path, "c.csv", b"text,b\r\n5,6")
    write(tmp_path, "d.csv", b"text,b\n7,8")
    write(tmp_path, "e.csv", mark + b"b,text\n9,10\n")
    assert texts(D.read_csv_documents(spark, str(tmp_path))) == ["1 | 2", "3 | 4", "5", "7", "10"]


def test_csv_line_ends(spark, tmp_path):
    write(tmp_path, "a.csv", b"n,text\r\n1,a\r\n\r\n2,b\r\n")
    write(tmp_path, "b.csv", b"n,text\r1,c\r2,d\r")
    write(tmp_path, "c.csv", b"\r\nx,y\r\n")
    assert texts(D.read_csv_documents(spark, str(tmp_path))) == ["a", "b", "c", "d", "x | y"]


def test_csv_repeated_headers(spark, tmp_path):
    write(tmp_path, "a.csv", "text,n,text\n1,2,3\n")
    write(tmp_path, "b.csv", "a,b,a\n1,2,3\n")
    assert texts(D.read_csv_documents(spark, str(tmp_path))) == ["3", "3 | 2"]


def test_csv_files_of_different_widths(spark, tmp_path):
    write(tmp_path, "a.csv", "n,Text\n1,one\n2,two\n")
    write(tmp_path, "b.csv", "p,q,r,s\n1,2,3,4\n")
    write(tmp_path, "c.csv", "solo\nx\n")
    write(tmp_path, "d.txt", "ignored")
    assert texts(D.read_csv_documents(spark, str(tmp_path))) == ["one", "two", "1 | 2 | 3 | 4", "x"]


def test_csv_many_files_keep_order(spark, tmp_path):
    for i in range(12):
        rows = "".join(f"{i}-{j}\n" for j in range(50 * (i % 3) + 1))
        write(tmp_path, f"f{i:02d}.csv", "text\n" + rows)
    want = [f"{i}-{j}" for i in range(12) for j in range(50 * (i % 3) + 1)]
    assert texts(D.read_csv_documents(spark, str(tmp_path))) == want


def test_text_files(spark, tmp_path):
    write(tmp_path, "a.txt", "  hi\nthere \n")
    write(tmp_path, "b.TXT", " \n\t")
    write(tmp_path, "c.TXT", "c")
    assert texts(D.read_text_documents(spark, str(tmp_path))) == ["hi\nthere", "c"]
    assert texts(D.read_text_documents(spark, str(tmp_path), max_bytes=3)) == ["c"]
    left_out = D.oversized(spark, str(tmp_path), ["txt"], max_bytes=3).collect()
    assert [os.path.basename(r.path) for r in left_out] == ["a.txt"]


def test_small_text_files_share_tasks(spark, tmp_path):
    for i in range(120):
        write(tmp_path, f"{i}.txt", f"text {i}")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = D.read_text_documents(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(texts(found)) == sorted(f"text {i}" for i in range(120))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_pages_share_folders(spark, tmp_path):
    """A file for each page, in folders of many; rows of one id, or without one, share a file within a task."""
    rows = [(i, f"page {i}") for i in range(230)] + [(7, "again"), (None, "x"), (None, "y"), (300, None), (301, " ")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("texts-*"))
    found = [r.text for r in QUERIES["text_folder"](spark, str(tmp_path)).collect()]
    once = [f"page {i}" for i in range(230) if i != 7]
    assert sorted(t for t in found if t in once) == sorted(once)
    joined = sorted(sorted(part.strip() for part in t.split("\n") if part.strip()) for t in found if t not in once)
    assert joined == [["again", "page 7"], ["x", "y"]]
    (made,) = set(root.glob("texts-*")) - before
    assert len(list(made.glob("folder=*"))) <= 2 and len(list(made.glob("*/*.txt"))) == 233


WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, body):
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {WORD}><w:body>{body}</w:body></w:document>")


def epub(path, pages):
    items = "".join(
        f'<item id="p{i}" href="{name}" media-type="application/xhtml+xml"/>' for i, (name, _) in enumerate(pages)
    )
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr(
            "META-INF/container.xml",
            '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
            '<rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        )
        archive.writestr(
            "OPS/book.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}'
            '<item id="c" href="s.css" media-type="text/css"/></manifest></package>',
        )
        for name, page in pages:
            archive.writestr(f"OPS/{name}", page)


def test_packed_files(spark, tmp_path, capfd):
    docx(
        tmp_path / "a.docx",
        "<w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>W</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>é</w:t></w:r></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>",
    )
    write(tmp_path, "broken.docx", "no archive")
    epub(tmp_path / "b.epub", [("2.xhtml", "<html><body class='x'><p>two</p></body></html>"), ("1.xhtml", "<html><body><p>one</p>\n</body></html>")])
    assert texts(D.read_binary_documents(spark, str(tmp_path), "docx", D.docx_text)) == ["Hello\tW\n\né"]
    assert texts(D.read_binary_documents(spark, str(tmp_path), "epub", D.epub_text)) == ["<p>two</p><p>one</p>"]


def test_mixed_folder_keeps_format_order(spark, tmp_path):
    docx(tmp_path / "0.docx", "<w:p><w:r><w:t>word</w:t></w:r></w:p>")
    epub(tmp_path / "1.epub", [("p.xhtml", "<html><body>page</body></html>")])
    write(tmp_path, "2.txt", "plain")
    write(tmp_path, "3.csv", "text\ncell\n")
    write(tmp_path, "4.pdf", "PDF!")
    assert texts(D.collect_documents(spark, str(tmp_path))) == ["cell", "plain", "page", "word"]
    own = D.collect_documents(spark, str(tmp_path), {"pdf": lambda content: content.decode().lower()})
    assert texts(own) == ["cell", "plain", "pdf!", "page", "word"]


def test_empty_folder(spark, tmp_path):
    assert texts(D.collect_documents(spark, str(tmp_path))) == []


def test_lines_count_blank_ones(spark, tmp_path):
    path = write(tmp_path, "a.lines", " a \n\nb\n \nc\n")
    assert texts(L.read_lines(spark, path), L.LINE_ORDER) == ["a", "b", "c"]
    assert texts(L.read_lines(spark, path, 3), L.LINE_ORDER) == ["a", "b"]
    assert texts(L.read_lines(spark, str(tmp_path / "none")), L.LINE_ORDER) == []


def test_jsonl_sample(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"text":"one"}\n{"prompt":"two"}\n{"content":"three"}\n')
    assert texts(L.read_jsonl(spark, path, 2), L.LINE_ORDER) == ["one", "two"]
    flags = write(tmp_path, "b.jsonl", '{"text":"one"}\n{"ok":true}\n{"x":"two"}\n')
    assert texts(L.read_jsonl(spark, flags), L.LINE_ORDER) == ["one", "two"]
    pretty = write(tmp_path, "c.json", '{\n "text": "whole"\n}\n')
    assert texts(L.read_jsonl(spark, pretty), L.LINE_ORDER) == ["{", '"text": "whole"', "}"]
    assert texts(L.read_jsonl(spark, pretty, multiline=True), L.LINE_ORDER) == ["whole"]


def test_head_of_a_split_file(spark, tmp_path):
    path = write(tmp_path, "a.lines", "".join(f"line {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = L.raw_lines(spark, path)
        assert lines.select("block").distinct().count() > 5
        want = {f"line {i}" for i in range(1234)}
        for limit in (10_000, 10):
            head = [r.value for r in L.head_lines(lines, 1234, top_k_rows=limit).collect()]
            assert len(head) == 1234 and set(head) == want
        assert L.head_lines(lines, 5000, top_k_rows=10).count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_word_list_comment_modes(spark, tmp_path):
    path = write(tmp_path, "words", "Bad\n\n# note\n  # inner\n two words \n")
    assert L.read_word_list(spark, path) == ["Bad", "# note", "# inner", "two words"]
    assert L.read_word_list(spark, path, "raw", lower=True) == ["bad", "# inner", "two words"]
    assert L.read_word_list(spark, path, "stripped") == ["Bad", "two words"]
    assert L.read_word_list(spark, str(tmp_path / "none")) == []
    with pytest.raises(ValueError):
        L.read_word_list(spark, path, "other")
    assert R.source_names(spark, "a, b,,", path) == ["a", "b", "Bad", "two words"]


def test_named_sources(spark):
    sources = R.SourceRegistry()
    sources.add("one", lambda s: s.range(10).toDF("id"), "validation")
    sources.add("one", lambda s: s.range(100, 110).toDF("id"), "train")
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(R.load_source(spark, sources, "one")) == list(range(100, 110))
    assert ids(R.load_source(spark, sources, "one", "absent", 3)) == [0, 1, 2]
    assert ids(R.load_source(spark, sources, "one", "train", 2, order=["id"])) == [100, 101]


def test_catalog(spark):
    catalog = spark.createDataFrame(
        [("/d/custom_dataset_1", 5), ("/d/custom_dataset_2", 9), ("/d/sanitized_dataset_1", 3), ("/d/other", 99)],
        "path string, created_at int",
    ).withColumn("kind", R.dataset_kind(F.col("path")))
    newest = {r.kind: r.path for r in R.latest_by_kind(catalog).collect()}
    assert newest == {"custom": "/d/custom_dataset_2", "sanitized": "/d/sanitized_dataset_1", None: "/d/other"}
    assert R.preferred_dataset(catalog).first().path == "/d/sanitized_dataset_1"
    custom = catalog.filter("kind = 'custom'")
    assert R.preferred_dataset(custom).first().path == "/d/custom_dataset_2"
    assert R.preferred_dataset(catalog.filter("kind is null")).collect() == []


def test_docx_links_stay_in_place(spark, tmp_path):
    docx(
        tmp_path / "a.docx",
        "<w:p><w:r><w:t>See </w:t></w:r><w:hyperlink><w:r><w:t>LINK</w:t></w:r></w:hyperlink><w:r><w:t> for more</w:t></w:r></w:p>",
    )
    assert texts(D.read_binary_documents(spark, str(tmp_path), "docx", D.docx_text)) == ["See LINK for more"]


def test_csv_with_very_many_commas(spark, tmp_path):
    long = ",".join(["x"] * 10_000)
    write(tmp_path, "a.csv", f'text,n\n"{long}",1\n' + "short,2\n" * 3000)
    write(tmp_path, "b.csv", f"a,b\n{long}\n")
    found = texts(D.read_csv_documents(spark, str(tmp_path)))
    assert len(found) == 3002 and found[0] == long and found[-1] == long.replace(",", " | ")


def test_rejected_files(spark, tmp_path):
    write(tmp_path, "broken.docx", "no archive")
    write(tmp_path, "a.pdf", "x")
    write(tmp_path, "_notes.txt", "hidden")
    write(tmp_path, ".more.csv", "hidden")
    write(tmp_path, "big.txt", "0123456789")
    write(tmp_path, "fine.txt", "fine")
    write(tmp_path, "other.bin", "no document")
    found = {os.path.basename(r.path): r.reason.split(":")[0] for r in D.rejected_files(spark, str(tmp_path), max_bytes=9).collect()}
    assert found == {
        "broken.docx": "too large", "a.pdf": "no parser", "_notes.txt": "hidden name", ".more.csv": "hidden name", "big.txt": "too large",
    }
    reasons = {os.path.basename(r.path): r.reason for r in D.rejected_files(spark, str(tmp_path), {"pdf": bytes.decode}).collect()}
    assert reasons["broken.docx"].startswith("broken: BadZipFile") and "a.pdf" not in reasons and "big.txt" not in reasons


def test_first_rows_read_the_first_files_only(spark, tmp_path):
    spark.range(1000).repartitionByRange(20, "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    part = first_files(df, 130)
    assert part.count() == 200 and sorted(r.id for r in part.collect()) == list(range(200))
    assert part.select(F.input_file_name()).distinct().count() == 4
    assert first_files(df, 5000).count() == 1000
    grouped = df.groupBy((F.col("id") % 3).alias("k")).count()
    assert first_files(grouped, 1).count() == 3
    sources = SourceRegistry()
    sources.add_parquet("t", str(tmp_path / "t"))
    assert [r.id for r in load_source(spark, sources, "t", max_rows=60).collect()] == list(range(60))
