"""Documents from folders of CSV, text and packed files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import islice
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import strip
from quern.schemas import DOCUMENTS
from quern.sources.csv_ranges import csv_records
from quern.sources.paths import file_names

# One row cannot hold more; larger files are listed by ``rejected_files``.
MAX_FILE_BYTES = 2_000_000_000
# So many of the scan's tasks at most become one where text files are read.
TASKS_IN_ONE = 16


def _glob(suffix: str) -> str:
    """A file name filter for a suffix in either case."""
    return "*." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _documents(df: DataFrame, text: Column, rank: int = 0) -> DataFrame:
    """Normalised documents; ``df`` has path, block and row."""
    rows = df.select(F.lit(rank).alias("format_rank"), "path", "block", "row", strip(text).alias("text"))
    return rows.filter(F.length("text") > 0)


def _packed(files: DataFrame) -> DataFrame:
    """``files`` in fewer tasks: Spark counts a small file as 4 MB, so many of them make tasks of a few files each."""
    tasks = files.rdd.getNumPartitions()
    fewer = max(-(-tasks // TASKS_IN_ONE), 4 * files.sparkSession.sparkContext.defaultParallelism)
    return files.coalesce(fewer) if fewer < tasks else files


def oversized(
    spark: SparkSession, path: str, suffixes: Sequence[str], max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """Files too large for one row, which the whole-file readers leave out: path, length."""
    listing = [
        spark.read.format("binaryFile").option("pathGlobFilter", _glob(s)).load(path).select("path", "length")
        for s in suffixes
    ]
    return reduce(DataFrame.unionByName, listing).filter(F.col("length") > max_bytes)


def read_text_documents(
    spark: SparkSession, path: str, rank: int = 0, max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """One document per text file."""
    files = _packed(spark.read.text(path, wholetext=True, pathGlobFilter=_glob("txt")))
    placed = files.filter(F.col("_metadata.file_size") <= max_bytes).select(
        F.col("_metadata.file_path").alias("path"),
        F.lit(0).cast("long").alias("block"),
        F.lit(0).cast("long").alias("row"),
        "value",
    )
    return _documents(placed, F.col("value"), rank)


def read_csv_documents(spark: SparkSession, path: str, rank: int = 0) -> DataFrame:
    """One document per CSV record: the cell of its text column, or all its cells where the file has none.

    The first line is the header; a blank one means that the file has none. A byte-order mark is part of the first
    header. Of a repeated header the last cell counts, and cells beyond the header are joined like others. Files of any
    size are read in ranges by many tasks, though cells may hold line ends; a first pass over them runs at once.
    """
    return _readable(csv_records(spark, path, _glob("csv")), rank)


# Fixed value: the namespace of word-processor markup.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def docx_text(content: bytes) -> str:
    """The body's own paragraphs, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    lines = []
    for paragraph in body.findall(f"{_WORD}p"):
        pieces = []
        for child in paragraph:
            runs = child.findall(f"{_WORD}r") if child.tag == f"{_WORD}hyperlink" else [child]
            for node in (node for run in runs if run.tag == f"{_WORD}r" for node in run):
                kind = node.tag.removeprefix(_WORD)
                pieces.append(node.text or "" if kind == "t" else _BREAKS.get(kind, ""))
        lines.append("".join(pieces))
    return "\n".join(lines)


def epub_text(content: bytes) -> str:
    """The bodies of all pages in the order of the package list, markup kept."""
    bodies = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        package = container.find(".//{*}rootfile").attrib["full-path"]
        for item in ElementTree.fromstring(archive.read(package)).findall(".//{*}manifest/{*}item"):
            if item.attrib.get("media-type") != "application/xhtml+xml":
                continue
            name = posixpath.normpath(
                posixpath.join(posixpath.dirname(package), unquote(item.attrib["href"]))
            )
            page = archive.read(name).decode("utf-8")
            body = re.search(r"<body\b[^>]*>(.*)</body\s*>", page, re.DOTALL | re.IGNORECASE)
            bodies.append(body.group(1) if body else "")
    return "".join(bodies)


RECORDS_AT_ONCE = 1000


def _parsed(
    spark: SparkSession, path: str, suffix: str, records: Callable[[bytes], Iterable[str | None]], max_bytes: int
) -> DataFrame:
    """path, block, row, value and error: a file's records in order, and what ended them early."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _glob(suffix))
        .load(path)
        .filter(F.col("length") <= max_bytes)
        .select("path", "content")
    )

    def rows_of(name: str, row: int, values: list[str | None], error: str | None) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * n, pa.string()),
                pa.array(range(row, row + n), pa.int64()),
                pa.array(values, pa.string()),
                pa.array([error] * n, pa.string()),
            ],
            names=["path", "row", "value", "error"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                found = iter(records(content.as_py()))
                row, error, more = 0, None, True
                while more:
                    values: list[str | None] = []
                    try:
                        values.extend(islice(found, RECORDS_AT_ONCE))
                    except Exception as problem:  # noqa: BLE001 - any broken file is reported
                        error = f"{type(problem).__name__}: {problem}"
                    more = len(values) == RECORDS_AT_ONCE
                    yield rows_of(name.as_py(), row, values, None)
                    row += len(values)
                if error:
                    yield rows_of(name.as_py(), row, [None], error)

    parsed = files.mapInArrow(run, "path string, row long, value string, error string")
    return parsed.withColumn("block", F.lit(0).cast("long"))


def _readable(parsed: DataFrame, rank: int) -> DataFrame:
    rows = parsed.filter(F.col("error").isNull())
    return _documents(rows.select("path", "block", "row", "value"), F.col("value"), rank)


def _whole(parse: Callable[[bytes], str]) -> Callable[[bytes], Iterator[str]]:
    def records(content: bytes) -> Iterator[str]:
        yield parse(content)

    return records


def read_binary_documents(
    spark: SparkSession,
    path: str,
    suffix: str,
    parse: Callable[[bytes], str],
    rank: int = 0,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """One document per file, by a parser; ``rejected_files`` lists what it cannot read."""
    return _readable(_parsed(spark, path, suffix, _whole(parse), max_bytes), rank)


# Formats in the order their documents follow each other; those without a parser here take one
# from the caller.
FORMATS = ("csv", "txt", "pdf", "epub", "mobi", "doc", "docx")
PARSERS: dict[str, Callable[[bytes], str]] = {"epub": epub_text, "docx": docx_text}


def collect_documents(
    spark: SparkSession,
    path: str,
    parsers: dict[str, Callable[[bytes], str]] | None = None,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """All documents of a folder; ``schemas.FILE_ORDER`` gives their order."""
    known = PARSERS | (parsers or {})
    parts = []
    for rank, suffix in enumerate(FORMATS):
        if suffix == "csv":
            parts.append(read_csv_documents(spark, path, rank))
        elif suffix == "txt":
            parts.append(read_text_documents(spark, path, rank, max_bytes))
        elif suffix in known:
            parts.append(read_binary_documents(spark, path, suffix, known[suffix], rank, max_bytes))
    return reduce(DataFrame.unionByName, parts).select(*DOCUMENTS.names)


def rejected_files(
    spark: SparkSession,
    path: str,
    parsers: dict[str, Callable[[bytes], str]] | None = None,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Files of a folder that ``collect_documents`` leaves out: path, reason.

    They are too large for one row, of a format without a parser, broken, or have a hidden name,
    which Spark's readers skip. Parses the packed files and CSV files for their errors.
    """
    known = PARSERS | (parsers or {})
    hidden = [
        (name, "hidden name")
        for name in file_names(spark, path)
        if posixpath.basename(name)[0] in "._" and name.lower().rpartition(".")[2] in FORMATS
    ]
    parts = [spark.createDataFrame(hidden, "path string, reason string")]
    large = oversized(spark, path, [s for s in FORMATS if s != "csv"], max_bytes)
    parts.append(large.select("path", F.concat(F.lit("too large: "), F.col("length").cast("string")).alias("reason")))
    for suffix in FORMATS:
        if suffix == "txt":
            continue
        if suffix == "csv" or suffix in known:
            records = csv_records(spark, path, _glob("csv")) if suffix == "csv" else _parsed(spark, path, suffix, _whole(known[suffix]), max_bytes)
            parsed = records.filter(F.col("error").isNotNull())
            parts.append(parsed.select("path", F.concat(F.lit("broken: "), "error").alias("reason")))
        else:
            files = spark.read.format("binaryFile").option("pathGlobFilter", _glob(suffix)).load(path)
            fits = files.filter(F.col("length") <= max_bytes)
            parts.append(fits.select("path", F.lit("no parser").alias("reason")))
    return reduce(DataFrame.unionByName, parts)
