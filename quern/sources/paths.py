"""Small path checks through the session's own file systems."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    if not path:
        return False
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def is_directory(spark: SparkSession, path: str) -> bool:
    if not exists(spark, path):
        return False
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(hadoop_path).isDirectory()


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files in a folder, hidden ones too."""
    return [str(status.getPath()) for status in _children(spark, folder) if status.isFile()]


def entry_lengths(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of every entry of a folder, hidden files below it counted; one call per entry."""
    fs = _file_system(spark, folder)
    return [
        (status.getPath().getName(), fs.getContentSummary(status.getPath()).getLength()) for status in _children(spark, folder)
    ]


def rename_file(spark: SparkSession, name: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not _file_system(spark, name).rename(path(name), path(target)):
        raise OSError(f"{name} cannot be renamed to {target}")


def read_text(spark: SparkSession, name: str) -> str:
    """A small file's text."""
    stream = _file_system(spark, name).open(spark._jvm.org.apache.hadoop.fs.Path(name))
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, name: str, text: str) -> None:
    """Writes a small file beside its place and moves it there, so that it is never seen in part."""
    path, part = spark._jvm.org.apache.hadoop.fs.Path, f"{name}.part"
    stream = _file_system(spark, name).create(path(part), True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    rename_file(spark, part, name)


def delete(spark: SparkSession, name: str) -> None:
    """Removes a file or folder, if it is there."""
    _file_system(spark, name).delete(spark._jvm.org.apache.hadoop.fs.Path(name), True)


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all folders in a folder."""
    return [str(status.getPath()) for status in _children(spark, folder) if status.isDirectory()]


def file_lengths(spark: SparkSession, folder: str) -> Iterator[tuple[str, int]]:
    """(path relative to the folder, bytes) of every file below it, hidden ones too."""
    found = _file_system(spark, folder).listFiles(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
    base = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    while found.hasNext():
        status = found.next()
        yield status.getPath().toUri().getPath().removeprefix(base), status.getLen()


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str):
    return _file_system(spark, folder).listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))


def first_files(df: DataFrame, n: int) -> DataFrame:
    """A scan of files cut to its first files, in order of their names, that hold ``n`` rows.

    Four times as many files are tried each time, and Parquet files are counted by their footers. Other tables, and
    scans of files whose names may be spelled in two ways, stay whole.
    """
    # A local file's name has one slash in the rows' metadata.
    names = sorted({re.sub("^file:/+", "file:/", name) for name in df.inputFiles()})
    if len(names) < 2 or not all(re.fullmatch(r"[\w:/.=-]+", name, re.ASCII) for name in names):
        return df
    path = F.col("_metadata.file_path")
    many = 1
    while many < len(names):
        try:
            part = df.filter(path.isin(names[:many]))
        except AnalysisException:  # not a plain scan
            return df
        if part.limit(n).count() >= n:
            return part
        many *= 4
    return df
