"""Line-oriented sources: text lines, JSON lines and word lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.records import TEXT_KEYS, with_json_text
from quern.functions.text import strip
from quern.operators.ordering import TOP_K_ROWS
from quern.sources.paths import exists

LINES = "path string, block long, row long, value string"
LINE_ORDER = ("path", "block", "row")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with their place; a missing path has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], LINES)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def head_lines(lines: DataFrame, n: int, top_k_rows: int = TOP_K_ROWS) -> DataFrame:
    """The first ``n`` lines in file order.

    A large ``n`` is cut by counting: lines per file block, one row each, give every block's
    offset, and a line's offset in its block is the distance from the block's first line.
    """
    if n <= top_k_rows:
        return lines.orderBy(*LINE_ORDER).limit(n)
    blocks = lines.groupBy("path", "block").agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    needed = offsets.filter(F.col("_offset") < n).select("path", "block", "_first", "_offset")
    placed = lines.join(needed, ["path", "block"])
    return placed.filter(F.col("_offset") + F.col("row") - F.col("_first") < n).select(*lines.columns)


def read_lines(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Stripped non-blank lines; ``max_lines`` counts raw lines, blank ones included."""
    lines = raw_lines(spark, path)
    if max_lines is not None:
        lines = head_lines(lines, max_lines)
    return lines.select(*LINE_ORDER, strip(F.col("value")).alias("text")).filter(F.length("text") > 0)


def read_jsonl(
    spark: SparkSession,
    path: str,
    max_lines: int | None = None,
    keys: Sequence[str] = TEXT_KEYS,
    fallback: str = "first",
    multiline: bool = False,
) -> DataFrame:
    """The text of every JSON line that has one; with ``multiline`` a file is one JSON value."""
    if multiline and exists(spark, path):
        zero = F.lit(0).cast("long")
        lines = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("path"), zero.alias("block"), zero.alias("row"), "value"
        )
    else:
        lines = raw_lines(spark, path)
    if max_lines is not None:
        lines = head_lines(lines, max_lines)
    texts = with_json_text(lines, "value", keys, fallback).select(*LINE_ORDER, "text")
    return texts.filter(F.col("text").isNotNull())


def read_word_list(
    spark: SparkSession, path: str, comment: str = "none", lower: bool = False
) -> list[str]:
    """A small policy file as a list: stripped non-blank lines; a missing file is an empty list.

    Lines with ``#`` are kept (``none``), dropped where it is the very first character (``raw``)
    or the first after blanks (``stripped``).
    """
    if comment not in ("none", "raw", "stripped"):
        raise ValueError(f"unknown comment mode: {comment!r}")
    lines = raw_lines(spark, path)
    value = F.col("value")
    if comment != "none":
        lines = lines.filter(~(value if comment == "raw" else strip(value)).startswith("#"))
    word = strip(value)
    words = lines.orderBy(*LINE_ORDER).select((F.lower(word) if lower else word).alias("word"))
    return [row.word for row in words.collect() if row.word]
