"""Prepare a mixed text file from named and stored sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import sinks
from quern.functions.records import row_text
from quern.operators.mixing import MAX_PER_SOURCE, concat_sources, order_and_cap
from quern.sources.lines import LINE_ORDER, read_jsonl, read_lines
from quern.sources.paths import exists, is_directory
from quern.sources.registry import SourceRegistry, SourceSpec, load_source


def _placed(df: DataFrame, text: Column) -> DataFrame:
    return df.select(
        F.input_file_name().alias("path"),
        F.input_file_block_start().alias("block"),
        F.monotonically_increasing_id().alias("row"),
        text.alias("text"),
    ).filter(F.col("text").isNotNull())


def read_stored(spark: SparkSession, path: str, max_examples: int) -> DataFrame:
    """A local source: a stored dataset folder, JSON lines, or text lines; empty where missing."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("jsonl", "json"):
        return read_jsonl(spark, path, max_examples)
    if exists(spark, path) and is_directory(spark, path):
        registry = SourceRegistry()
        registry.add_parquet(path, path)
        df = load_source(spark, registry, path, max_rows=max_examples)
        return _placed(df, row_text(df, fallback="first"))
    return read_lines(spark, path, max_examples)


def prepare_mixture(
    spark: SparkSession,
    specs: Sequence[SourceSpec],
    registry: SourceRegistry,
    sanitized: str | None = None,
    custom: str | None = None,
    max_examples: int = MAX_PER_SOURCE,
    shuffle: bool = False,
    seed: int = 42,
    output: str | None = None,
) -> DataFrame:
    """The first examples of every source, then the sanitized and the custom one, as ``text``.

    The cap on the whole is the per-source cap times the number of sources asked for. With
    ``output`` the rows are also written as JSON lines.
    """
    parts = []
    for spec in specs:
        df = load_source(spark, registry, spec.name, spec.split, spec.max_rows or max_examples)
        parts.append(_placed(df, row_text(df)))
    local = [path for path in (sanitized, custom) if path]
    parts += [read_stored(spark, path, max_examples) for path in local]
    cap = max_examples * max(1, len(parts))
    mixed = order_and_cap(concat_sources(parts or [read_lines(spark, "")]), cap, shuffle, seed, LINE_ORDER)
    if output is not None:
        sinks.write_jsonl(mixed, output)
    return mixed.select("text")
