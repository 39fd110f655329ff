"""Named sources with splits, source manifests and the catalog of stored datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.commits import is_unfinished, read_committed
from quern.operators.ordering import first_rows
from quern.sources.lines import read_word_list
from quern.sources.paths import first_files, folder_names

DEFAULT_SPLIT = "train"
# Folder prefixes of stored datasets, the preferred kind first.
DATASET_PREFIXES = {"sanitized": "sanitized_dataset_", "custom": "custom_dataset_"}


@dataclass(frozen=True)
class SourceSpec:
    name: str
    split: str = DEFAULT_SPLIT
    max_rows: int | None = None


@dataclass
class SourceRegistry:
    """Readers by source name and split, in the order splits were added."""

    readers: dict[str, dict[str, Callable[[SparkSession], DataFrame]]] = field(default_factory=dict)

    def add(self, name: str, reader: Callable[[SparkSession], DataFrame], split: str = DEFAULT_SPLIT) -> None:
        self.readers.setdefault(name, {})[split] = reader

    def add_parquet(self, name: str, path: str, split: str = DEFAULT_SPLIT) -> None:
        self.add(name, lambda spark: spark.read.parquet(path), split)


def load_source(
    spark: SparkSession,
    registry: SourceRegistry,
    name: str,
    split: str = DEFAULT_SPLIT,
    max_rows: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """A source's split, or its first split where it has no such one, cut to its first rows.

    ``order`` says what first means; without it the rows' stored order is taken.
    """
    splits = registry.readers[name]
    reader = splits.get(split) or next(iter(splits.values()))
    df = reader(spark)
    if max_rows is None:
        return df
    if order:
        return first_rows(df, max_rows, order)
    place = ("_path", "_block", "_row")
    placed = first_files(df, max_rows).select(
        "*",
        F.input_file_name().alias("_path"),
        F.input_file_block_start().alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return first_rows(placed, max_rows, place).drop(*place)


def source_names(spark: SparkSession, listed: str = "", path: str | None = None) -> list[str]:
    """Names from a comma list, then from a file with comments."""
    names = [part.strip() for part in listed.split(",") if part.strip()]
    return names + (read_word_list(spark, path, comment="stripped") if path else [])


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A stored dataset; an error where its write was not finished."""
    return read_committed(spark, path)


def stored_datasets(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of a root's folders: path, kind and created_at (what follows the kind's prefix).

    Folders of unfinished writes are left out, as are those of no known kind. The driver lists the datasets, not their files.
    """
    found = [
        (path, kind, path.rsplit("/", 1)[-1].removeprefix(prefix))
        for path in folder_names(spark, root)
        for kind, prefix in DATASET_PREFIXES.items()
        if path.rsplit("/", 1)[-1].startswith(prefix) and not is_unfinished(spark, path)
    ]
    return spark.createDataFrame(found, "path string, kind string, created_at string")


def latest_by_kind(
    catalog: DataFrame, kind: str = "kind", created: str = "created_at", path: str = "path"
) -> DataFrame:
    """The newest dataset of every kind; of equally new ones the last by path."""
    newest = F.max(F.struct(created, path))
    return catalog.groupBy(kind).agg(newest.alias("_new")).select(kind, f"_new.{path}", f"_new.{created}")


def dataset_kind(path: Column) -> Column:
    """The kind a stored dataset's folder name tells; null for other folders."""
    name = F.substring_index(path, "/", -1)
    kind = F.lit(None).cast("string")
    for known, prefix in DATASET_PREFIXES.items():
        kind = F.when(name.startswith(prefix), F.lit(known)).otherwise(kind)
    return kind


def preferred_dataset(catalog: DataFrame) -> DataFrame:
    """The newest sanitized dataset, else the newest custom one; at most one row."""
    ranks = {kind: i for i, kind in enumerate(DATASET_PREFIXES)}
    rank = F.lit(None).cast("int")
    for kind, i in ranks.items():
        rank = F.when(F.col("kind") == kind, F.lit(i)).otherwise(rank)
    newest = latest_by_kind(catalog).withColumn("_rank", rank)
    return newest.filter(F.col("_rank").isNotNull()).orderBy("_rank").limit(1).drop("_rank")
