"""Analytics over file listings: sizes, move plans, format flags and snapshot states.

A listing has one row per file with the folder it was found under (``root``), its path relative
to that folder (``path``) and its ``length``; ``list_files`` makes one. For sizes of entries ``list_entries`` will do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.paths import entry_lengths, file_lengths

LISTING = "root string, category string, path string, length long"

# Format markers, and the file names that mark an unfinished download.
FORMAT_SUFFIXES = {"gguf": ".gguf", "ggml": ".ggml", "safetensors": ".safetensors"}
FORMAT_WORDS = {"gptq": "gptq"}
TOP_MARKERS = (".lock", ".incomplete")
NESTED_MARKERS = (".partial", ".incomplete", ".lock", ".tmp")
DOWNLOAD_MARKERS = (".partial", ".lock", ".tmp")


def list_entries(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """The entries of folders given as path -> category, each as one row of all its bytes.

    The file system sums up every entry, so hidden files count and empty entries are listed. The driver makes one
    call per entry of a root and holds their names only.
    """
    rows = [
        (root, category, name, length) for root, category in roots.items() for name, length in entry_lengths(spark, root)
    ]
    return spark.createDataFrame(rows, LISTING)


def list_files(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """All files below folders given as path -> category, hidden ones too; reads names and sizes, no content."""
    rows = [
        (root, category, name, length) for root, category in roots.items() for name, length in file_lengths(spark, root)
    ]
    return spark.createDataFrame(rows, LISTING)


def entry_of(path: Column) -> Column:
    """The first component of a relative path."""
    return F.substring_index(path, "/", 1)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _ends(name: Column, suffixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes])


def entry_sizes(files: DataFrame) -> DataFrame:
    """Bytes per visible top-level entry: root, category, entry, size_bytes."""
    entries = files.withColumn("entry", entry_of(F.col("path"))).filter(~F.col("entry").startswith("."))
    return entries.groupBy("root", "category", "entry").agg(F.sum("length").alias("size_bytes"))


def size_rollup(files: DataFrame) -> DataFrame:
    """Bytes by category and entry, by category, and in total (null keys stand for "all")."""
    entries = files.withColumn("entry", entry_of(F.col("path"))).filter(~F.col("entry").startswith("."))
    return entries.rollup("category", "entry").agg(F.sum("length").alias("size_bytes"))


def plan_moves(
    files: DataFrame, existing: DataFrame, destinations: Mapping[str, str], otherwise: str
) -> DataFrame:
    """What a move would do with every entry; nothing is moved.

    ``destinations`` maps categories to folders, ``existing`` lists taken ``destination`` paths.
    """
    target = F.lit(otherwise)
    for category, folder in destinations.items():
        target = F.when(F.col("category") == category, F.lit(folder)).otherwise(target)
    items = entry_sizes(files).select(
        F.concat_ws("/", "root", "entry").alias("source"),
        F.concat_ws("/", target, "entry").alias("destination"),
        "size_bytes",
        "category",
    )
    taken = existing.select("destination").distinct().withColumn("_taken", F.lit(True))
    action = F.when(F.col("_taken"), "skip-conflict").otherwise("move")
    return items.join(taken, "destination", "left").select(
        "source", "destination", "size_bytes", "category", action.alias("action")
    )


def format_flags(files: DataFrame) -> DataFrame:
    """Which weight formats occur below every root.

    A marker may be a folder's name as well, so all components of a path are looked at.
    """
    names = F.split(F.lower("path"), "/")
    flags = {kind: _any_name(names, suffix, True) for kind, suffix in FORMAT_SUFFIXES.items()}
    flags |= {kind: _any_name(names, word, False) for kind, word in FORMAT_WORDS.items()}
    return files.groupBy("root").agg(*[F.bool_or(flag).alias(kind) for kind, flag in flags.items()])


def _any_name(names: Column, marker: str, at_end: bool) -> Column:
    return F.exists(names, lambda n: n.endswith(marker) if at_end else n.contains(marker))


def snapshot_state(repos: DataFrame, listing: DataFrame) -> DataFrame:
    """``missing``, ``incomplete`` or ``complete`` for every repo, with its number of markers.

    ``listing`` has repo, path (relative to the repo's cache folder, folders included) and
    is_dir. A snapshot is complete when it has a folder under ``snapshots``, a non-empty
    ``refs``, and no marker: unfinished files, or folders without content.
    """
    path, name = F.col("path"), name_of(F.col("path"))
    parts = F.split("path", "/")
    depth = F.size(parts)
    top = listing.select(
        "repo",
        parts[0].alias("area"),
        F.when(depth > 1, parts[1]).alias("top"),
        (depth > 2).alias("nested"),
        F.col("is_dir"),
        name.alias("name"),
        path.alias("path"),
    )
    in_snapshots, in_downloads = F.col("area") == "snapshots", F.col("area") == "downloads"
    at_top = ~F.col("nested") & F.col("top").isNotNull()
    marker = (
        in_snapshots & at_top & F.col("name").endswith(".incomplete")
        | in_snapshots & at_top & F.col("name").endswith(".lock")
        | in_snapshots
        & F.col("nested")
        & ~F.col("top").endswith(".incomplete")
        & _ends(F.col("name"), NESTED_MARKERS)
        | in_downloads & F.col("top").isNotNull() & _ends(F.col("name"), DOWNLOAD_MARKERS)
    )
    entries = top.groupBy("repo", "area", "top").agg(
        F.bool_or(F.col("is_dir") & ~F.col("nested")).alias("is_folder"),
        F.bool_or("nested").alias("has_content"),
        F.count_if(marker).alias("markers"),
    )
    real = F.col("top").isNotNull()
    folder = in_snapshots & real & (F.col("is_folder") | F.col("has_content"))
    marked_name = F.col("top").endswith(".incomplete")
    empty = folder & ~F.col("has_content") & ~_ends(F.col("top"), TOP_MARKERS)
    states = entries.groupBy("repo").agg(
        F.bool_or(in_snapshots).alias("_exists"),
        F.sum(F.col("markers") + F.when(empty, 1).otherwise(0)).alias("markers"),
        F.bool_or(F.coalesce(folder & ~marked_name, F.lit(False))).alias("_folder"),
        F.bool_or((F.col("area") == "refs") & real).alias("_refs"),
    )
    state = (
        F.when(~F.coalesce("_exists", F.lit(False)), "missing")
        .when((F.col("markers") > 0) | ~F.col("_folder") | ~F.col("_refs"), "incomplete")
        .otherwise("complete")
    )
    markers = F.when(F.coalesce("_exists", F.lit(False)), F.col("markers")).otherwise(F.lit(0))
    return repos.select("repo").join(states, "repo", "left").select(
        "repo", state.alias("state"), markers.cast("long").alias("markers")
    )
