"""Writers. Each writes a folder of part files and fails where the target exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.commits import write_committed

# Layout of the quarantine report.
QUARANTINE_COLUMNS = ("index", "matched_phrases", "excerpt")
PHRASE_SEPARATOR = "|"


def write_dataset(df: DataFrame, path: str) -> int:
    """Parquet with a commit record; returns the number of rows."""
    return write_committed(df, path)


def quarantine_rows(flagged: DataFrame, seq: str = "seq") -> DataFrame:
    return flagged.select(
        F.col(seq).alias("index"),
        F.array_join("phrases", PHRASE_SEPARATOR).alias("matched_phrases"),
        "excerpt",
    )


def _write_csv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_quarantine(flagged: DataFrame, path: str, seq: str = "seq") -> None:
    _write_csv(quarantine_rows(flagged, seq), path, "errorifexists")


def write_jsonl(df: DataFrame, path: str, text: str = "text") -> None:
    """One ``{"text": ...}`` per line, in the rows' order over the part files."""
    df.select(F.col(text).alias("text")).write.json(path)


def write_metadata(row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row table as JSON."""
    row.coalesce(1).write.mode(mode).json(path)


def append_run_log(rows: DataFrame, path: str) -> None:
    _write_csv(rows, path, "append")


def write_vectors(docs: DataFrame, path: str, columns: Sequence[str] = ("doc_id", "text", "embedding")) -> None:
    docs.select(*columns).write.parquet(path)
