"""Scalar text functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters Python's ``str.strip`` removes; none lies beyond the ideographic space U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Layouts other programs read.
CELL_SEPARATOR = " | "
EXCERPT_LENGTH = 300
FILE_TIMESTAMP = "yyyyMMdd_HHmmss"
LOG_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
PROMPT = "Answer the question using the context below:\n\n{context}\n\nQuestion: {query}"
CACHE_PREFIXES = {"model": "models", "dataset": "datasets", "space": "spaces", "media": "spaces"}
NAME_FAMILIES = (
    ("dolphin", ("dolphin", "^dphn_")),
    ("meta-llama", ("meta", "llama", "deepseek")),
    ("qwen", ("qwen",)),
    ("gemma", ("gemma",)),
)
OTHER_FAMILY = "generic"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace on both sides; looks at the edges only, never at the middle."""
    return F.trim(text, F.lit(WHITESPACE))


def strip_or_null(text: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def excerpt(text: Column, length: int = EXCERPT_LENGTH) -> Column:
    """The first characters with newlines shown as spaces."""
    return F.translate(F.substring(text, 1, length), "\n", " ")


def join_cells(cells: Sequence[Column], separator: str = CELL_SEPARATOR) -> Column:
    """Non-blank stripped cells joined in column order; null when every cell is blank."""
    return F.nullif(F.concat_ws(separator, *[strip_or_null(c) for c in cells]), F.lit(""))


def prompt(context: Column, question: Column) -> Column:
    """Fill the question template; ``concat`` keeps ``%`` and braces in the data untouched."""
    head, rest = PROMPT.split("{context}")
    middle, tail = rest.split("{query}")
    return F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))


def safe_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def cache_name(name: Column, kind: Column) -> Column:
    """Folder name in a download cache: a prefix by kind, ``models`` for unknown kinds."""
    prefix = F.lit(CACHE_PREFIXES["model"])
    for known, value in CACHE_PREFIXES.items():
        prefix = F.when(kind == known, F.lit(value)).otherwise(prefix)
    return F.concat(prefix, F.lit("--"), F.replace(name, F.lit("/"), F.lit("--")))


def name_family(
    name: Column,
    rules: Sequence[tuple[str, Sequence[str]]] = NAME_FAMILIES,
    otherwise: str = OTHER_FAMILY,
) -> Column:
    """First family with a marker in the lower-cased name; ``^`` ties a marker to the start."""
    lowered = F.lower(name)

    def has(marker: str) -> Column:
        return lowered.startswith(marker[1:]) if marker.startswith("^") else lowered.contains(marker)

    result = F.lit(otherwise)
    for family, markers in reversed(rules):
        hit = F.lit(False)
        for marker in markers:
            hit = hit | has(marker)
        result = F.when(hit, F.lit(family)).otherwise(result)
    return result


def file_timestamp(ts: Column) -> Column:
    return F.date_format(ts, FILE_TIMESTAMP)


def log_timestamp(ts: Column) -> Column:
    """UTC with milliseconds; ``ts`` must be shown in a UTC session."""
    return F.date_format(ts, LOG_TIMESTAMP)
