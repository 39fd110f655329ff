"""Phrase policies: context-aware flagging, blocklists, banned words, scans and redaction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import phrases as P
from quern.functions import text as T
from quern.functions.automaton import Automaton

# Up to about this many words a byte search per word beats one pass of an automaton (measured).
CONTAINS_LIMIT = 8
# Bytes of words in one automaton; its tables take some twenty times as much.
PART_BYTES = 4 << 20


def normalise(df: DataFrame, text: str = "text") -> DataFrame:
    """Strip the text and drop rows without any."""
    return df.withColumn(text, T.strip(F.col(text))).filter(F.length(text) > 0)


def flag_phrases(
    df: DataFrame,
    patterns: Sequence[str],
    context_keywords: Sequence[str] = (),
    window: int = P.CONTEXT_WINDOW,
    text: str = "text",
) -> DataFrame:
    """Add ``phrases`` (all counting matches) and ``excerpt``; null or blank text has no matches."""
    return df.withColumns(
        {
            "phrases": P.counting_matches(
                F.coalesce(F.col(text), F.lit("")), patterns, context_keywords, window
            ),
            "excerpt": T.excerpt(F.col(text)),
        }
    )


def raw_hits(df: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """Rows in which some pattern occurs, excused or not; one pass of one expression."""
    return df.filter(F.col(text).rlike(P.any_pattern(patterns)))


def flagged(
    df: DataFrame,
    patterns: Sequence[str],
    context_keywords: Sequence[str] = (),
    window: int = P.CONTEXT_WINDOW,
    text: str = "text",
) -> DataFrame:
    """Only the flagged rows.

    The alternation filter comes first, so the filter on ``phrases``, for which the optimizer
    evaluates the pattern scans a second time, meets rows with a raw match only.
    """
    if not patterns:
        return flag_phrases(df, patterns, text=text).filter(F.lit(False))
    raw = raw_hits(df, patterns, text)
    found = P.counting_matches(F.col(text), patterns, context_keywords, window, prefilter=False)
    return raw.withColumns({"phrases": found, "excerpt": T.excerpt(F.col(text))}).filter(
        F.size("phrases") > 0
    )


def retained(
    df: DataFrame,
    patterns: Sequence[str],
    context_keywords: Sequence[str] = (),
    window: int = P.CONTEXT_WINDOW,
    text: str = "text",
) -> DataFrame:
    """The complement of ``flagged``, with the input's own columns."""
    found = P.counting_matches(F.coalesce(F.col(text), F.lit("")), patterns, context_keywords, window)
    return df.filter(F.size(found) == 0)


def split_flagged(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flagged, retained) of a table that already carries ``phrases``."""
    hit = F.size("phrases") > 0
    return annotated.filter(hit), annotated.filter(~hit).drop("phrases", "excerpt")


def flag_counts(annotated: DataFrame) -> DataFrame:
    """Document, flagged and retained counts in one aggregate."""
    hit = F.size("phrases") > 0
    return annotated.agg(
        F.count("*").alias("documents"),
        F.count_if(hit).alias("flagged"),
        F.count_if(~hit).alias("retained"),
    )


def has_phrase(df: DataFrame, phrases: Sequence[str], text: str = "text") -> DataFrame:
    """Add ``blocked``: whether any phrase occurs, ignoring case."""
    used = [p for p in phrases if p]
    hit = F.col(text).rlike(P.any_literal(used)) if used else F.lit(False)
    return df.withColumn("blocked", F.coalesce(hit, F.lit(False)))


def scan_phrases(df: DataFrame, phrases: Sequence[str], text: str = "text") -> DataFrame:
    """One row per occurrence: the input's other columns, phrase, start, end and severity."""
    used = [p for p in phrases if p]
    others = [c for c in df.columns if c != text]
    if not used:
        empty = P.literal_hits(F.lit(""), "-")
        return df.select(*others, F.inline(empty))
    # A row without any occurrence never reaches the array work.
    rows = df.filter(F.col(text).rlike(P.any_literal(used)))
    hits = F.concat(*[P.literal_hits(F.col(text), p) for p in used])
    return rows.select(*others, F.inline(hits))


def phrase_summary(df: DataFrame, phrases: Sequence[str], text: str = "text") -> DataFrame:
    """Matches and severity per phrase that occurs; counts the gaps between matches and builds no offsets."""
    used = [p for p in dict.fromkeys(phrases) if p]
    if not used:
        return df.select(F.lit("").alias("phrase"), F.lit(0).cast("long").alias("matches"), F.lit(0).alias("severity")).limit(0)
    rows = df.filter(F.col(text).rlike(P.any_literal(used)))
    counts = rows.agg(*[F.sum(P.literal_count(F.col(text), p)).alias(f"n{i}") for i, p in enumerate(used)])
    listed = F.array(
        *[F.struct(F.lit(p).alias("phrase"), F.col(f"n{i}").cast("long").alias("matches"), F.lit(P.severity(p)).alias("severity")) for i, p in enumerate(used)]
    )
    return counts.select(F.inline(listed)).filter("matches > 0")


def redact(
    df: DataFrame,
    phrases: Sequence[str],
    token: str = "[REDACTED]",
    mode: str = "sequential",
    text: str = "text",
) -> DataFrame:
    return df.withColumn(text, P.redact(F.col(text), phrases, token, mode))


def _contains_any(df: DataFrame, words: Sequence[str]) -> Callable[[Column], Column]:
    """For word lists too long for a search per word: automata built here once, sent to the tasks once.

    A list is cut into parts of at most ``PART_BYTES``, each of which a text is held against.
    """
    parts, size = [[]], 0
    for word in words:
        size += len(word.encode())
        if size > PART_BYTES and parts[-1]:
            parts.append([])
            size = len(word.encode())
        parts[-1].append(word)
    sent = [df.sparkSession.sparkContext.broadcast(Automaton(part)) for part in parts]

    @F.arrow_udf("boolean")
    def contains_any(texts: pa.Array) -> pa.Array:
        found = sent[0].value.found_in(texts)
        for automaton in sent[1:]:
            found |= automaton.value.found_in(texts)
        return pa.array(found)

    return contains_any


def filter_banned(
    df: DataFrame,
    words: Sequence[str],
    text: str = "text",
    contains_limit: int = CONTAINS_LIMIT,
) -> DataFrame:
    """Keep rows whose lower-cased text contains no banned word anywhere; null text is kept."""
    used = list(dict.fromkeys(words))
    if not used:
        return df
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    if "" in used:
        return df.filter(F.lit(False))
    if len(used) > contains_limit:
        return df.filter(~_contains_any(df, used)(lowered))
    hit = F.lit(False)
    for word in used:
        hit = hit | lowered.contains(word)
    return df.filter(~hit)
