"""Regular-expression columns for phrase policies.

Patterns are written in Python's syntax and run in the JVM. ``(?iUd)`` makes the JVM's classes,
word boundaries, case folding, ``.`` and ``$`` behave as Python's do for text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iUd)"
CONTEXT_WINDOW = 120

# Inside a look-behind java.util.regex steps back by UTF-16 units unless the group itself names a
# supplementary character; naming one makes it count code points, as Python and Spark do.
_ANY = "[\\s\\S\U00010000]"


def quote(literal: str) -> str:
    """``literal`` as a Java regular expression, even if it holds the quote end mark itself."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def to_java(pattern: str) -> str:
    """Check a Python pattern and spell it for the JVM."""
    parsed = re.compile(pattern, re.IGNORECASE)
    if parsed.match(""):
        raise ValueError(f"pattern may match the empty string: {pattern!r}")
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]|\(\?P=", pattern):
        raise ValueError(f"pattern uses a back-reference: {pattern!r}")
    return re.sub(r"\(\?P<\w+>", "(", pattern).replace("\\Z", "\\z")


def _alternatives(pattern: str) -> bool:
    """Whether the pattern has a ``|`` outside all groups and classes."""
    depth, in_class, at = 0, False, 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            at += 1
        elif in_class:
            in_class = char != "]"
        elif char == "[":
            # A bracket right at the start of a class is a member of it.
            in_class = True
            at += len(re.match(r"\^?\]?", pattern[at + 1 :])[0])
        elif char == "|" and depth == 0:
            return True
        else:
            depth += (char == "(") - (char == ")")
        at += 1
    return False


_HEAD = re.compile(r"(\\b|\\[^a-zA-Z0-9]|[a-zA-Z0-9 _-])(?![*+?{])")


def _shared_heads(patterns: Sequence[str]) -> str:
    """One expression that matches where any of the patterns does.

    Patterns with the same first character or word boundary share it, and so on inside, so that
    a position in the text is tried against few branches instead of every pattern.
    """
    groups: dict[str, list[str]] = {}
    alone = []
    for pattern in dict.fromkeys(patterns):
        head = None if _alternatives(pattern) else _HEAD.match(pattern)
        if head:
            groups.setdefault(head[1].lower(), []).append(pattern[head.end() :])
        else:
            alone.append(f"(?:{pattern})" if pattern else "")
    shared = [
        head + (f"(?:{_shared_heads(rests)})" if len(rests) > 1 else rests[0])
        for head, rests in groups.items()
    ]
    return "|".join(shared + alone)


def any_pattern(patterns: Sequence[str]) -> str:
    return FLAGS + _shared_heads([to_java(p) for p in patterns])


def any_literal(phrases: Sequence[str]) -> str:
    """As a filter only: of several phrases at one place the shortest may be found."""
    return FLAGS + _shared_heads([re.escape(p) for p in phrases])


@functools.cache
def _lower_sources() -> dict[str, str]:
    """For each character, all characters whose lower case is that character."""
    table: dict[str, str] = {}
    for char in map(chr, range(0x20000)):
        low = char.lower()
        if low != char and len(low) == 1:
            table[low] = table.get(low, "") + char
    return table


def _keyword(word: str) -> str:
    """A case-sensitive expression for "the lower-cased text contains ``word`` here"."""
    classes = []
    for char in word:
        own = char if char.lower() == char else ""
        members = own + _lower_sources().get(char, "")
        if not members:
            return "(?!)"
        classes.append("[" + "".join(f"\\x{{{ord(m):X}}}" for m in members) + "]")
    return "".join(classes)


def counting_pattern(pattern: str, keywords: Sequence[str], window: int) -> tuple[str, int]:
    """An expression whose returned group is filled only for matches no keyword excuses.

    A match is found by a look-ahead, so the look-behind for keywords runs at matches only.
    Excused matches are consumed too, which keeps the later ones where a plain scan finds them.
    The match is taken again by a case-sensitive back-reference: it is the very same text, and
    the case-insensitive kind miscounts supplementary characters.
    """
    body = to_java(pattern)
    group = re.compile(pattern).groups + 2
    usable = [w for w in keywords if w and len(w) <= window]
    again = "(?-i:\\1)"
    if not usable:
        return f"{FLAGS}(?=({body}))({again})", group
    behind = "|".join(f"{_keyword(w)}{_ANY}{{0,{window - len(w)}}}" for w in usable)
    return f"{FLAGS}(?=({body}))(?:(?<!(?-i:{behind}))({again})|{again})", group


def counting_matches(
    text: Column,
    patterns: Sequence[str],
    keywords: Sequence[str] = (),
    window: int = CONTEXT_WINDOW,
    prefilter: bool = True,
) -> Column:
    """All counting matches, in pattern order and then by position; an empty array for none.

    With ``prefilter`` one alternation decides whether a row needs the per-pattern scans at all.
    """
    none = F.array().cast("array<string>")
    if not patterns or "" in keywords:
        return none
    found = []
    for pattern in patterns:
        expression, group = counting_pattern(pattern, keywords, window)
        hits = F.regexp_extract_all(text, F.lit(expression), F.lit(group))
        found.append(F.array_remove(hits, ""))
    if not prefilter:
        return F.concat(*found)
    return F.when(text.rlike(any_pattern(patterns)), F.concat(*found)).otherwise(none)


def severity(phrase: str) -> int:
    """Longer phrases weigh more, from 1 to 5."""
    return max(1, min(len(phrase) // 10, 5))


def literal_hits(text: Column, phrase: str) -> Column:
    """Every case-insensitive occurrence of ``phrase`` as (phrase, start, end, severity).

    Literal matches all have the phrase's own length, so the lengths of the gaps between them
    give the offsets.
    """
    size = len(phrase)
    gaps = F.transform(F.split(text, FLAGS + quote(phrase), -1), lambda gap: F.length(gap))
    ends = F.aggregate(
        F.slice(gaps, 1, F.size(gaps) - 1),
        F.array().cast("array<int>"),
        lambda done, gap: F.concat(
            done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + gap + F.lit(size))
        ),
    )
    return F.transform(
        ends,
        lambda end: F.struct(
            F.lit(phrase).alias("phrase"),
            (end - F.lit(size)).alias("start"),
            end.alias("end"),
            F.lit(severity(phrase)).alias("severity"),
        ),
    )


def literal_count(text: Column, phrase: str) -> Column:
    """How often ``phrase`` occurs, ignoring case."""
    return F.size(F.split(text, FLAGS + quote(phrase), -1)) - 1


def redact(text: Column, phrases: Sequence[str], token: str, mode: str = "sequential") -> Column:
    """Replace phrases, longest first.

    ``sequential`` replaces one phrase after the other, so a later short phrase may also match
    inside an inserted token; ``single_pass`` never looks at inserted tokens.
    """
    ordered = sorted((p for p in phrases if p), key=len, reverse=True)
    replacement = F.lit(re.sub(r"([\\$])", r"\\\1", token))
    if not ordered:
        return text
    if mode == "single_pass":
        longest_first = FLAGS + "|".join(quote(p) for p in ordered)
        return F.regexp_replace(text, F.lit(longest_first), replacement)
    if mode != "sequential":
        raise ValueError(f"unknown mode: {mode!r}")
    for phrase in ordered:
        text = F.regexp_replace(text, F.lit(FLAGS + quote(phrase)), replacement)
    return text
