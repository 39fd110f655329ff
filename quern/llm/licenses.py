"""License scans: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser reads expressions.

Two views of a text in lower case (A-Z) are scanned. Notices are phrases of whole words, so they are looked for
in the text's words joined by single spaces. Identifier tags are looked for in the raw text; what follows one
up to the end of the line is an expression of licence ids with and, or, with and parentheses, which the parser
turns into its ids and its value.

A text is one row of an Arrow batch; the automata are built once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import LOWER, UPPER, unused

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, LOWER)

# Phrases whose places are counted, and the label of each.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices: they add labels, no counts.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the mit license": "mit",
    "mit licensed": "mit",
    "apache license 2 0": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
# Ids of expressions by their beginning, the longest first, and their labels.
IDS = {
    "mit": "mit",
    "apache-2": "apache-2",
    "gpl-2": "gpl-2",
    "gpl-3": "gpl-3",
    "gpl": "gpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "mpl": "mpl",
    "bsd": "bsd",
    "epl": "epl",
    "isc": "isc",
    "unlicense": "unlicense",
    "cc0": "cc0",
    "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa",
    "cc-by-nd": "cc-by-nd",
    "cc-by": "cc-by",
    "proprietary": "proprietary",
}
# How freely a text of the label may be used, from 0 to 1; others count as UNKNOWN.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 0.9,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "gpl-2": 0.3, "gpl-3": 0.3, "agpl": 0.2,
    "cc-by-nd": 0.1, "cc-by-nc": 0.1, "proprietary": 0.0,
}
UNKNOWN = 0.5
_PRIORITY = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()\n]|[a-z0-9][a-z0-9.+-]*")


def label_of(name: str) -> str:
    """The label of an expression's id; ids without one are their own label."""
    for beginning in sorted(IDS, key=len, reverse=True):
        if name == beginning or name.startswith((beginning + "-", beginning + ".", beginning + "+")):
            return IDS[beginning]
    return name


def postfix(text: str, at: int = 0) -> list[str] | None:
    """The expression in lower case that begins at ``at``, in postfix order by the shunting-yard method.

    It ends with its line or before what cannot belong to it, such as the end of a comment; None if there is none.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False
    depth = 0
    for match in _TOKEN.finditer(text, at):
        token = match.group()
        if token == "\n":
            break
        if token in _PRIORITY:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _PRIORITY[stack[-1]] >= _PRIORITY[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if operand:
                break
            out.append(token)
            operand = True
    if not operand or depth:
        return None
    return out + stack[::-1]


def evaluate(order: list[str]) -> tuple[set[str], float]:
    """(labels, freedom): with ``or`` the freer side may be chosen, with ``and`` both bind, an exception frees none."""
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token not in _PRIORITY:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
            continue
        (b, free_b), (a, free_a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((a, free_a))
        else:
            stack.append((a | b, max(free_a, free_b) if token == "or" else min(free_a, free_b)))
    return stack.pop()


@dataclass(frozen=True)
class Found:
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: tuple[str, ...]
    labels: tuple[str, ...]
    score: float


class Scanner:
    """The automata of one task."""

    def __init__(self):
        self.phrases = ahocorasick.Automaton()
        for phrase, label in NOTICES.items():
            self.phrases.add_word(f" {phrase} ", (False, len(phrase) + 1, label))
        for phrase, label in BASE.items():
            self.phrases.add_word(f" {phrase} ", (True, len(phrase) + 1, label))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.tags.make_automaton()

    def scan(self, text: str | None) -> Found:
        lowered = (text or "").translate(_LOWER)
        words = WORD.findall(lowered)
        base: set[str] = set()
        labels: set[str] = set()
        frees: list[float] = []
        n_base, first, last = 0, None, None
        joined = f" {' '.join(words)} "
        counted, at = 0, 0
        places = []
        for end, (is_base, length, label) in self.phrases.iter(joined):
            labels.add(label)
            if is_base:
                base.add(label)
                places.append(end - length)
        for start in sorted(places):
            counted += joined.count(" ", at, start)
            at = start
            n_base += 1
            first = counted if first is None else first
            last = counted
        for end, _ in self.tags.iter(lowered):
            order = postfix(lowered, end + 1)
            if order:
                names, free = evaluate(order)
                labels |= names
                frees.append(free)
        labels |= base
        if frees:
            score = min(frees)
        else:
            score = min((FREEDOM.get(x, UNKNOWN) for x in labels), default=UNKNOWN)
        return Found(len(words), n_base, first, last, tuple(sorted(base)), tuple(sorted(labels)), score)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` except the text's, then n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``score`` says how freely the text may be used: the least of its expressions' values, without expressions the
    least of its labels, without labels 0.5. A null text counts as empty. New columns that clash with
    given ones get an underscore before their names.
    """
    kept = [c for c in docs.columns if c != text]
    kinds = {
        "n_words": ("long", pa.int64()),
        "n_base": ("long", pa.int64()),
        "first_word": ("long", pa.int64()),
        "last_word": ("long", pa.int64()),
        "base_labels": ("string", pa.string()),
        "labels": ("string", pa.string()),
        "score": ("double", pa.float64()),
    }
    names = {c: unused(docs, c) for c in kinds}
    schema = docs.select(*kept).schema
    for c, (kind, _) in kinds.items():
        schema = schema.add(names[c], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            found = [scanner.scan(value.as_py()) for value in batch.column(len(kept))]
            columns = {c: [getattr(f, c) for f in found] for c in kinds}
            for c in ("base_labels", "labels"):
                columns[c] = [",".join(x) for x in columns[c]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *(pa.array(columns[c], kind) for c, (_, kind) in kinds.items())],
                names=[*kept, *names.values()],
            )

    return docs.select(*kept, text).mapInArrow(run, schema)
