"""Periodic runs of words by online dyadic square catching.

A run is a stretch of words of smallest period q, at least ``LEAST`` words and ``POWER`` periods long, that no
neighbouring word extends. Words are what stands between ASCII white space.

Words are appended to a text's catchers. On each level every completed block of L words (L a power of two, blocks
begin at multiples of L) is a catcher for the periods from L to 2L - 1: a run of such a period equals itself, one
period on, over at least 2L - 1 words, so it holds a whole block and its copy. With each appended word the last L
words are compared, by hash, with the one block of a level that lies one of these distances back. Equal ones are a
caught square; it is compared word by word to the left, and to the right as words are appended, until a word
differs. Squares of one period that overlap are one run, and a square inside a run whose period divides its own is
that run once more. A level begins when a run of its periods fits, and keeps the last 6L hashes only, so that all
levels together keep less than four for each word.

Words can be appended singly or many at once, with the same runs; many at once are compared as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.text_bytes import U64, mix

LEAST, POWER = 24, 3
# The smallest blocks; they catch all shorter periods too, as a run has LEAST words at least.
SMALLEST = 8
_ODD = U64(0x9E3779B97F4A7C15)
# Hashes that a level keeps, in blocks: three for its periods, and all until the next level begins.
KEPT = 2 * POWER
# So many words of a text are appended at once.
APPEND = 1 << 16

Run = tuple[int, int, int]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _ODD + right)


def _is_long(length: int, period: int) -> bool:
    return length >= max(LEAST, POWER * period)


class _Level:
    """Hashes of the last windows of ``size`` words, and the blocks among them."""

    def __init__(self, size: int):
        self.size = size
        self.periods = (1 if size == SMALLEST else size, 2 * size - 1)
        self.base = 0
        self.hashes = np.zeros(0, U64)

    def add(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, period) of the squares that ``new`` windows catch."""
        first = self.base + len(self.hashes)
        self.hashes = np.concatenate([self.hashes, new]) if len(self.hashes) else new
        low, high = self.periods
        starts = np.arange(first, first + len(new))
        blocks, periods = [], []
        # The last block at least ``low`` words back, and for the smallest blocks the one before it.
        last = (starts - low) // self.size * self.size
        for back in range(0, high - low + 1, self.size):
            block = last - back
            at = np.flatnonzero((block >= self.base) & (starts - block <= high))
            at = at[new[at] == self.hashes[block[at] - self.base]]
            blocks.append(block[at])
            periods.append(starts[at] - block[at])
        return np.concatenate(blocks), np.concatenate(periods)

    def trim(self) -> None:
        over = len(self.hashes) - KEPT * self.size
        if over > 0:
            self.hashes, self.base = self.hashes[over:], self.base + over


class Catchers:
    """The runs of a growing sequence of word numbers."""

    def __init__(self) -> None:
        self._words = np.zeros(0, np.int64)
        self._few: list[np.ndarray] = [np.zeros(0, U64)] * 3
        self._levels = [_Level(SMALLEST)]
        self._open: dict[int, tuple[int, int]] = {}
        self._closed: dict[int, list[tuple[int, int]]] = {}

    def append(self, words: np.ndarray) -> None:
        """``words`` at the end, as numbers that are equal for equal words."""
        if not len(words):
            return
        self._words = np.concatenate([self._words, words]) if len(self._words) else np.asarray(words, np.int64)
        self._grow()
        windows = mix(words.astype(U64) + U64(1))
        for i in range(3):  # windows of 1, 2 and 4 words, of which the last few are kept
            kept = np.concatenate([self._few[i], windows])
            span = 1 << i
            windows = _joined(kept[:-span], kept[span:]) if len(kept) > span else kept[:0]
            self._few[i] = kept[-span:]
        level = 0
        while len(windows):
            here = self._levels[level]
            had = len(here.hashes)
            self._catch(*here.add(windows), here.size)
            level += 1
            if level == len(self._levels):
                if len(self._words) < 2 * POWER * here.size:
                    break
                self._levels.append(_Level(2 * here.size))
                had = 0
            # A window of twice the words for each window that now has another one behind it.
            first, size = max(had - here.size, 0), here.size
            windows = _joined(here.hashes[first : max(len(here.hashes) - size, first)], here.hashes[first + size :])
            here.trim()

    def _grow(self) -> None:
        """Compares what was appended with what stands one period before it."""
        for period, (start, end) in list(self._open.items()):
            self._open[period] = (start, self._equal_until(end, period))
            self._close(period)

    def _close(self, period: int) -> None:
        """Ends the stretch of ``period`` if a word differs."""
        start, end = self._open[period]
        if end + period < len(self._words):
            del self._open[period]
            self._closed.setdefault(period, []).append((start, end))

    def _equal_until(self, at: int, period: int) -> int:
        """The first place from ``at`` on whose word differs from the one a period later, or that has none."""
        words, step = self._words, 64
        while True:
            here = words[at + period : at + period + step]
            differ = words[at : at + len(here)] != here
            if differ.any():
                return at + int(differ.argmax())
            at += len(here)
            if len(here) < step:
                return at
            step *= 4

    def _equal_since(self, at: int, period: int) -> int:
        """The first place before ``at`` from which on all words equal those a period later."""
        words, step = self._words, 64
        while at > 0:
            begin = max(0, at - step)
            differ = words[begin:at] != words[begin + period : at + period]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = begin, step * 4
        return at

    def _long(self) -> Iterator[Run]:
        """(period, start, end) of the stretches that are long enough for a run."""
        for period, stretches in [*((p, [s]) for p, s in self._open.items()), *self._closed.items()]:
            for start, end in stretches:
                if _is_long(end - start + period, period):
                    yield period, start, end + period

    def _catch(self, blocks: np.ndarray, periods: np.ndarray, size: int) -> None:
        """Merges caught squares into stretches that equal themselves one period on."""
        if not len(blocks):
            return
        told = np.zeros(len(blocks), bool)
        for smaller, start, end in self._long():
            told |= (periods % smaller == 0) & (blocks >= start) & (blocks + periods + size <= end)
        blocks, periods = blocks[~told], periods[~told]
        order = np.lexsort((blocks, periods))
        blocks, periods = blocks[order], periods[order]
        while len(blocks):
            block, period = int(blocks[0]), int(periods[0])
            known = self._open.get(period) or next((s for s in reversed(self._closed.get(period, ())) if s[0] <= block), None)
            if known is None or not known[0] <= block < known[1]:
                end = self._equal_until(block, period)
                if end - block < size:  # another word of equal hash
                    blocks, periods = blocks[1:], periods[1:]
                    continue
                known = (self._equal_since(block, period), end)
                if period in self._open:  # only one reaches the end of the text
                    self._closed.setdefault(period, []).append(known)
                else:
                    self._open[period] = known
                    self._close(period)
            start, end = known
            # Squares of this period in this stretch, and of its multiples wholly inside it if it is long enough for a run.
            told = (periods == period) & (blocks >= start) & (blocks < end)
            if _is_long(end - start + period, period):
                told |= (periods % period == 0) & (blocks >= start) & (blocks + periods + size <= end + period)
            told[0] = True
            blocks, periods = blocks[~told], periods[~told]

    def runs(self) -> list[Run]:
        """(start, length, period) by start, then period."""
        found: list[Run] = []
        for period in sorted({*self._open, *self._closed}):
            stretches = [*self._closed.get(period, ())]
            if period in self._open:
                stretches.append(self._open[period])
            for start, end in sorted(set(stretches)):
                length = end - start + period
                if not _is_long(length, period):
                    continue
                smaller = (p for s, n, p in found if period % p == 0 and p < period and s <= start and start + length <= s + n)
                if next(smaller, None) is None:
                    found.append((start, length, period))
        return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(numbers: np.ndarray) -> list[Run]:
    """The runs of a whole text, given as word numbers."""
    catchers = Catchers()
    for at in range(0, len(numbers), APPEND):
        catchers.append(numbers[at : at + APPEND])
    return catchers.runs()


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
ROWS_AT_ONCE = 256


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            sizes, runs, texts = [], [], []
            for text in part.column(1):
                words = (text.as_py() or "").encode().split()
                found = runs_of(_numbers(words)) if len(words) >= LEAST else []
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                if found:
                    stays = collapsed(len(words), found)
                    words = [words[i] for i in np.flatnonzero(stays)]
                texts.append(b" ".join(words).decode())
            arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, runs by start and period, and the text with every run cut to
    its first period, its words joined by single spaces.

    Null and empty texts have no words and no runs. Rows are independent, so repeated rows and ids give repeated rows.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_found, SCHEMA)
