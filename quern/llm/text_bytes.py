"""Vectorised helpers over the UTF-8 bytes of an Arrow column of texts.

All functions run inside tasks on one Arrow batch. A batch is cut into chunks of bounded bytes at
text borders (a single longer text is a chunk of its own), so memory follows the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
# Results of a slice are sent before the next one is looked at.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_A = U64(0xFF51AFD7ED558CCD)
_MIX_B = U64(0xC4CEB9FE1A85EC53)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = values ^ (values >> U64(33))
    x = x * _MIX_A
    x ^= x >> U64(33)
    x *= _MIX_B
    return x ^ (x >> U64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "byte" not in _tables:
        _tables["byte"] = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
    if len(_tables.get("up", ())) < n + 1:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _tables["byte"], _tables["up"], _tables["down"]


class SpanHash:
    """Hashes of any spans of one byte buffer from prefix sums; equal bytes give equal hashes."""

    def __init__(self, data: np.ndarray):
        byte, up, self._down = _table(len(data))
        self._prefix = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(byte[data] * up[: len(data)], out=self._prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._prefix[ends] - self._prefix[starts]) * self._down[starts])

    def columns(self, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For a buffer of ``n`` spans of one length, the terms of hashes of their parts: the hash from byte i to byte k
        of all spans is ``mix((a[k] - a[i]) * b[i])``."""
        upto = np.empty((length + 1, n), dtype=U64)
        upto[:length] = self._prefix[:-1].reshape(n, length).T
        upto[length] = self._prefix[length::length]
        return upto, np.ascontiguousarray(self._down[: n * length].reshape(n, length).T)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, borders): runs of texts as one buffer; nulls count as empty."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(borders, borders[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, whole[borders[row] : borders[end]], borders[row : end + 1] - borders[row]
        row = end


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in smaller ones of at most ``limit`` bytes of the text in ``column``, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        row = 0
        while row < len(ends):
            before = int(ends[row - 1]) if row else 0
            end = max(int(np.searchsorted(ends, before + limit, side="right")), row + 1)
            yield batch.slice(row, end - row)
            row = end


def _word_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORD = _word_table()


def word_spans(data: np.ndarray, borders: np.ndarray, member: np.ndarray = WORD):
    """(starts, ends, first): byte spans of words, and for each text the number of words before it.

    Words are runs of the bytes in ``member``; no word runs over the end of a text.
    """
    inside = member[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    opening = borders[:-1][borders[:-1] < len(data)]
    before[opening] = False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    closing = borders[1:][borders[1:] > 0] - 1
    after[closing[closing < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, borders)
