"""Search for very many words at once: a double-array automaton as numpy tables, stepped over a batch of texts together.

The words are a trie of their UTF-8 bytes. A state's child for byte c stands at ``base[state] + c`` if ``check`` there
names the state, so a step is two lookups whatever the number of words; where there is no child, ``fail`` leads to the
longest end of what was read that begins a word. Texts are cut into lanes of equal length, which overlap by the longest
word less one byte, and all lanes of a batch take a step at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

LANE_BYTES = 512
# So many bytes of texts are stepped together, one text at least.
TOGETHER_BYTES = 8 << 20
_CANDIDATES = 512


class Automaton:
    """Whether any of ``words``, none of them empty, occurs in a text."""

    def __init__(self, words: Sequence[str]):
        encoded = [w.encode() for w in words]
        self.longest = max(map(len, encoded), default=0)
        children, ends, parents = _trie(encoded)
        base, slot = _placed(children)
        size = int(max(slot.max(), base.max())) + 257
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.fail, self.hit = np.zeros(size, np.int32), np.zeros(size, bool)
        self.base[slot] = base
        self.check[slot[1:]] = slot[[p for p, _, _ in parents]]
        self.hit[slot[ends]] = True
        # Nodes are numbered by depth, and a node's failure is less deep than itself.
        depth = np.array([d for _, _, d in parents], np.int64)
        for d in range(2, self.longest + 1):
            level = np.flatnonzero(depth == d)
            own = slot[level + 1]
            above = self.check[own]
            self.fail[own] = self._step(self.fail[above], (own - self.base[above]).astype(np.int64))
            self.hit[own] |= self.hit[self.fail[own]]

    def _step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        to = self.base[states] + byte
        found = self.check[to] == states
        to[~found] = 0
        open_ = np.flatnonzero(~found & (states != 0))
        states = states[open_]
        while len(open_):
            states = self.fail[states]
            there = self.base[states] + byte[open_]
            found = self.check[there] == states
            to[open_[found]] = there[found]
            rest = ~found & (states != 0)
            open_, states = open_[rest], states[rest]
        return to

    def found_in(self, texts: pa.Array) -> np.ndarray:
        """For each text whether a word occurs in it; null texts have none."""
        texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
        out = np.zeros(len(texts), bool)
        if not len(texts) or not self.longest:
            return out
        texts = texts.fill_null("")
        _, offsets, buffer = texts.buffers()
        borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = max(int(np.searchsorted(borders, borders[row] + TOGETHER_BYTES, side="right")) - 1, row + 1)
            out[row:end] = self._found(data, borders[row : end + 1])
            row = end
        return out

    def _found(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        out = np.zeros(len(borders) - 1, bool)
        lanes = -(-np.diff(borders) // LANE_BYTES)
        text = np.repeat(np.arange(len(lanes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = borders[text] + nth * LANE_BYTES
        length = np.minimum(LANE_BYTES + self.longest - 1, borders[text + 1] - start)
        order = np.argsort(-length, kind="stable")
        text, start, length = text[order], start[order], length[order]
        states = np.zeros(len(text), np.int64)
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step))  # lanes longer than ``step``
            if n < len(states):
                text, start, length, states = text[:n], start[:n], length[:n], states[:n]
            states = self._step(states, data[start + step].astype(np.int64)).astype(np.int64)
            hit = self.hit[states]
            if hit.any():
                out[text[hit]] = True
                rest = ~out[text]
                text, start, length, states = text[rest], start[rest], length[rest], states[rest]
            if not len(states):
                break
        return out


def _trie(words: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[tuple[int, int, int]]]:
    """Children of all nodes, nodes at which words end, and (parent, byte, depth) of all but the first; by depth."""
    children: list[dict[int, int]] = [{}]
    parents: list[tuple[int, int, int]] = []
    ends: list[int] = []
    at = [(0, w) for w in dict.fromkeys(words)]
    depth = 0
    while at:
        depth += 1
        after = []
        for node, word in at:
            byte = word[depth - 1]
            child = children[node].get(byte)
            if child is None:
                child = children[node][byte] = len(children)
                children.append({})
                parents.append((node, byte, depth))
            if len(word) == depth:
                ends.append(child)
            else:
                after.append((child, word))
        at = after
    return children, ends, parents


def _placed(children: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(base, slot) of all nodes. Nodes with several children go one after the other to the next place that has room
    for them all; nodes with one child then fill the gaps."""
    base, slot = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
    taken = np.zeros(1 << 14, bool)
    taken[:256] = True  # so that no base is negative; the root has slot 0
    ahead, at = np.arange(_CANDIDATES)[:, None], 1
    for node in sorted((n for n, own in enumerate(children) if len(own) > 1), key=lambda n: -len(children[n])):
        byte = np.array(sorted(children[node]), np.int64)
        while True:
            if at + _CANDIDATES + 256 > len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken), bool)])
            room = ~taken[at + ahead + byte].any(axis=1)
            if room.any():
                break
            at += _CANDIDATES
        at += int(room.argmax())
        base[node] = at
        taken[at + byte] = True
        slot[[children[node][b] for b in byte.tolist()]] = at + byte
    single = [n for n, own in enumerate(children) if len(own) == 1]
    free = np.flatnonzero(~np.concatenate([taken, np.zeros(len(single), bool)]))[: len(single)]
    byte = np.array([next(iter(children[n])) for n in single], np.int64)
    base[single] = free - byte
    slot[[children[n][b] for n, b in zip(single, byte.tolist(), strict=True)]] = free
    return base, slot
