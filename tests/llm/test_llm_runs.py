"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import zlib

import numpy as np
import plain_llm as plain
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import periodic_runs
from quern.llm.queries import QUERIES


def appended(words, step):
    catchers = periodic_runs.Catchers()
    for at in range(0, len(words), step):
        catchers.append(np.array(words[at : at + step]))
    return catchers.runs()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 30)), max_size=6), st.integers(1, 40))
def test_runs_as_brute_force(parts, step):
    words = [w for part, n in parts for w in part * n][:600]
    want = plain.runs(words)
    assert periodic_runs.runs_of(np.array(words, np.int64)) == want
    assert appended(words, step) == want


@pytest.mark.parametrize("seed", range(12))
def test_long_periods(seed):
    draw = random.Random(seed)
    words = [draw.randrange(4) for _ in range(draw.randrange(50))]
    while len(words) < 1500:
        part = [draw.randrange(50) for _ in range(draw.randrange(1, 200))]
        words += (part * 8)[: draw.randrange(1, 8 * len(part))]
    want = plain.runs(words)
    assert want and periodic_runs.runs_of(np.array(words)) == appended(words, 7) == want


def test_one_word_for_ever():
    n = 300_000
    assert periodic_runs.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert not periodic_runs.runs_of(np.arange(n))


def test_edges(spark):
    line = " ".join(f"w{i}" for i in range(10))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, f"{line}\n" * 3, "x"), (5, f"a {line} {line}\x0b{line} b", None), (5, f"a {line} {line}\x0b{line} b", None)]
    rows += [(6, "é " * 23, "x"), (7, "é " * 24, "x"), (8, f"{line} " * 50_000 + "end", "x"), (9, "  x", "x")]
    found = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in found] == [
        (1, 0, []), (2, 0, []), (3, 0, []), (None, 30, [(0, 30, 10)]), (5, 32, [(1, 30, 10)]), (5, 32, [(1, 30, 10)]),
        (6, 23, []), (7, 24, [(0, 24, 1)]), (8, 500_001, [(0, 500_000, 10)]), (9, 2, []),
    ]
    assert [r.collapsed for r in found] == ["", "", "", line, f"a {line} b", f"a {line} b", " ".join("é" * 23), "é", f"{line} end", "  x"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(empty).collect() == []


def test_query_as_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    assert len(found) == len(docs)
    for doc in docs:
        words = plain.SPACED.findall(doc.text or "")
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain.runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        r = found[doc.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
