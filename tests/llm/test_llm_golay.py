"""SimHash classes by Golay keys against all pairs."""

import random

import numpy as np
import plain_llm as plain
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import golay_dedup
from quern.llm.queries import QUERIES

BITS = st.lists(st.integers(0, 63), max_size=4)


def keys_of(value):
    return set(golay_dedup.pair_keys(np.array([value], np.uint64))[1].tolist())


def test_code():
    nearest, others = golay_dedup._errors()
    assert len(set(nearest.tolist())) == 2048 and max(int(e).bit_count() for e in nearest) == 3
    far = [i for i, e in enumerate(nearest.tolist()) if e.bit_count() == 3]
    assert len(far) == 1771
    for i in far:  # the errors to all six codewords share no bit
        errors = [int(nearest[i]), *map(int, others[i])]
        assert sum(errors).bit_count() == 23 and sum(e.bit_count() for e in errors) == 23
    assert not others[[i for i in range(2048) if i not in set(far)]].any()


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 2**64 - 1), BITS)
def test_near_fingerprints_share_a_key(value, bits):
    other = value
    for b in bits:
        other ^= 1 << b
    assert keys_of(value) & keys_of(other)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aAbB \t\x0b\x1cé\n"), max_size=60) | st.none())
def test_fingerprints(text):
    assert golay_dedup.fingerprint(text) == plain.fingerprint(text)


def node_frame(spark, values):
    signed = np.array(sorted(set(values)), np.uint64).view(np.int64).tolist()
    return spark.createDataFrame([(v,) for v in signed], "node long")


CASES = [(1, 40, 600, 3, 16384), (2, 3, 300, 6, 16384), (3, 1, 400, 9, 16384), (4, 1, 400, 9, 40), (5, 3, 300, 6, 20), (6, 1, 200, 7, 0)]


@pytest.mark.parametrize(("seed", "centres", "n", "flips", "heavy"), CASES)
def test_links_as_all_pairs(spark, monkeypatch, seed, centres, n, flips, heavy):
    monkeypatch.setattr(golay_dedup, "HEAVY", max(heavy, 1))
    draw = random.Random(seed)
    centre = [draw.getrandbits(64) for _ in range(centres)]
    values = [draw.choice(centre) ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(flips + 1))) for _ in range(n)]
    nodes = node_frame(spark, values)
    got = {r.node: r["class"] for r in golay_dedup.components(golay_dedup.links(nodes)).collect()}
    values = sorted(set(values))
    classes = plain.hamming_classes(values, golay_dedup.NEAR)
    signed = dict(zip(values, np.array(values, np.uint64).view(np.int64).tolist(), strict=True))
    grouped, wanted = {}, {}
    for v in values:
        grouped.setdefault(got.get(signed[v], signed[v]), set()).add(v)
        wanted.setdefault(classes[v], set()).add(v)
    assert sorted(map(sorted, grouped.values())) == sorted(map(sorted, wanted.values()))


def expected(rows):
    prints = {t: plain.fingerprint(t) for _, t in rows}
    classes = plain.hamming_classes(sorted(set(prints.values())), golay_dedup.NEAR)
    least = {}
    for i, t in rows:
        if i is not None:
            c = classes[prints[t]]
            least[c] = min(least.get(c, i), i)
    return sorted(((i, f"{prints[t]:016x}", least.get(classes[prints[t]])) for i, t in rows), key=repr)


def found(df):
    return sorted(((r.doc_id, f"{r.print & (2**64 - 1):016x}", r.component_id) for r in golay_dedup.near_duplicates(df).collect()), key=repr)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, None), (2, ""), (9, " \n"), (7, "one"), (7, "one"), (None, "ONE"), (None, "alone and without id"), (-4, "a b c d"), (8, "A  b\tc d")]
    rows += [(20, long), (21, long.replace("w7 ", "x7 ")), (22, f"{long} " * 60), (30, "é " * 9)]
    rows = [(i, t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == expected(rows)
    assert found(df.selectExpr("doc_id", "text", "1 as print", "2 as node", "3 as component_id", "'x' as key")) == expected(rows)
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_query_as_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_golay_simhash"](spark, SMALL).collect()), key=repr)
    assert got == expected(rows) and len({r[2] for r in got}) < len(got)
