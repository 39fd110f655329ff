"""The word automaton against a search for each word."""

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import automaton
from quern.functions.automaton import Automaton
from quern.operators import flagging

LETTERS = st.sampled_from("abcé𝄞")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(LETTERS, min_size=1, max_size=6), max_size=12), st.lists(st.text(LETTERS, max_size=60) | st.none(), max_size=8))
def test_as_a_search_for_each_word(words, texts):
    found = Automaton(words).found_in(pa.array(texts, pa.string()))
    assert found.tolist() == [t is not None and any(w in t for w in words) for t in texts]


def test_words_over_lanes_and_batches(monkeypatch):
    draw = random.Random(1)
    monkeypatch.setattr(automaton, "LANE_BYTES", 7)
    monkeypatch.setattr(automaton, "TOGETHER_BYTES", 100)
    words = ["needle", "needless", "abc" * 20, "edl"]
    texts = ["".join(draw.choice("needls abc") for _ in range(draw.randrange(300))) for _ in range(60)] + ["x" * 40 + "abc" * 20, ""]
    found = Automaton(words).found_in(pa.array(texts).slice(3))
    assert found.tolist() == [any(w in t for w in words) for t in texts[3:]] and found[-2] and not found[-1]


def test_a_hundred_thousand_words(spark):
    draw = random.Random(2)
    words = sorted({"".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(7, 12))) for _ in range(100_000)})
    texts = [(i, " ".join(draw.choices("abcdefghijklmnop", k=50)) + (draw.choice(words).upper() if i % 3 == 0 else "")) for i in range(90)]
    docs = spark.createDataFrame([*texts, (90, None), (91, "")], "doc_id long, text string")
    kept = [r.doc_id for r in flagging.filter_banned(docs, words).orderBy("doc_id").collect()]
    assert kept == [i for i in range(92) if i >= 90 or i % 3]


def test_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(flagging, "PART_BYTES", 12)
    words = [f"word{i:02}" for i in range(20)]
    docs = spark.createDataFrame([(i, f"a word{i:02} b") for i in range(30)], "doc_id long, text string")
    assert sorted(r.doc_id for r in flagging.filter_banned(docs, words).collect()) == list(range(20, 30))
