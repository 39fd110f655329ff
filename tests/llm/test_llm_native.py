"""Mixing, decontamination, exact duplicates and sharding against brute force."""

import random
import re
from collections import Counter

import plain_llm as plain
import pytest
from conftest import SMALL

from quern.llm import decontamination, exact_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, finish int, shard string"


def rows_of(n, seed, sources=("b", "a", "ä", None)):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = draw.choice([0, 1, 3, 8, 30, 120])
        text = " ".join(draw.choice(["a", "bb", "cçc", "Dd"]) for _ in range(words))
        rows.append(dict(doc_id=i, text=draw.choice([text, text, text, None, " \t "]), lang=None, source=draw.choice(sources), finish=i, shard="x"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


@pytest.mark.parametrize(("n", "seed"), [(1, 1), (7, 2), (150, 3), (300, 4)])
def test_mix_as_brute_force(spark, n, seed):
    rows = rows_of(n, seed)
    rows += rows[: n // 10]  # repeated rows
    rows.append(dict(rows[0], doc_id=None))
    want = Counter((r["doc_id"], c) for r, c in zip(rows, plain.mix(rows), strict=True))
    got = mixing.shares(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.copies) for r in got) == want
    target, sizes, _ = plain.targets(rows)
    by_size = {sizes[s]: target[s] for s in sizes}
    assert all(abs(by_size[r.source_size] - r.target) <= 1e-6 * max(r.target, 1) for r in got)
    assert sum(r.taken for r in got) <= sum(sizes.values())
    assert all(r.taken <= 3 * r.size for r in got)


def test_mix_slices_and_slots(spark, monkeypatch):
    """Many slices and slots give the same mix as few."""
    rows = rows_of(400, 9, ("hot", "hot", "hot", "x"))
    want = Counter((r["doc_id"], c) for r, c in zip(rows, plain.mix(rows), strict=True))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = mixing.shares(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.copies) for r in got) == want


def test_mixed_rows(spark):
    rows = rows_of(60, 5)
    want = Counter()
    for r, c in zip(rows, plain.mix(rows), strict=True):
        want[tuple(r.values())] += c
    mixed = mixing.mixed(frame(spark, rows))
    assert mixed.columns == [*SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "_finish"]
    assert Counter(tuple(r)[:-1] for r in mixed.collect()) == +want


def test_mix_of_nothing(spark):
    assert mixing.shares(frame(spark, [])).count() == 0
    blank = [dict(doc_id=1, text=None, lang=None, source=None, finish=0, shard="")] * 2
    assert [(r.size, r.taken, r.copies) for r in mixing.shares(frame(spark, blank)).collect()] == [(0, 0, 1)] * 2


QUESTION = "A train to Paris leaves at 10 and Anna travels 120 km with Ben before Anna meets Tom for dinner in town"


def leak_pairs(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}


def test_questions_filled_in_anew(spark):
    other = QUESTION.replace("Anna", "Mia").replace("Ben", "Max").replace("120 km", "75.5 miles").replace("Paris", "New York")
    crossed = "A train to Oslo leaves at 10 and Mia travels 120 km with Max before Eve meets Tom for dinner in town"
    texts = [f"Some words first. {QUESTION}. And more.", f"Before it, {other}.", crossed, "Nothing of the kind here at all", None, "", "x " * 20000 + other]
    got = leak_pairs(spark, texts, [QUESTION])
    assert set(got) == {(0, 0), (1, 0), (6, 0)}
    assert got[0, 0].n_changed == 0 and got[1, 0].n_changed == 6 and got[1, 0].n_slots == 8


def test_short_items_and_numbers(spark):
    texts = ["here we see that two and two", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "1 2 3 4 5 6 7 8 9 10 11 12 13 15", "WE SEE THAT"]
    items = ["we see that", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", None, "", "..."]
    assert set(leak_pairs(spark, texts, items)) == {(0, 0), (3, 0), (1, 1)}
    assert leak_pairs(spark, [], items) == {} and leak_pairs(spark, texts, []) == {}


def test_copies_in_another_case(spark):
    """A name's placeholder depends on what stands before it; a copy is one in any case and after any sign."""
    short = "What is the capital of France and its population"
    capital = "What is the capital of France"
    texts = [f"Question: {short}", f"Question: {capital}?", QUESTION.lower(), QUESTION.title(), QUESTION.upper(), "Question: What is the capital"]
    got = leak_pairs(spark, texts, [short, capital, QUESTION])
    assert set(got) == {(0, 0), (0, 1), (1, 1), (2, 2), (3, 2), (4, 2)}
    assert got[2, 2].n_tokens == got[2, 2].n_item_tokens == 22
    # Half of the copy in lower case, the other half with other names: tokens of both views add up.
    half = QUESTION[:48].lower() + QUESTION[48:].replace("Tom", "Eve")
    assert set(leak_pairs(spark, [half], [QUESTION])) == {(0, 0)}


def test_one_slot_that_does_not_fit(spark):
    body = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300))
    item = f"we met Anna at 10 and then {body} and left Anna at 10 again"
    texts = [item.replace("at 10 again", "at 11 again"), item.replace("left Anna", "left Anna Smith")]
    got = leak_pairs(spark, texts, [item])
    assert set(got) == {(0, 0), (1, 0)} and min(r.n_tokens for r in got.values()) >= 300
    fruit = "the boy has 5 apples and 5 pears so how many does he have"
    assert set(leak_pairs(spark, [fruit.replace("5 apples", "7 apples").replace("5 pears", "9 pears")], [fruit])) == {(0, 0)}


def test_names_that_begin_sentences_and_units(spark):
    loaves = "Marta bakes 12 loaves each day. Marta sells 9 loaves at noon. Marta eats 2 loaves at night."
    tank = "A tank holds 20 liters and loses 3 liters each time, so how many liters are left in it"
    texts = [
        loaves.replace("Marta", "Olga").replace("12", "15"),
        loaves.replace("Marta", "Olga Maria").replace("12", "15"),
        "So " + loaves.replace("Marta", "Olga"),
        tank.replace("liters", "gallons"),
        "Marta bakes 12 loaves each day. Olga sells 9 loaves at noon. Eva eats 2 loaves at night.",
    ]
    got = leak_pairs(spark, texts, [loaves, tank])
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 1)}
    assert got[0, 0].n_changed == 4 and got[3, 1].n_changed >= 3
    # In so few words a sentence's first word is no name if it stands elsewhere in lower case.
    assert leak_pairs(spark, ["This is the capital of Spain, as this text says"], ["What is the capital of France"]) == {}


def test_long_runs_of_names_and_numbers(spark):
    item = "Marta bakes 12 loaves each day and sells 9 of them at noon to Tom and the rest at night"
    names, numbers = "Hello " * 20_000, "12,345," * 20_000
    texts = [names, numbers, f"{names}. {item}", f"{item}. {numbers}", "Ab " * 20_000 + "5 kg " * 20_000]
    assert set(leak_pairs(spark, texts, [item])) == {(2, 0), (3, 0)}


def test_leaks_as_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [r.asDict() for r in bench.collect()]
    got = {(r.doc_id, r.item_id): r.n_tokens for r in decontamination.leaks(docs, bench).collect()}
    assert got == plain.leaks(rows, items, decontamination.UNITS) and got


def test_leaks_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(1, QUESTION, 1), (1, QUESTION, 1), (2, "clean", 2), (None, QUESTION, 3)], "doc_id long, text string, leak_of int")
    bench = spark.createDataFrame([(5, QUESTION)], "item_id long, text string")
    left = decontamination.without_leaks(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "clean", 2)]


def test_index_goes_on(spark, tmp_path):
    schema = "doc_id long, text string, kept boolean"
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first = spark.createDataFrame([(1, "A", True), (2, "a", True), (3, None, True), (4, "", True), (5, "É", True), (5, "É", True)], schema)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.ingest(first, index).collect())
    assert got == Counter([(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (5, 5, 2, False)])
    index.close()
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    second = spark.createDataFrame([(9, "a", None), (10, "é", None), (None, "new", None)], schema)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.ingest(second, again).collect()}
    assert got == {(9, 2, 2, False), (10, 10, 1, True), (None, None, 1, True)}
    assert again.rows().count() == 5
    assert exact_dedup.ingest(second.limit(0), again).count() == 0
    again.close()


def test_a_repeated_batch_keeps_its_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    lost = exact_dedup.ingest(docs.where("doc_id < 10"), index, "monday")  # its result is never stored
    want = rows(exact_dedup.ingest(docs.where("doc_id < 10").repartition(3), index, "monday"))
    assert want == rows(lost) and sum(r[3] for r in want) == 7
    index.close()
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    assert rows(exact_dedup.ingest(docs.where("doc_id < 10").coalesce(1), index, "monday")) == want
    assert not any(r[3] for r in rows(exact_dedup.ingest(docs, index, "tuesday")))
    assert rows(exact_dedup.ingest(docs.where("doc_id < 10"), index, "monday")) == want and index.rows().count() == 7
    index.close()
    # Cut short: only a part of a batch came into the index.
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "other"), buckets=4)
    exact_dedup.ingest(docs.where("doc_id % 7 < 3"), index, "monday")
    assert sum(r.kept for r in exact_dedup.ingest(docs, index, "monday").collect()) == 7
    index.close()


def test_buckets_are_those_of_the_index(spark, tmp_path):
    exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4).close()
    with pytest.raises(ValueError, match="has 4 buckets"):
        exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=8)


def test_index_side_is_not_shuffled(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    fresh = spark.createDataFrame([("x",)], "text_sha256 string").repartition(4, "text_sha256")
    plan = fresh.join(index.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") <= 1
    index.close()


@pytest.mark.parametrize(("n", "seed", "shards"), [(0, 1, 4), (1, 2, 4), (30, 3, 4), (80, 4, 7), (90, 5, 1), (60, 6, 40)])
def test_shards_as_brute_force(spark, monkeypatch, n, seed, shards):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 11)
    rows = rows_of(n, seed)
    rows += [dict(r, doc_id=r["doc_id"]) for r in rows[: n // 4]]
    got = sharding.assign(frame(spark, rows), shards).collect()
    assert len(got) == len(rows)
    own, capacity, left = plain.shard_loads(rows, shards)
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert [loads[i] for i in range(len(own))] == own
    others = [loads[i] for i in range(len(own), shards)]
    assert max(others, default=0) == capacity and sum(v > 0 for v in others) <= left
    assert set(loads) <= set(range(shards))
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by_id = {r.doc_id: r.shard for r in got}
    texts = {}
    for r in rows:
        assert texts.setdefault(r["text"], by_id[r["doc_id"]]) == by_id[r["doc_id"]]


def test_sharded_rows(spark):
    rows = rows_of(20, 8)
    got = sharding.sharded(frame(spark, rows), 3)
    assert got.columns[-2:] == ["_shard", "slot"]
    assert Counter(tuple(r)[:-2] for r in got.collect()) == Counter(tuple(r.values()) for r in rows)


def test_windows_are_rows_and_begins_lose_none(spark, monkeypatch):
    """Places of windows are rows, not functions over arrays; which begins are known changes no result."""
    draw = random.Random(11)
    word = lambda: draw.choice(["alpha", "beta", "gamma", "delta", "12", "Anna"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 1, 2, 3, 5, 8, 9, 14])]
    docs = [(i, " ".join(word() for _ in range(draw.choice([0, 1, 2, 40])))) for i in range(60)] + [(90 + i, f"So {t} it is") for i, t in items] + [(99, None)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plans = []

    def kept(df, label, write=decontamination.materialise):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(decontamination, "materialise", kept)
    found = sorted(map(tuple, decontamination.leaks(docs, items).collect()))
    (plan,) = [p for label, p in plans if label == "item-hits"]
    assert "xxhash64(slice(tokens#" in plan and not re.search(r"slice\(\w+#\d+, \(?lambda", plan)
    assert {r[2] for r in found if r[0] >= 90} == set(range(8))
    monkeypatch.setattr(decontamination, "BEGINS", 0)
    assert sorted(map(tuple, decontamination.leaks(docs, items).collect())) == found
    assert decontamination.leaks(docs, items.limit(0)).collect() == []
