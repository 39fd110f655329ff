"""Language ID, near-duplicates, scores, token files, quality and licences."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import plain_llm as plain
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import language_id, lattice_lm, licenses, near_dedup, quality, text_bytes, token_files
from quern.llm.common import fold, plain_fold

ANY = st.text(st.characters(exclude_categories=["Cs"]), max_size=40)


def labelled(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Bytes


@settings(max_examples=60, deadline=None)
@given(st.lists(ANY | st.none(), max_size=8))
def test_words_of_chunks(texts):
    found = []
    for _, data, borders in text_bytes.chunks(pa.array(texts, pa.string()), limit=16):
        data = text_bytes.LOWER[data]
        starts, ends, first = text_bytes.word_spans(data, borders)
        hashes = text_bytes.SpanHash(data)(starts, ends)
        for a, b in itertools.pairwise(first):
            found.append([bytes(data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)])
        whole = {bytes(data[s:e]): h for s, e, h in zip(starts, ends, hashes, strict=True)}
        assert len(set(whole.values())) == len(whole)
    assert found == [plain.WORDS.findall(plain.lower(t)) for t in texts]


def test_folds(spark):
    df = spark.createDataFrame([(0,), (17,), (-3,), (None,)], "doc_id long")
    assert [r[0] for r in df.select(fold("doc_id", 5)).collect()] == [plain_fold(i, 5) for i in (0, 17, -3, None)]


# Language ID


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = fold("doc_id", 4) == 2
    model = language_id.learn(docs.where(~held))
    found = language_id.identify(docs.where(held).select("doc_id", "lang", "text"), model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) > 0
    assert all(0 <= r.score <= 1 for r in found)


LANGUAGES = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog that went with them", "en"), ("der hund und die katze nicht zu ihnen", "de")] * 20)]


def test_mixture_as_plain_em(spark):
    model = language_id.learn(labelled(spark, LANGUAGES, "doc_id long, text string, lang string"))
    text = "the cat and the dog that went with them und die katze nicht zu ihnen"
    buckets = next(language_id.grams(pa.array([text])))
    chosen, shares = language_id.infer(buckets, model[1])
    assert {model[0][i] for i in chosen} == {"en", "de"}
    share = [0.5, 0.5]
    for _ in range(300):
        new = [0.0, 0.0]
        for b in buckets:
            parts = [s * math.exp(row[b]) for s, row in zip(share, model[1], strict=True)]
            new = [n + p / sum(parts) / len(buckets) for n, p in zip(new, parts, strict=True)]
        share = new
    assert abs(share[chosen[0]] - shares[0]) < 0.01


def test_languages_at_the_edges(spark):
    model = language_id.learn(labelled(spark, [*LANGUAGES, (99, None, "en"), (100, "x", None)], "doc_id long, text string, lang string"))
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "123 ...", "c"), (4, "und", "d"), (5, "日本", "e"), (None, "the cat " * 20000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Lang_Pred string")
    found = language_id.identify(df, model).collect()
    assert found[0].asDict().keys() == {"doc_id", "Lang_Pred", "_lang_pred", "score", "langs", "shares"}
    assert [r._lang_pred for r in found][:5] == ["und", "und", "und", "und", "de"]
    assert found[-1]._lang_pred == "en" and len(found) == 7
    nothing = language_id.learn(df.limit(0).select("doc_id", "text", df["Lang_Pred"].alias("lang")))
    assert {r._lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_too_many_languages(spark):
    with pytest.raises(ValueError):
        language_id.learn(labelled(spark, [(i, "a", str(i)) for i in range(130)], "doc_id long, text string, lang string"))


# Near-duplicates


def near_rows():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    base = [draw.choice(words) for _ in range(150)]
    rows.append(base)
    for _ in range(60):  # near the base, but often not near each other
        copy = list(base)
        for at in draw.sample(range(150), 3):
            copy[at] = draw.choice(words)
        rows.append(copy)
    chain = [draw.choice(words) for _ in range(120)]
    for _ in range(8):
        rows.append(list(chain))
        chain[draw.randrange(120)] = draw.choice(words)
        chain[draw.randrange(120)] = draw.choice(words)
    rows += [[draw.choice(words) for _ in range(n)] for n in (1, 3, 4, 5, 6, 40, 200) for _ in range(4)]
    line = [draw.choice(words) for _ in range(8)]
    rows += [line * 40 + [draw.choice(words) for _ in range(80)] for _ in range(4)]
    texts = [" ".join(r) for r in rows]
    texts += [texts[0].upper(), texts[5], "w1", "W1.", "", None, "...", None]
    draw.shuffle(texts)
    return [dict(doc_id=i if i % 9 else i - 1 if i else None, text=t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [500, 7])
def test_near_classes_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame([(r["doc_id"], r["text"], i) for i, r in enumerate(rows)], "doc_id long, text string, keep_of int")
    want = sorted(Counter(plain.near_classes(rows)).values())
    found = near_dedup.near_duplicates(df).collect()
    assert len(found) == len(rows)
    assert sum(r.kept for r in found) == len(want)
    assert sorted(r.class_size for r in found if r.kept) == want
    stay = near_dedup.without_near_duplicates(df)
    assert stay.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in stay.collect()) == sorted((str(r["doc_id"]), str(r["text"])) for r in plain.first_of_classes(rows))


def test_near_duplicates_of_repeated_and_no_rows(spark):
    schema = "doc_id long, text string, n int"
    row = (1, "one two three four five six", 0)
    assert [tuple(r) for r in near_dedup.without_near_duplicates(spark.createDataFrame([row, row, row], schema)).collect()] == [row]
    assert near_dedup.without_near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_signatures_estimate_the_similarity():
    random_ = np.random.default_rng(1)
    shared = random_.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = []
    for _ in range(2):
        own = random_.integers(0, 1 << 62, 100, dtype=np.uint64)
        sets.append((np.concatenate([shared, own]), 1 + np.log(random_.integers(1, 6, 400))))
    signs = near_dedup.signatures(sets, 2000)
    order = [np.argsort(s) for s, _ in sets]
    true = near_dedup.weighted_jaccard(*[x for (s, w), o in zip(sets, order, strict=True) for x in (s[o], w[o])])
    assert abs((signs[0] == signs[1]).mean() - true) < 0.05


# Lattice


TINY = lattice_lm.Lattice([b" a", b"b", b"ab", b" ab", b" ", b"a", b"bb"], np.log(np.array([0.25, 0.15, 0.1, 0.1, 0.15, 0.15, 0.1])), 0.2)


def segmentations(word, pieces):
    if not word:
        return 1.0
    return sum(p * segmentations(word[len(x) :], pieces) for x, p in pieces.items() if word.startswith(x))


def test_recursion_as_all_segmentations():
    recursion = lattice_lm.Recursion(TINY)
    pieces = dict(zip(TINY.pieces, np.exp(TINY.logs), strict=True))
    words = [bytes(w) for n in range(1, 7) for w in itertools.product(b"ab", repeat=n)]
    logs, expected = recursion.run(words, np.ones(len(words)))
    assert np.allclose(np.exp(logs), [segmentations(b" " + w, pieces) for w in words])
    alone = np.zeros(len(TINY.pieces))
    assert np.allclose([recursion._alone(b" " + w, 1.0, alone) for w in words], logs)
    assert np.allclose(expected, alone)
    # Every letter of every word is explained once by pieces of the expected number.
    assert math.isclose(sum(n * len(p) for n, p in zip(expected, TINY.pieces, strict=True)), sum(len(w) + 1 for w in words))


def test_words_and_end_sum_to_one():
    """Over words of a, b up to a length, plus what longer words can have."""
    recursion = lattice_lm.Recursion(lattice_lm.Lattice([b" ", b"a", b"b"], np.log(np.array([0.6, 0.15, 0.1])), 0.15 / 0.75))
    total = sum(np.exp(recursion.run([bytes(w) for w in itertools.product(b"ab", repeat=n)])[0]).sum() if n else 0.6 for n in range(12))
    assert abs(total + 0.15 / 0.75 - 1) < 1e-6


def lm_plain(rows, folds, held):
    train = Counter()
    for doc_id, text in rows:
        if plain_fold(doc_id, folds) != held:
            train.update([*plain.SPACED.findall(plain.lower(text)), None])
    n, v = sum(train.values()), len(train)
    for doc_id, text in rows:
        tokens = [*plain.SPACED.findall(plain.lower(text)), None]
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        yield doc_id, plain_fold(doc_id, folds) == held, len(tokens), sum(train[t] > 0 for t in tokens), n, base


@pytest.mark.parametrize("hot", [200_000, 3])
def test_scores(spark, monkeypatch, hot):
    monkeypatch.setattr(lattice_lm, "HOT_WORDS", hot)
    monkeypatch.setattr(lattice_lm, "HELD_WORDS", 5)
    rows = [(i, t) for i, t in enumerate(["The cat sat", "the cat", None, "", "a b cat\x0bDOG", "zq" * 3000, "日本 語", "the the the", " \t"])]
    rows += [rows[0], (None, "cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = fold("doc_id", 5) == 1
    model = lattice_lm.learn(docs, held, public_tokenizers.path("piece_bpe_32k.model"), rounds=1)
    found = lattice_lm.score(docs, held, model).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == Counter((*x[:5], round(x[5], 6)) for x in lm_plain(rows, 5, 1))
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    by_id = {r.doc_id: r.score for r in found}
    assert by_id[5] < by_id[0] < by_id[1] < by_id[3] and by_id[2] == by_id[3]


def test_scores_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (6, None)], "doc_id long, text string").where("doc_id > 0")
    everything = fold("doc_id", 1) == 0
    model = lattice_lm.learn(docs, everything, public_tokenizers.path("piece_bpe_32k.model"), rounds=1)
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in lattice_lm.score(docs, everything, model).collect())
    assert lattice_lm.score(docs.limit(0), everything, model).count() == 0


def test_pieces_beat_letters(spark):
    """Held-out texts are likelier than the same letters in another order."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    held = fold("doc_id", 5) == 1
    model = lattice_lm.learn(docs, held, public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(r.doc_id, r.text) for r in docs.where(held).limit(20).collect()]
    mixed = [(i, " ".join("".join(random.Random(i).sample(w, len(w))) for w in t.split())) for i, t in rows]
    score = [{r.doc_id: r.score for r in lattice_lm.score(spark.createDataFrame(x, "doc_id long, text string"), held, model).collect()} for x in (rows, mixed)]
    assert all(score[0][i] > score[1][i] for i in score[0] if len(dict(rows)[i]) > 50)


# Token files


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3) | st.integers(0, 60000) | st.integers(0, (1 << 64) - 1), max_size=700))
def test_codec(ids):
    ids = np.array(ids, dtype=np.uint64)
    words, offsets = token_files.pack(ids)
    assert (token_files.unpack(words, offsets.astype(np.int64), len(ids)) == ids).all()
    for b in range(len(offsets)):
        one = words[offsets[b] : offsets[b + 1] if b + 1 < len(offsets) else None]
        part = ids[b * token_files.BLOCK : (b + 1) * token_files.BLOCK]
        assert (token_files.unpack(one, np.zeros(1, np.int64), len(part)) == part).all()


LATIN = st.text(st.characters(max_codepoint=0xFF) | st.sampled_from("'stredvml <|aé.,#\xa0\x85\x1f"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(ANY | LATIN, max_size=3))
def test_memo_changes_no_ids(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = [e.ids for e in _tokenizer(Tokenizer, path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_files.encoder(path)(texts)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_tokenizer_gives_its_own_ids(name):
    """Files that cut texts otherwise are not taken for the one whose words the encoder knows."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = ["", " ", "Hello  there, ÜBER 2²3 x", "don't\n\nstop", "\xa0a", "", "two lines\n", "x" * 5000, "naïve\x85 café"]
    want = [e.ids for e in _tokenizer(Tokenizer, path).encode_batch(texts, add_special_tokens=False)]
    fresh = token_files.Encoder(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in fresh(texts)] == want


def test_full_memo_changes_no_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "MEMO_WORDS", 5)
    monkeypatch.setattr(token_files, "MEMO_CHARS", 4)
    path = public_tokenizers.path("word_bpe_49k.json")
    fresh = token_files.Encoder(path)
    for texts in (["one two", "three"], ["three four five", "one six"], ["seven one eight two"]):
        want = [e.ids for e in _tokenizer(Tokenizer, path).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in fresh(texts)] == want
        assert len(fresh.known) <= 5


_loaded = {}


def _tokenizer(kind, path):
    return _loaded.setdefault(path, kind.from_file(path))


@pytest.mark.parametrize("chunk", [1 << 16, 10])
def test_files(spark, monkeypatch, tmp_path, chunk):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CHUNK_IDS", chunk)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i * 7 % 50, t) for i, t in enumerate(["Hello there", "", None, "a<|endoftext|>b", "ünï code   x", "long " * 5000, "don't"] * 6)]
    rows.append((None, "no id"))
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, str(tmp_path / "ids"))
    read = token_files.read_tokens(spark, str(tmp_path / "ids"))
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in read.mapInArrow(token_files.crc32, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()}
    found = sorted(read.collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(found, ordered, strict=True):
        ids = [*_tokenizer(Tokenizer, path).encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and sums[doc_id, start] == zlib.crc32(bytes(r.ids))
        start += len(ids)


def test_no_files(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


# Quality


def test_quality_of_held_out_texts(spark):
    sf = SMALL.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = fold("doc_id", 3) == 1
    model = quality.learn(docs.where(~held), labels.where(~held))
    found = quality.score(docs.where(held), model).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in found) >= 0.97 * len(found) > 0


def test_quality_at_the_edges(spark):
    docs = spark.createDataFrame([(1, "good text here", 1), (2, "bad!!! bad!!!", 2), (3, None, 3), (4, "", 4), (5, " \n", 5), (5, " \n", 5), (None, "x" * 200000, 6)], "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (9, 1), (4, None), (None, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    found = quality.score(docs, model)
    assert found.columns == ["doc_id", "Score", "_score"]
    got = found.collect()
    assert len(got) == 7 and all(0 <= r._score <= 1 for r in got)
    assert len({r._score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert got[0]._score > got[1]._score
    assert quality.score(docs.limit(0), model).count() == 0
    untaught = quality.learn(docs, labels.limit(0))
    assert all(r._score == 0.5 for r in quality.score(docs, untaught).collect())


def test_features_as_brute_force():
    texts = ["ab ab  cd", "", None, "x", "é é é", " \t", "abc" * 5]
    found = [[] for _ in texts]
    row = 0
    for kinds in quality.features(pa.array(texts, pa.string())):
        n = len(kinds[0][1]) - 1
        for i in range(n):
            found[row + i] = [list(b[f[i] : f[i + 1]]) for b, f in kinds]
        row += n
    for text, kinds in zip(texts, found, strict=True):
        words = (text or "").encode().split()
        assert len(kinds[0]) == len(words)
        for back in quality.DISTANCES:
            assert kinds[back] == [2 * back + (i >= back and words[i] == words[i - back]) for i in range(len(words))]
        for order, got in zip(quality.ORDERS, kinds[1 + len(quality.DISTANCES) :], strict=True):
            assert len(got) == sum(max(0, len(w) + 2 - order + 1) for w in words)


# Licences


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["under the MIT license", "Apache License, Version 2.0", "CC BY-NC", "the", "é", ",", "license", "\n"]), max_size=12))
def test_places_as_brute_force(parts):
    text = " ".join(parts)
    words = plain.WORDS.findall(plain.lower(text))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    found = licenses.Scanner().scan(text)
    assert (found.n_words, found.n_base) == (len(words), len(places))
    assert (found.first_word, found.last_word) == ((min(places), max(places)) if places else (None, None))
    assert found.base_labels == tuple(sorted(labels)) and labels <= set(found.labels) and 0 <= found.score <= 1


def tree(depth):
    leaf = st.sampled_from(["mit", "apache-2.0", "gpl-3.0-only", "unheard-of-1.0"])
    if not depth:
        return leaf
    return leaf | st.tuples(tree(depth - 1), st.sampled_from(["and", "or"]), tree(depth - 1))


def shown(t):
    return t if isinstance(t, str) else f"({shown(t[0])} {t[1]} {shown(t[2])})"


def valued(t):
    if isinstance(t, str):
        return licenses.FREEDOM.get(licenses.label_of(t), licenses.UNKNOWN)
    return (max if t[1] == "or" else min)(valued(t[0]), valued(t[2]))


@settings(max_examples=100, deadline=None)
@given(tree(4))
def test_expressions_as_trees(t):
    assert licenses.evaluate(licenses.postfix(shown(t)))[1] == valued(t)


def test_expressions():
    assert licenses.postfix("mit or gpl-2.0 and bsd-3-clause with x") == ["mit", "gpl-2.0", "bsd-3-clause", "x", "with", "and", "or"]
    assert licenses.postfix("mit */ more") == ["mit"] and licenses.postfix("mit\nor x") == ["mit"]
    for wrong in ("", "and mit", "mit or", "(mit", ") mit", "mit and and x"):
        assert licenses.postfix(wrong) is None
    found = licenses.Scanner().scan("# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND CC-BY-NC-4.0 */")
    assert found.labels == ("cc-by-nc", "gpl-2") and found.score == 0.1


def test_licences_of_a_table(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "z " * 100000 + "Under the MIT License", "z")], "doc_id long, text string, labels string")
    found = licenses.scan(docs).collect()
    assert docs.columns[2] in found[0].asDict() and "_labels" in found[0].asDict()
    assert [(r.n_words, r.n_base, r.first_word, r.base_labels) for r in found] == [(0, 0, None, "")] * 3 + [(100004, 1, 100000, "mit")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_slices_keep_all_rows_in_order():
    texts = ["", None, "a" * 10, "é" * 3, "b" * 50, "", "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], names=["id", "text"])
    for limit in (1, 10, 16, 1000):
        parts = list(text_bytes.slices(iter([batch.slice(0, 0), batch, batch.slice(2, 3)]), 1, limit))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts + texts[2:5]
        sizes = [[len((x or "").encode()) for x in p.column(1).to_pylist()] for p in parts]
        assert all(len(s) and (sum(s) <= limit or len(s) == 1) for s in sizes)
