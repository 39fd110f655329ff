"""Language-model scores by a subword lattice.

An existing vocabulary gives the pieces and, by its scores, their first weights. A word is a stream of pieces,
drawn one by one, of which the first begins with a blank; whole words seen in training are pieces of their own besides.
The probability of a text is the sum over all its segmentations, which a forward recursion in log space
gives. No piece holds the border of two words, so this is a product over the words and the end, and every distinct word
needs the recursion once.

With c of N training tokens a whole word weighs (c - d) / N, and the pieces of the vocabulary what this leaves, d V / N for V
distinct tokens; d follows from the numbers of tokens seen once and twice. Probabilities of all words and the end sum to 1.
The vocabulary's weights are learned by expectation-maximisation over the distinct words, as it is for words not seen:
a forward-backward pass gives the expected number of each piece. Only those, bounded by the vocabulary, meet on the driver.

Word counts stay distributed. To score texts, the most frequent words are sent to all tasks and all others are joined
by the word, so no frequent word is a key of that join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text_bytes import U64, SpanHash, mix
from quern.session import materialise

ROUNDS = 3
# Weight of the vocabulary's own scores among the expected counts, in pieces.
PRIOR_PIECES = 2000.0
# Words sent to all tasks: so many at most, of so many bytes at most.
HOT_WORDS, HOT_BYTES = 200_000, 64
# Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 400_000
# Longer words go through the recursion one by one.
TOGETHER_BYTES = 48
LOWER = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_SLOTS = 18
LN10 = float(np.log(10.0))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or b"").translate(LOWER).split()


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces as bytes (a blank for the mark of a word's begin) with first log weights.

    Scores that are ranks, as those of merges are, weigh 1 / (rank + 10). All single bytes are pieces, so every text
    has a segmentation. Pieces with a blank after their begin cannot occur.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    size = model.get_piece_size()
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            pieces[piece] = model.get_score(i)
    if pieces and min(pieces.values()) < -1000:
        pieces = {p: -float(np.log(10.0 - s)) for p, s in pieces.items()}
    least = min(pieces.values(), default=0.0)
    for b in range(256):
        pieces.setdefault(bytes([b]), least)
    total = np.logaddexp.reduce(list(pieces.values()))
    return {p: s - total for p, s in pieces.items()}


@dataclass(frozen=True)
class Lattice:
    """Pieces with natural log weights, and the probability that the end stands in place of a word."""

    pieces: list[bytes]
    logs: np.ndarray
    end: float


class Recursion:
    """Forward and backward recursion over many words at once."""

    def __init__(self, lattice: Lattice):
        self.logs = lattice.logs
        self.index = {p: i for i, p in enumerate(lattice.pieces)}
        self.lengths = sorted({len(p) for p in lattice.pieces})
        buffer = np.frombuffer(b"".join(lattice.pieces), np.uint8)
        ends = np.cumsum([len(p) for p in lattice.pieces])
        keys = SpanHash(buffer)(ends - [len(p) for p in lattice.pieces], ends)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, shift = np.arange(len(keys)), 64 - _SLOTS
        while len(left):
            if shift < 0:
                raise ValueError("pieces with equal hashes")
            slot = ((keys[left] >> U64(shift)) & U64((1 << _SLOTS) - 1)).astype(np.int64)
            held = np.full(1 << _SLOTS, -1, dtype=np.int32)
            held[slot] = left
            self.levels.append((shift, held, keys))
            left = left[held[slot] != left]
            shift -= 11

    def _pieces(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, pieces) of the hashes that are pieces.

        A piece stands in a later level only if another has its slot in those before.
        """
        rows, found, left = [], [], None
        for shift, held, keys in self.levels:
            here = hashes if left is None else hashes[left]
            slot = here >> U64(shift)
            at = held[(slot if shift + _SLOTS == 64 else slot & U64((1 << _SLOTS) - 1)).astype(np.int64)]
            taken = np.flatnonzero(at >= 0)
            at = at[taken]
            hit = keys[at] == here[taken]
            place = taken if left is None else left[taken]
            rows.append(place[hit])
            found.append(at[hit])
            left = place[~hit]
            if not len(left):
                break
        return (rows[0], found[0]) if len(rows) == 1 else (np.concatenate(rows), np.concatenate(found))

    def _edges(self, words: list[bytes], length: int):
        """For words of one length, (begin, end, rows, pieces) of all pieces in them."""
        span = SpanHash(np.frombuffer(b"".join(words), np.uint8))
        upto, scale = span.columns(len(words), length)
        for end in range(1, length + 1):
            for size in self.lengths:
                if size > end:
                    break
                rows, piece = self._pieces(mix((upto[end] - upto[end - size]) * scale[end - size]))
                if len(rows):
                    yield end - size, end, rows, piece

    def _together(self, words: list[bytes], length: int, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        forward = np.full((length + 1, len(words)), -np.inf)
        forward[0] = 0.0
        edges = []
        for begin, end, rows, piece in self._edges(words, length):
            forward[end, rows] = np.logaddexp(forward[end, rows], forward[begin, rows] + self.logs[piece])
            if counts is not None:
                edges.append((begin, end, rows, piece))
        if counts is not None:
            backward = np.full((length + 1, len(words)), -np.inf)
            backward[length] = 0.0
            shares = []
            for begin, end, rows, piece in reversed(edges):
                through = self.logs[piece] + backward[end, rows]
                backward[begin, rows] = np.logaddexp(backward[begin, rows], through)
                shares.append(np.exp(forward[begin, rows] + through - forward[length, rows]) * counts[rows])
            used = np.concatenate([piece for _, _, _, piece in reversed(edges)])
            expected += np.bincount(used, np.concatenate(shares), minlength=len(expected))
        return forward[length]

    def _alone(self, word: bytes, count: float | None, expected: np.ndarray | None) -> float:
        n = len(word)
        forward = np.full(n + 1, -np.inf)
        forward[0] = 0.0
        edges = []
        for end in range(1, n + 1):
            for size in self.lengths:
                if size > end:
                    break
                piece = self.index.get(word[end - size : end])
                if piece is not None:
                    forward[end] = np.logaddexp(forward[end], forward[end - size] + self.logs[piece])
                    if count is not None:
                        edges.append((end - size, end, piece))
        if count is not None:
            backward = np.full(n + 1, -np.inf)
            backward[n] = 0.0
            for begin, end, piece in reversed(edges):
                through = self.logs[piece] + backward[end]
                backward[begin] = np.logaddexp(backward[begin], through)
                expected[piece] += np.exp(forward[begin] + through - forward[n]) * count
        return float(forward[n])

    def run(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word, expected pieces of all words by their counts)."""
        out = np.zeros(len(words))
        expected = np.zeros(len(self.logs))
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word) + 1, []).append(i)
        for length, rows in by_length.items():
            marked = [b" " + words[i] for i in rows]
            if length <= TOGETHER_BYTES:
                out[rows] = self._together(marked, length, None if counts is None else counts[rows], expected)
            else:
                for i, word in zip(rows, marked, strict=True):
                    out[i] = self._alone(word, None if counts is None else counts[i], expected)
        return out, expected


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, total): from (text, held out), partial counts in texts learned from and in all."""
    train: Counter[bytes] = Counter()
    other: Counter[bytes] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        for words, learned in ((train, True), (other, False)):
            if words:
                total = pa.array(list(words.values()), pa.int64())
                n = total if learned else pa.array(np.zeros(len(words), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), n, total], names=["word", "n", "total"])
                words.clear()

    for batch in batches:
        for text, held in zip(pc.cast(batch.column(0), pa.binary()), batch.column(1).to_pylist(), strict=True):
            (other if held else train).update(words_of(text.as_py()))
            if len(train) + len(other) > HELD_WORDS:
                yield from out()
    yield from out()


def _rows_at_once(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass(frozen=True)
class Model:
    """Word counts (word, n, total, log) with the words' log10 probabilities, and the corpus's totals."""

    words: DataFrame
    lattice: Lattice
    n_tokens: int
    n_words: int
    n_ends: int
    discount: float

    def base(self, n: np.ndarray) -> np.ndarray:
        return base(n, self.n_tokens, self.n_words)

    def end(self) -> float:
        return float(whole(np.array([float(self.n_ends)]), np.log([self.lattice.end]), self.n_tokens, self.n_words, self.discount)[0])


def base(n: np.ndarray, n_tokens: int, n_words: int) -> np.ndarray:
    return np.log10((n + 0.5) / (n_tokens + 0.5 * (n_words + 1)))


def whole(n: np.ndarray, logs: np.ndarray, n_tokens: int, n_words: int, discount: float) -> np.ndarray:
    """log10 probabilities of tokens with counts ``n``: as one piece, or in pieces with natural log probabilities ``logs``."""
    if not n_tokens:
        return logs / LN10
    seen = np.maximum(n - discount, 0.0) / n_tokens
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(seen), np.log(discount * n_words / n_tokens) + logs) / LN10


def learn(docs: DataFrame, held_out: Column, vocabulary_path: str, rounds: int = ROUNDS) -> Model:
    """Learns from the texts of ``docs`` that are not held out; words of the others are listed too, with n = 0."""
    rows = docs.select("text", held_out.alias("held"))
    words = rows.mapInArrow(_count_words, "word binary, n long, total long").groupBy("word")
    words = materialise(words.agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "word-counts")
    ends = rows.where(~F.col("held")).count()
    sums = words.agg(
        F.sum("n").alias("n"), *(F.count_if(c).alias(a) for c, a in ((F.col("n") > 0, "words"), (F.col("n") == 1, "once"), (F.col("n") == 2, "twice")))
    ).first()
    n_tokens, n_words = (sums["n"] or 0) + ends, (sums["words"] or 0) + (ends > 0)
    discount = min(max(sums["once"] / (sums["once"] + 2 * sums["twice"]), 0.1), 0.9) if sums["once"] else 0.5
    first = vocabulary(vocabulary_path)
    pieces = list(first)
    prior = np.exp(np.array(list(first.values())))
    inner = np.array([not p.startswith(b" ") for p in pieces])
    lattice = Lattice(pieces, np.log(prior), 0.5)
    spark = docs.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(lattice)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            recursion = Recursion(sent.value)
            expected = np.zeros(len(sent.value.pieces))
            for batch in _rows_at_once(batches, 20_000):
                expected += recursion.run(batch.column(0).to_pylist(), np.ones(batch.num_rows))[1]
            used = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(expected[used])], names=["piece", "n"])

        known = words.where("n > 0").select("word")
        found = known.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        weight = PRIOR_PIECES * prior
        weight[found["piece"].to_numpy(int)] += found["n"].to_numpy(float)
        # One end against all distinct words; a word stops where a piece with a blank or the end would follow.
        total = weight.sum() + 1.0
        stop = 1.0 - weight[inner].sum() / total
        lattice = Lattice(pieces, np.log(weight / total), float(1.0 / total / stop))
        sent.unpersist()
    sent = spark.sparkContext.broadcast(lattice)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recursion = Recursion(sent.value)
        for batch in _rows_at_once(batches, 20_000):
            logs = recursion.run(batch.column(0).to_pylist())[0]
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            logs = whole(n, logs, n_tokens, n_words, discount)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs)], names=["word", "n", "total", "log"])

    scores = materialise(words.mapInArrow(scored, "word binary, n long, total long, log double"), "word-scores")
    return Model(scores, lattice, n_tokens, n_words, ends, discount)


def score(docs: DataFrame, held_out: Column, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Null texts count as empty: their only token is the end. The texts need not be those of ``learn``.
    """
    hot = model.words.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("total"), "word").limit(HOT_WORDS)
    hot = hot.select("word", "n", "log").toArrow()
    table = {w: i for i, w in enumerate(hot.column(0).to_pylist())}
    n = hot.column(1).to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((table, model.base(n.astype(float)), n > 0, hot.column(2).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bases, known, logs = sent.value
        for batch in _rows_at_once(batches, 512):
            out = {c: [] for c in ("n_tokens", "n_known", "base", "log", "rest", "times")}
            for text in pc.cast(batch.column(2), pa.binary()):
                words = words_of(text.as_py())
                at = np.fromiter((table.get(w, -1) for w in words), dtype=np.int64, count=len(words))
                hit = at[at >= 0]
                rest = Counter(w for w, i in zip(words, at, strict=True) if i < 0) if len(hit) < len(words) else {}
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(int(known[hit].sum()))
                out["base"].append(float(bases[hit].sum()))
                out["log"].append(float(logs[hit].sum()))
                out["rest"].append(list(rest))
                out["times"].append(list(rest.values()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))],
                names=["doc_id", "held_out", *out],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double, rest array<binary>, times array<long>"
    rows = materialise(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), "x.times")
    lattice = docs.sparkSession.sparkContext.broadcast(model.lattice)
    totals = (model.n_tokens, model.n_words, model.discount)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, known, base, log) of the joined words; words that no text of the corpus has get their lattice's value here."""
        recursion = None
        for batch in _rows_at_once(batches, 20_000):
            n = pc.fill_null(batch.column(3), 0).to_numpy(zero_copy_only=False).astype(float)
            logs = batch.column(4).to_numpy(zero_copy_only=False).copy()
            new = np.flatnonzero(np.isnan(logs))
            if len(new):
                recursion = recursion or Recursion(lattice.value)
                logs[new] = whole(n[new], recursion.run(batch.column(1).take(pa.array(new)).to_pylist())[0], *totals)
            times = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(times * (n > 0)), pa.array(times * base(n, *totals[:2])), pa.array(times * logs)],
                names=["row", "known", "base", "log"],
            )

    joined = rest.join(model.words.select("word", "n", "log"), "word", "left").select("row", "word", "times", "n", "log")
    counted = joined.mapInArrow(fill, "row long, known long, base double, log double").groupBy("row").agg(
        F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("log").alias("more_log")
    )
    end_base = float(model.base(np.array(float(model.n_ends))))
    zero = F.lit(0.0)
    return rows.drop("rest", "times").join(counted, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(model.n_ends > 0)).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + end_base).alias("base_score"),
        (F.col("log") + F.coalesce("more_log", zero) + model.end()).alias("score"),
    )
