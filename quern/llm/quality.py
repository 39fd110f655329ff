"""Quality classifier on supervised subword embeddings.

A text's features are its words (runs without ASCII white space), whether each word is that one or two places
before, and the words' byte n-grams with the borders of words, hashed into buckets. Each bucket has a learned vector; a text is the average of its features' vectors, and
a softmax layer gives the labels' probabilities. Both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled texts. As the output is linear in the average, a trained bucket is one number, and a text's
score the average of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import unused
from quern.llm.text_bytes import SpanHash, chunks, word_spans

ORDERS = (3, 4, 5)
DISTANCES = (1, 2)
BUCKETS = 1 << 16
DIMENSIONS = 16
# At most so many labelled texts of each label are learned from, those with the smallest hashes of their ids.
TRAIN_ROWS = 2500
EPOCHS, RATE, SEED = 8, 0.5, 7

_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[~_SOLID] = 0x20


def features(column: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For each chunk of texts one (buckets, bounds) for each kind of feature.

    ``bounds`` has where each text's features begin among the buckets, and at last where they end.
    """
    for _, data, borders in chunks(column):
        kinds = []
        starts, ends, first = word_spans(data, borders, _SOLID)
        words = SpanHash(data)(starts, ends)
        kinds.append(((words >> np.uint64(48)).astype(np.int32), first))
        owner = np.repeat(np.arange(len(borders) - 1), np.diff(first))
        for back in DISTANCES:
            same = np.zeros(len(words), dtype=np.int32)
            same[back:] = (words[back:] == words[:-back]) & (owner[back:] == owner[:-back])
            kinds.append((2 * back + same, first))
        # A blank between texts stands for the borders of their first and last words.
        n_texts = len(borders) - 1
        padded = np.full(len(data) + n_texts + 1, 0x20, dtype=np.uint8)
        owner = np.repeat(np.arange(n_texts), np.diff(borders))
        padded[np.arange(len(data)) + owner + 1] = _BLANK[data]
        begins = borders + np.arange(n_texts + 1)
        n = len(padded)
        wide = padded.astype(np.uint32)
        blanks = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(padded == 0x20, out=blanks[1:])
        for order in ORDERS:
            count = n - order + 1
            if count <= 0:
                continue
            code = np.full(count, order, dtype=np.uint32)
            for k in range(order):
                code = code * np.uint32(0x01000193) ^ wide[k : k + count]
            code *= np.uint32(0x9E3779B1)
            # Blanks only at the ends, and then within one text.
            inner = np.flatnonzero(blanks[order - 1 : order - 1 + count] == blanks[1 : 1 + count])
            kinds.append(((code[inner] >> np.uint32(16)).astype(np.int32), np.searchsorted(inner, begins)))
        yield kinds


@dataclass(frozen=True)
class Model:
    """A number for each bucket and the bias of the logit of label 1."""

    weights: np.ndarray
    bias: float


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, label, distinct buckets, counts) of labelled texts."""
    for batch in batches:
        found, counts = [], []
        for kinds in features(batch.column(2)):
            for i in range(len(kinds[0][1]) - 1):
                seen, n = np.unique(np.concatenate([b[f[i] : f[i + 1]] for b, f in kinds]), return_counts=True)
                found.append(seen.astype("<u4").tobytes())
                counts.append(n.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(counts, pa.binary())],
            names=["place", "label", "buckets", "counts"],
        )


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Plain SGD, one text at a time in a seeded order, with a rate that falls to zero."""
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, done = EPOCHS * max(len(bags), 1), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(bags)):
            buckets, share = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(DIMENSIONS, np.float32)
            logits = output @ hidden + bias
            probability = np.exp(logits - logits.max())
            probability /= probability.sum()
            probability[labels[i]] -= 1
            back = probability @ output
            output -= rate * np.outer(probability, hidden)
            bias -= rate * probability
            if len(buckets):
                # The average's gradient, not divided by the number of features, as each of them is seen in it.
                vectors[buckets] -= (rate * len(buckets) ** 0.5) * np.outer(share, back)
    return Model(vectors @ (output[1] - output[0]), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    Quality 1 is label 1, anything else but null label 0; of several labels of an id the smallest counts. The sample has
    ``train_rows`` texts of either label at most; the bias then returns to the labels' true shares.
    """
    known = labels.where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64("doc_id", F.lit("quality"))
    picked = [known.where(F.col("label") == v).select("doc_id", "label", draw.alias("place")).orderBy("place", "doc_id").limit(train_rows) for v in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("place", "label", "text")
    rows = rows.mapInArrow(_bags, "place long, label int, buckets binary, counts binary").toPandas()
    rows = rows.sort_values(["place", "buckets"], kind="stable")
    bags = []
    for buckets, counts in zip(rows["buckets"], rows["counts"], strict=True):
        n = np.frombuffer(counts, "<u4").astype(np.float32)
        bags.append((np.frombuffer(buckets, "<u4").astype(np.int32), n / max(n.sum(), 1)))
    values = rows["label"].to_numpy(int)
    model = train(bags, values)
    used = np.bincount(values, minlength=2)
    if used.all():
        shift = np.log(totals[1] / totals[0]) - np.log(used[1] / used[0])
        model = Model(model.weights, model.bias + float(shift))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` except the text's, then ``score``: the probability of label 1.

    Texts without features, null ones too, get what the bias alone says.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    kept = [c for c in docs.columns if c != text]
    name = unused(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            values = [np.zeros(0)]
            for kinds in features(batch.column(len(kept))):
                total, number = 0.0, 0
                for buckets, first in kinds:
                    upto = np.zeros(len(buckets) + 1)
                    np.cumsum(weights[buckets], dtype=np.float64, out=upto[1:])
                    total = total + upto[first[1:]] - upto[first[:-1]]
                    number = number + np.diff(first)
                values.append(total / np.maximum(number, 1))
            logit = np.clip(np.concatenate(values) + bias, -500, 500)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(1 / (1 + np.exp(-logit)))], names=[*kept, name]
            )

    return docs.select(*kept, text).mapInArrow(run, docs.select(*kept).schema.add(name, "double"))
