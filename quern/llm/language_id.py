"""Language ID by multilingual mixture inference.

Every language has a distribution over hashed byte n-grams, learned from labelled texts. A text is a
mixture of languages: expectation-maximisation estimates the proportions from the n-gram likelihoods,
and the set of languages is the one with the best penalised likelihood among the nested sets of the
most likely languages. Runs as one pass of Arrow batches; the model (languages x buckets) is the
only data sent to the tasks and bounded by ``MAX_LANGUAGES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import unused
from quern.llm.text_bytes import chunks, slices

UNKNOWN = "und"
ORDERS = (2, 4)
BUCKETS = 1 << 16
MAX_LANGUAGES = 128
# At most about so many texts of each language are learned from, chosen by a hash of their id.
TRAIN_ROWS = 20_000
ROUNDS = 15
# Overlapping n-grams repeat the same evidence: a byte stands in this many of them.
REPEATS = sum(ORDERS)
# An n-gram that no language has is no evidence for any of them.
SMOOTHING = 0.5
LETTER = r"\p{L}"

_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[b for b in range(128) if not (0x61 <= b < 0x7B)]] = 0x20


def grams(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the buckets of its n-grams: lower case, other ASCII than letters as one space."""
    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(column, "")), " ", "")
    for _, data, borders in chunks(padded):
        spaced = _SPACES[data]
        keep = np.ones(len(spaced), dtype=bool)
        keep[1:] = (spaced[1:] != 0x20) | (spaced[:-1] != 0x20)
        keep[borders[:-1]] = True
        place = np.zeros(len(spaced) + 1, dtype=np.int64)
        np.cumsum(keep, out=place[1:])
        dense = np.concatenate([spaced[keep], np.zeros(max(ORDERS), np.uint8)]).astype(np.uint32)
        ends = place[borders]
        n = int(ends[-1])
        codes = []
        for order in ORDERS:
            code = np.full(n, order, dtype=np.uint32)
            for k in range(order):
                code = code * np.uint32(0x01000193) ^ dense[k : k + n]
            code *= np.uint32(0x9E3779B1)
            codes.append((code >> np.uint32(16)).astype(np.int32))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield np.concatenate([code[a : max(a, b - order + 1)] for order, code in zip(ORDERS, codes, strict=True)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, 0):
        languages = batch.column(1).to_pylist()
        for language, buckets in zip(languages, grams(batch.column(0)), strict=True):
            if language not in totals:
                totals[language] = np.zeros(BUCKETS, dtype=np.int64)
            totals[language] += np.bincount(buckets, minlength=BUCKETS)
    for language, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])],
            names=["lang", "bucket", "n"],
        )


def learn(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities) from columns ``doc_id``, ``text`` and ``lang``.

    Rows without a text or a language are no examples. Of languages with more than ``train_rows``
    texts a part is used whose hash of the id is small, so reruns learn the same.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).take(MAX_LANGUAGES + 1)}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model would outgrow what may be sent to tasks")
    if not sizes:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    share = F.element_at(
        F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, train_rows / n))]), F.col("lang")
    )
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("lang")), F.lit(1 << 20))
    sample = labelled.where(draw < share * (1 << 20)).select("text", "lang")
    counted = sample.mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    place = {name: i for i, name in enumerate(languages)}
    np.add.at(counts, (rows["lang"].map(place).to_numpy(int), rows["bucket"].to_numpy(int)), rows["n"].to_numpy(float))
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _proportions(likely: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """EM over one text: proportions of the rows of ``likely`` and the log likelihood."""
    total = n.sum()
    share = np.full(len(likely), 1.0 / len(likely))
    if len(likely) > 1:
        for _ in range(ROUNDS):
            new = share * (likely @ (n / (share @ likely))) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
    return share, float(n @ np.log(share @ likely))


def infer(buckets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chosen languages, their proportions), the largest proportion first."""
    seen, n = np.unique(buckets, return_counts=True)
    logs = model[:, seen].astype(np.float64)
    logs -= logs.max(axis=0)
    likely = np.exp(logs) + 1e-12
    full, _ = _proportions(likely, n)
    single = logs @ n
    order = sorted(range(len(model)), key=lambda i: (-full[i], -single[i], i))
    penalty = 0.5 * np.log(max(n.sum() / REPEATS, 2.0))
    best = int(np.argmax(single))
    chosen, shares, value = np.array([best]), np.ones(1), float(n @ np.log(likely[best])) / REPEATS
    for k in range(2, len(order) + 1):
        if full[order[k - 1]] < 0.01:
            break
        share, likelihood = _proportions(likely[order[:k]], n)
        gain = likelihood / REPEATS - penalty * (k - 1)
        if gain <= value:
            break
        chosen, shares, value = np.array(order[:k]), share, gain
    by_share = np.argsort(-shares, kind="stable")
    return chosen[by_share], shares[by_share]


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep_text: bool = False
) -> DataFrame:
    """All columns of ``docs``, the text's only if asked for, then lang_pred, score, langs and shares.

    ``lang_pred`` is the language with the largest proportion, ``score`` that proportion. A text that is
    null or has no letter, and any text where no language could be learned, is ``und`` with score 0.
    New columns that clash with given ones get an underscore before their names.
    """
    names, table = model
    sent = docs.sparkSession.sparkContext.broadcast((names, table))
    kept = [c for c in docs.columns if keep_text or c != text]
    at = kept.index(text) if keep_text else len(kept)
    new = [unused(docs, c) for c in ("lang_pred", "score", "langs", "shares")]
    schema = docs.select(*kept).schema
    for name, kind in zip(new, ("string", "double", "string", "string"), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs = sent.value
        for batch in slices(batches, at):
            texts = batch.column(at)
            letters = pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_pylist()
            found = []
            for has, buckets in zip(letters, grams(texts), strict=True):
                if not has or not languages:
                    found.append((UNKNOWN, 0.0, "", ""))
                    continue
                chosen, shares = infer(buckets, logs)
                shares = np.clip(shares / shares.sum(), 0.0, 1.0)
                listed = [languages[i] for i in chosen]
                found.append((listed[0], float(shares[0]), ",".join(listed), ",".join(f"{s:.4f}" for s in shares)))
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(kept)],
                    *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.string(), pa.string()), strict=True)),
                ],
                names=[*kept, *new],
            )

    return docs.select(*kept, *([] if keep_text else [text])).mapInArrow(run, schema)


def has_letter(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.rlike(LETTER), F.lit(False))
