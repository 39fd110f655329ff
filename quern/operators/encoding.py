"""Corpus vocabulary and token id arrays."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import tokens as K

VOCABULARY_SIZE = 32_000
# A vocabulary up to this many words and bytes goes to every task; a larger one is joined.
BROADCAST_WORDS = 500_000
BROADCAST_BYTES = 64 << 20


def build_vocab(df: DataFrame, size: int = VOCABULARY_SIZE, text: str = "text") -> DataFrame:
    """The ``size`` most frequent words: token, count, token_id; ties in alphabetical order.

    Counts are combined before the shuffle. Numbering runs over the ``size`` kept rows only.
    """
    counts = (
        df.select(F.explode(K.words(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("count"))
    )
    top = counts.orderBy(F.desc("count"), "token").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "token"))
    return top.withColumn("token_id", (rank - 1 + K.FIRST_ID).cast("int"))


def _lookup(vocabulary: pa.Table) -> Callable[[Column], Column]:
    """Words to ids, a batch at a time, on Arrow's own hash table."""
    tokens = vocabulary.column("token").combine_chunks()
    ids = vocabulary.column("token_id").combine_chunks().cast(pa.int32())

    @F.arrow_udf("array<int>")
    def lookup(words: pa.Array) -> pa.Array:
        flat = words.flatten()
        index = pc.index_in(flat, value_set=tokens.cast(flat.type))
        found = pc.fill_null(ids.take(index), K.UNKNOWN_ID)
        lengths = pc.fill_null(pc.list_value_length(words), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, found)

    return lookup


def token_ids(
    df: DataFrame,
    vocab: DataFrame,
    max_length: int,
    text: str = "text",
    row_id: str = "seq",
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """Add ``ids``: the ids of the first ``max_length`` words, unpadded (counts the vocabulary).

    A vocabulary beyond ``broadcast_words`` words or BROADCAST_BYTES is joined word by word on a shuffle; adaptive
    execution splits the partitions of frequent words. The arrays then return by ``row_id``, so repeated
    ids are an error.
    """
    words = K.words(F.coalesce(F.col(text), F.lit("")), max_length)
    size = vocab.agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("bytes")).first()
    if size["n"] <= broadcast_words and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return df.withColumn("ids", _lookup(vocab.select("token", "token_id").toArrow())(words))
    repeated = df.groupBy(row_id).agg(F.count("*").alias("_n")).filter("_n > 1").take(1)
    if repeated:
        raise ValueError(f"{row_id} {repeated[0][row_id]!r} is not unique")
    placed = df.select(F.col(row_id), F.posexplode(words).alias("_pos", "token"))
    found = placed.join(vocab.select("token", "token_id").hint("merge"), "token", "left").select(
        row_id, F.struct("_pos", F.coalesce("token_id", F.lit(K.UNKNOWN_ID)).alias("id")).alias("_at")
    )
    arrays = found.groupBy(row_id).agg(F.array_sort(F.collect_list("_at"))["id"].alias("_ids"))
    joined = df.join(arrays, row_id, "left")
    none = F.array().cast("array<int>")
    return joined.select(*df.columns, F.coalesce("_ids", none).alias("ids"))


def token_arrays(
    df: DataFrame, max_length: int, label_mode: str | None = "copy", pad_id: int = K.PAD_ID
) -> DataFrame:
    """Replace ``ids`` by ``input_ids``, ``attention_mask`` and, unless None, ``labels``."""
    ids = F.col("ids")
    made = {
        "input_ids": K.pad(ids, max_length, pad_id),
        "attention_mask": K.attention_mask(ids, max_length),
    }
    if label_mode is not None:
        made["labels"] = K.labels(ids, max_length, label_mode, pad_id)
    return df.withColumns(made).drop("ids")


def encode(
    df: DataFrame,
    vocab: DataFrame | None,
    max_length: int,
    label_mode: str | None = "copy",
    text: str = "text",
    row_id: str = "seq",
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Token arrays of every text: cut, padded and masked to ``max_length``.

    ``tokenizer`` (a vectorised UDF from text to ``array<int>``) replaces the vocabulary.
    """
    if tokenizer is not None:
        rows = df.withColumn("ids", tokenizer(F.col(text)))
    else:
        rows = token_ids(df, vocab, max_length, text, row_id)
    return token_arrays(rows, max_length, label_mode)


def add_prefix(df: DataFrame, instruction: str, enabled: bool | None = None, text: str = "text") -> DataFrame:
    """Put ``instruction`` before every text; on by default when there is one."""
    wanted = bool(instruction) if enabled is None else enabled
    if not (wanted and instruction):
        return df
    return df.withColumn(text, F.concat(F.lit(instruction), F.coalesce(F.col(text), F.lit(""))))
