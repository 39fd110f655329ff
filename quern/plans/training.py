"""Assemble training and classification sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import tokens as K
from quern.operators.encoding import VOCABULARY_SIZE, add_prefix, build_vocab, encode
from quern.operators.flagging import filter_banned
from quern.operators.mixing import concat_sources
from quern.operators.ordering import split_exact
from quern.session import materialise

TEST_SHARE = 0.1
SEED = 42


def select_training(
    dfs: Sequence[DataFrame | None], banned: Sequence[str] = (), instruction: str = "", enabled: bool | None = None
) -> DataFrame:
    """Concatenated sources without banned texts, each text behind the instruction."""
    return add_prefix(filter_banned(concat_sources(dfs), banned), instruction, enabled)


def prefix_tokens(instruction: str) -> int:
    """Words of the instruction by the rule of ``tokens.words``."""
    lowered = "".join(c if c.isascii() and c.isalnum() else " " for c in instruction.lower())
    return len(lowered.split())


def assemble_training(
    dfs: Sequence[DataFrame | None],
    banned: Sequence[str] = (),
    instruction: str = "",
    max_length: int = K.TRAINING_LENGTH,
    vocab: DataFrame | None = None,
    vocabulary_size: int = VOCABULARY_SIZE,
    seed: int = SEED,
    row_id: str = "seq",
    tokenizer: Callable[[Column], Column] | None = None,
    enabled: bool | None = None,
) -> DataFrame:
    """Token arrays of all sources with ``split``; lengths allow for the instruction's words.

    ``row_id`` is unique inside every source; with ``source_rank`` it identifies a row. The ids
    of the kept rows are stored, so that cutting off the test rows reads no texts.
    """
    rows = select_training(dfs, banned, instruction, enabled)
    rows = rows.withColumn("_id", F.concat_ws("|", "source_rank", row_id))
    if vocab is None and tokenizer is None:
        vocab = build_vocab(rows, vocabulary_size)
    length = K.sequence_budget(prefix_tokens(instruction), max_length)
    place = ("source_rank", row_id)
    ids = materialise(rows.select(*place), "ids")
    marked = split_exact(rows, place, TEST_SHARE, seed, ids)
    return encode(marked, vocab, length, "copy", row_id="_id", tokenizer=tokenizer).drop("_id")


def assemble_classification(
    dfs: Sequence[DataFrame | None],
    label_col: str,
    max_length: int = K.CLASSIFICATION_LENGTH,
    vocab: DataFrame | None = None,
    vocabulary_size: int = VOCABULARY_SIZE,
    seed: int = SEED,
    row_id: str = "seq",
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Token arrays with a class in ``labels`` and ``split``; texts are neither filtered nor prefixed."""
    rows = concat_sources(dfs).withColumn("_id", F.concat_ws("|", "source_rank", row_id))
    if vocab is None and tokenizer is None:
        vocab = build_vocab(rows, vocabulary_size)
    place = ("source_rank", row_id)
    ids = materialise(rows.select(*place), "ids")
    marked = split_exact(rows, place, TEST_SHARE, seed, ids)
    coded = encode(marked, vocab, max_length, None, row_id="_id", tokenizer=tokenizer)
    return coded.drop("_id").withColumnRenamed(label_col, "labels")
