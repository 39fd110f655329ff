"""Token arrays of fixed length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved ids, the label of positions a loss ignores, and default lengths.
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2
IGNORED_LABEL = -100
TRAINING_LENGTH = 256
CLASSIFICATION_LENGTH = 128
QUICK_RUN_LENGTH = 512


def words(text: Column, first: int | None = None) -> Column:
    """Lower-cased runs of ASCII letters and digits; of all of them or the ``first`` ones.

    With a number the text is split no further than that; there may be an empty piece before the words and the
    rest of the text after them.
    """
    if first is None:
        return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    return F.slice(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+", first + 2), ""), 1, first)


def pad(ids: Column, max_length: int, pad_id: int = PAD_ID) -> Column:
    """Cut to ``max_length``, then fill up with ``pad_id``."""
    kept = F.slice(ids, 1, max_length)
    return F.concat(kept, F.array_repeat(F.lit(pad_id), F.lit(max_length) - F.size(kept)))


def attention_mask(ids: Column, max_length: int) -> Column:
    """One for every real token, zero for every padded position."""
    n = F.least(F.size(ids), F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))


def labels(ids: Column, max_length: int, mode: str = "copy", pad_id: int = PAD_ID) -> Column:
    """Labels of unpadded ``ids``: a padded copy, or (``masked``) padding set to be ignored.

    ``masked`` goes by the value, as a reader of the padded array would: a real token with the
    pad id is ignored as well.
    """
    padded = pad(ids, max_length, pad_id)
    if mode == "copy":
        return padded
    if mode == "masked":
        return F.transform(padded, lambda t: F.when(t == pad_id, F.lit(IGNORED_LABEL)).otherwise(t))
    raise ValueError(f"unknown mode: {mode!r}")


def sequence_budget(prefix_tokens: int = 0, max_length: int = TRAINING_LENGTH) -> int:
    return prefix_tokens + max_length
