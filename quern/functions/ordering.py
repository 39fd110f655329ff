"""Reproducible random order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int, *ids: str) -> Column:
    """A key that depends on the seed and the row's id only, never on the partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))
