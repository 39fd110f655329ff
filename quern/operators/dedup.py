"""Exact de-duplication that keeps the first occurrence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def dedup_exact(
    df: DataFrame, text: str = "text", order: Sequence[str] = ("seq",), carry: bool = False
) -> DataFrame:
    """The first row, by ``order``, of every distinct text; null text counts as one value.

    ``order`` must identify the rows. Only digests and order columns are aggregated, so each map task sends at
    most one short row per text however many copies there are; the survivors then pick their rows, for which
    ``df`` is computed twice. With ``carry`` whole rows are aggregated in one pass, which suits few rows that are dear
    to compute.
    """
    if carry:
        place = F.struct(*order) if len(order) > 1 else F.col(order[0])
        first = F.min_by(F.struct(*df.columns), place)
        return df.groupBy(F.sha2(text, 256).alias("_digest")).agg(first.alias("_row")).select("_row.*")
    rank = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    firsts = df.groupBy(F.sha2(text, 256).alias("_digest")).agg(F.min(rank).alias("_first"))
    firsts = firsts.select([F.col(f"_first._{i}").alias(f"_key{i}") for i in range(len(order))])
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(firsts[f"_key{i}"]) for i, c in enumerate(order)])
    return df.join(firsts, same, "left_semi")


def dedup_report(df: DataFrame, key: str, order: str = "seq", lower: bool = False) -> DataFrame:
    """Every row with ``is_duplicate``: an earlier row has the same stripped key.

    The first ``order`` value per key is aggregated; rows then meet the survivors on ``order``,
    which is unique, instead of on the key, whose groups may be arbitrarily large.
    """
    value = T.strip(F.col(key))
    if lower:
        value = F.lower(value)
    survivors = (
        df.groupBy(F.sha2(value, 256).alias("_digest"))
        .agg(F.min(order).alias(order))
        .select(order, F.lit(False).alias("_dup"))
    )
    marked = df.join(survivors, order, "left")
    return marked.select(*df.columns, F.coalesce("_dup", F.lit(True)).alias("is_duplicate"))
