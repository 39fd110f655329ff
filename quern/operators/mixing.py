"""Concatenating sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ordering import first_rows, shuffle_rows

MAX_PER_SOURCE = 200


def concat_sources(dfs: Sequence[DataFrame | None], rank: str = "source_rank") -> DataFrame:
    """All rows of all sources, nothing removed; absent sources are None and none at all is an error.

    Columns meet by name and missing ones are null; ``rank`` tells a row's place in the list.
    """
    present = [df for df in dfs if df is not None]
    if not present:
        raise ValueError("no source to concatenate")
    ranked = [df.withColumn(rank, F.lit(i)) for i, df in enumerate(present)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def mix_sources(
    dfs: Sequence[DataFrame],
    max_per_source: int = MAX_PER_SOURCE,
    shuffle: bool = False,
    seed: int = 42,
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """The first rows of every source, in source order or a seeded random order.

    ``order`` numbers the rows inside a source. The cap on the whole mix is the per-source cap
    times the number of sources, which the sources together never exceed once each is cut.
    """
    if not dfs:
        raise ValueError("no source to mix")
    mixed = concat_sources([first_rows(df, max_per_source, order) for df in dfs])
    return order_and_cap(mixed, max_per_source * len(dfs), shuffle, seed, order)


def order_and_cap(
    mixed: DataFrame, cap: int, shuffle: bool, seed: int, order: Sequence[str] = ("seq",)
) -> DataFrame:
    """At most ``cap`` rows of a mix, after the shuffle where there is one."""
    places = ("source_rank", *order)
    return first_rows(mixed, cap, places, seed if shuffle else None)


def shuffled(mixed: DataFrame, seed: int, order: Sequence[str] = ("seq",)) -> DataFrame:
    return shuffle_rows(mixed, ("source_rank", *order), seed)
