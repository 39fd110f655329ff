"""Order, limits and splits without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.ordering import shuffle_key
from quern.session import materialise

# Limits up to this many rows are left to Spark's top-k, whose last step is one task.
TOP_K_ROWS = 100_000
SALTS = 64


def assign_seq(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Number the rows 0, 1, 2, ... by ``order``; sorts and writes one table (an action).

    Each sorted partition is counted; the running total of the counts, one row per partition,
    is added to the position inside the partition.
    """
    placed = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    # A written table fixes the partition boundaries, which sampling may move between runs.
    table = materialise(placed, "ordered")
    part = F.shiftright("_mid", 33)
    row = F.col("_mid").bitwiseAND((1 << 33) - 1)
    counts = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    numbered = table.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select((F.col("_offset") + row).alias(name), *df.columns)


def head_per_source(
    df: DataFrame, n: int, source: str | Sequence[str], order: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """The first ``n`` rows of every source.

    For small ``n`` Spark prunes each map partition to ``n`` rows per source before the shuffle.
    Beyond the limit of that rule every source is first cut to ``n`` rows in each of ``salts``
    slices, so that a source with most of the rows is not ranked by one task.
    """
    by = [source] if isinstance(source, str) else list(source)
    spark = df.sparkSession

    def cut(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)

    if n > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        slices = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(salts)))
        df = cut(slices, [*by, "_slice"]).drop("_rank", "_slice")
    return cut(df, by).drop("_rank")


def key_cut(df: DataFrame, key: Column, rows: Column | int, total_name: str = "_total") -> Column:
    """The ``rows``-th smallest value of a hex digest ``key``, as a scalar subquery.

    A histogram over the first four digits (at most 65,536 rows) finds the one bucket with the
    cut; only that bucket's keys are ranked. ``rows`` may refer to the row count ``total_name``.
    """
    wanted = F.lit(rows) if isinstance(rows, int) else rows
    keys = df.select(key.alias("_key")).withColumn("_bucket", F.substring("_key", 1, 4))
    everything = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    so_far = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        keys.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumns(
            {total_name: F.sum("_n").over(everything), "_upto": F.sum("_n").over(so_far)}
        )
        .withColumn("_wanted", F.least(wanted, F.col(total_name)))
        .filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
        .select("_bucket", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_nth"))
    )
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    return (
        keys.join(F.broadcast(histogram), "_bucket")
        .withColumn("_position", position)
        .filter(F.col("_position") == F.col("_nth"))
        .select("_key")
        .scalar()
    )


def shuffle_rows(df: DataFrame, order: Sequence[str], seed: int = 42) -> DataFrame:
    """All rows in a seeded random order, by a distributed range sort."""
    key = shuffle_key(seed, *order)
    return df.withColumn("shuffle_key", key).orderBy("shuffle_key", *order)


def first_rows(
    df: DataFrame,
    n: int,
    order: Sequence[str],
    seed: int | None = None,
    top_k_rows: int = TOP_K_ROWS,
) -> DataFrame:
    """The first ``n`` rows by ``order``, or by the seeded random order where a seed is given.

    Spark's own top-k merges its ``n`` rows in one task. A larger ``n`` takes the numbered rows
    of a distributed sort (which writes a table), or those up to the ``n``-th smallest key.
    """
    if seed is None and n <= top_k_rows:
        return df.orderBy(*order).limit(n)
    if seed is None:
        numbered = assign_seq(df, order, "_number")
        return numbered.filter(F.col("_number") < n).drop("_number")
    if n <= top_k_rows:
        return shuffle_rows(df, order, seed).limit(n)
    cut = key_cut(df, shuffle_key(seed, *order), n)
    return shuffle_rows(df.filter(shuffle_key(seed, *order) <= cut), order, seed)


def split_exact(
    df: DataFrame,
    order: Sequence[str],
    test: float = 0.1,
    seed: int = 42,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: exactly ``ceil(test * rows)`` rows are ``test``, the others ``train``.

    ``order`` must identify the rows. Only the ids are read to find the cut; the rows themselves
    are not shuffled. Where computing the rows is dear, a stored table of their ``ids`` saves
    computing them for the cut.
    """
    key = shuffle_key(seed, *order)
    cut = key_cut(df if ids is None else ids, key, F.ceil(F.lit(test) * F.col("_total")).cast("long"))
    return df.withColumn("split", F.when(key <= cut, "test").otherwise("train"))


def split_by_bucket(
    df: DataFrame, order: Sequence[str], test: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split`` with about ``test`` of the rows in ``test``; one pass, works on streams."""
    bucket = F.conv(F.substring(shuffle_key(seed, *order), 1, 8), 16, 10).cast("long")
    return df.withColumn("split", F.when(bucket < int(test * (1 << 32)), "test").otherwise("train"))
