"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of their digests. The smallest capacity for which the
shards hold all groups in this order is found by binary search, checking greedily, and the order is cut there.

Groups above an even share get a shard of their own first, else the capacity they force would leave other
shards empty. The search runs on the sums of cells, which are prefixes of the digest. Cells in which a
cut may fall are opened level by level down to single groups, so the driver holds few sums, and the capacity
and cuts are those that a search over all groups finds.

Only DataFrame functions run on the rows. Places in a shard come from running sums of two levels.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import unused
from quern.session import materialise

SHARDS = 40
ROW_BYTES = 16
# Hex digits of the digest in a cell at first, and how many each opening adds.
FIRST_DIGITS, MORE_DIGITS, DIGITS = 4, 2, 64
# Cells opened at once, each into at most 16 ** MORE_DIGITS.
OPENED = 1024
SLOT_ROWS = 20_000
BROADCAST_ROWS = 500_000
NULL_GROUP = "-"

# (bytes, groups, bytes of the largest group) of a cell
Cell = tuple[int, int, int]


def group_key(text: Column | str) -> Column:
    """Digest of the text; null texts are one group, which stands first."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.sha2(column.cast("binary"), 256), F.lit(NULL_GROUP))


def size(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return (F.coalesce(F.octet_length(column), F.lit(0)) + ROW_BYTES).cast("long")


def greedy(upto: list[int], atomic: list[bool], capacity: int, shards: int) -> list[int] | None:
    """Where each shard begins, in bytes, if every shard takes what fits; None if ``shards`` are too few.

    ``upto`` are the running sums of the cells. A cell that is not atomic may be cut anywhere.
    """
    begins, start, total = [], 0, upto[-1]
    while start < total:
        if len(begins) == shards:
            return None
        begins.append(start)
        end = start + capacity
        if end >= total:
            break
        cell = bisect_right(upto, end)
        before = upto[cell - 1] if cell else 0
        end = before if atomic[cell] else end
        if end <= start:
            return None
        start = end
    return begins


def smallest_capacity(upto: list[int], atomic: list[bool], shards: int, least: int) -> int:
    """The least capacity, ``least`` or more, for which ``shards`` contiguous runs hold all cells."""
    low, high = least, max(upto[-1], least)
    while low < high:
        middle = (low + high) // 2
        if greedy(upto, atomic, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def uncertain(upto: list[int], atomic: list[bool], low: int, high: int, shards: int) -> list[int]:
    """Cells of several groups in which a greedy run of a capacity from ``low`` to ``high`` may cut.

    The k-th cut lies between the begin of the cell that a run of the smallest capacity reaches and what a
    run of the largest reaches.
    """
    found, first, last = set(), 0, 0
    for _ in range(shards - 1):
        first, last = first + low, last + high
        a = bisect_right(upto, first)
        if a >= len(upto):
            break
        first = upto[a - 1] if a else 0
        b = min(bisect_right(upto, last), len(upto) - 1)
        if atomic[b]:
            last = upto[b - 1] if b else 0
        last = min(last, upto[-1])
        found.update(i for i in range(a, b + 1) if not atomic[i])
    return sorted(found)


def _cells(groups: DataFrame, digits: int) -> dict[str, Cell]:
    per = groups.groupBy(F.substring("key", 1, digits).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("most")
    )
    return {r["cell"]: (r["bytes"], r["n"], r["most"]) for r in per.collect()}


def cuts(groups: DataFrame, shards: int) -> list[str]:
    """The first cells of the shards, in order of the key, for ``groups`` (key, bytes)."""
    cells = _cells(groups, FIRST_DIGITS)
    while cells:
        names = sorted(cells)
        upto = list(accumulate(cells[c][0] for c in names))
        atomic = [cells[c][1] == 1 for c in names]
        high = smallest_capacity(upto, [True] * len(names), shards, 1)
        least = max(cells[c][2] for c in names)
        low = smallest_capacity(upto, atomic, shards, least)
        open_ = [names[i] for i in uncertain(upto, atomic, low, high, shards)] if low < high else []
        if not open_:
            begins = greedy(upto, [True] * len(names), high, shards)
            return [names[bisect_right(upto, begin)] for begin in begins]
        digits = min(map(len, open_))
        open_ = [c for c in open_ if len(c) == digits][:OPENED]
        inner = groups.where(F.substring("key", 1, digits).isin(open_))
        for c in open_:
            del cells[c]
        cells |= _cells(inner, min(digits + MORE_DIGITS, DIGITS))
    return []


@dataclass(frozen=True)
class Layout:
    """Groups with shards of their own, the first cells of the others' shards, and cells for the slots."""

    own: list[str]
    begins: list[str]
    parts: int


def layout(rows: DataFrame, shards: int = SHARDS) -> Layout:
    """From rows (key, size)."""
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    whole = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    rest, left, own = whole["bytes"] or 0, shards, []
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if left == 1 or r["bytes"] * left <= rest:
            break
        own.append(r["key"])
        rest, left = rest - r["bytes"], left - 1
    others = groups.where(~F.col("key").isin(own)) if own else groups
    return Layout(own, cuts(others, left), 1 + (whole["n"] or 0) // SLOT_ROWS)


def _shard(key: Column, plan: Layout) -> Column:
    shard = F.lit(len(plan.own) - 1)
    for begin in plan.begins:
        shard = shard + (key >= begin).cast("int")
    if plan.own:
        shard = F.coalesce(F.element_at(F.create_map(*[x for i, k in enumerate(plan.own) for x in (F.lit(k), F.lit(i))]), key), shard)
    return shard.cast("int")


def _slots(rows: DataFrame, plan: Layout) -> DataFrame:
    """Adds shard and slot to rows (id, key, ...). The parts of a shard are numbered one after another."""
    rows = rows.withColumn("shard", _shard(F.col("key"), plan))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "key"), F.lit(plan.parts)))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "shard-starts")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "key")) - 1
    rows = rows.withColumn("within", within).join(starts, ["shard", "part"])
    return rows.withColumn("slot", F.col("start") + F.col("within"))


def _id(column: str) -> Column:
    return F.col(column).cast("long").alias("id")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """For each row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Sizes are the text's UTF-8 bytes plus ``ROW_BYTES``; a null text has none and crc32 0. Equal texts share a
    shard. Slots count from 0 without gaps; with fewer groups than shards, later shards stay empty.
    """
    rows = docs.select(
        _id("doc_id"), size("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), group_key("text").alias("key")
    )
    rows = materialise(rows, "shard-rows")
    found = _slots(rows, layout(rows, shards))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with all columns, shard and slot (underscores before the names where they are taken)."""
    plan = layout(docs.select(group_key("text").alias("key"), size("text").alias("size")), shards)
    rows = docs.select(F.struct("*").alias("row"), _id("doc_id"), group_key("text").alias("key"))
    found = _slots(rows, plan)
    return found.select("row.*", F.col("shard").alias(unused(docs, "shard")), F.col("slot").alias(unused(docs, "slot")))
