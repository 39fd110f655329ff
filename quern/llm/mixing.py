"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled line. A document's virtual finish time is the number of words
up to its end, over the source's target; a source that is to be repeated starts its line again. The mix is
all documents in order of finish time, cut where the total budget is used up.

Only DataFrame functions run here. Running sums have two levels, so that no task sees a whole source:
sums of slices of the line first, rows within a slice then. The cut is found likewise from sums over slots
of virtual time, which hold about equal numbers of words, and an ordering of the one slot it falls in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quern.llm.common import unused
from quern.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
REPEATS = 3
SLICE_ROWS = 5000
# Finish times beyond are after the cut: at 1 every source has met its target.
LATEST = 4.0
MAX_SLOTS = 1 << 20
# Up to so many sources, one row each, are sent to all tasks; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Plan:
    """What the mix needs to know beyond a row: sources, where slices start, and where to cut."""

    sources: DataFrame
    starts: DataFrame
    cut: Row | None
    few: bool


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column | str) -> Column:
    """Place in the shuffled line: the first 60 bits of the md5 of the id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, rank, target) from rows (source, size).

    Sources by code point, null last, have the weights 1, 2, 3 in turn. A target ends at ``REPEATS`` times the
    source's size; what is above goes to the others by weight. With sources ordered by that limit per
    weight, the level to which weights are filled is the largest of the levels that result if all
    sources before were at their limit.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    limit = F.col("source_size") * REPEATS
    by_limit = Window.orderBy(limit / F.col("weight"), "rank")
    every = Window.partitionBy()
    full = F.coalesce(F.sum(limit).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(every) - full) / rest)
    per = per.withColumn("level", F.max("level").over(every))
    return per.select(
        "source", "source_size", "n_rows", "rank", F.least(limit.cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def _sliced(rows: DataFrame, plan_sources: DataFrame, few: bool) -> DataFrame:
    sources = plan_sources.withColumnRenamed("source", "of")
    sources = F.broadcast(sources) if few else sources
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    slices = 1 + F.floor(F.col("n_rows") / SLICE_ROWS)
    return rows.withColumn("slice", F.floor(F.shiftright("h", 30) * slices / F.lit(1 << 30)).cast("int"))


def _finished(rows: DataFrame, plan_sources: DataFrame, starts: DataFrame, few: bool) -> DataFrame:
    """Adds ``done``: words of the source's line up to the row's end."""
    rows = _sliced(rows, plan_sources, few)
    line = Window.partitionBy("rank", "slice").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("in_slice", F.sum("size").over(line))
    rows = rows.join(starts, ["rank", "slice"])
    return rows.withColumn("done", F.col("start") + F.col("in_slice"))


def _time(turn: Column | int) -> Column:
    turn = F.lit(turn) if isinstance(turn, int) else turn
    time = (turn * F.col("source_size") + F.col("done")) / F.col("target")
    return F.when(F.col("target") > 0, time).otherwise(F.lit(0.0))


def _slots(n_rows: int) -> int:
    return min(MAX_SLOTS, max(16, n_rows // SLICE_ROWS))


def plan(slim: DataFrame) -> Plan:
    """From rows (id, source, size, h): the sources' targets, the slices' starts and the cut."""
    sources = materialise(targets(slim), "mix-sources")
    whole = sources.agg(F.count("*").alias("n"), F.sum("source_size").alias("budget"), F.sum("n_rows").alias("rows")).first()
    few = whole["n"] <= BROADCAST_SOURCES
    sums = _sliced(slim, sources, few).groupBy("rank", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    starts = materialise(starts, "mix-starts")
    if not whole["budget"]:
        return Plan(sources, starts, None, few)
    budget, slots = int(whole["budget"]), _slots(whole["rows"])
    turns = _finished(slim, sources, starts, few).where("size > 0")
    turns = turns.select("*", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("turn"))
    turns = turns.select("id", "size", "h", "rank", "turn", _time(F.col("turn")).alias("time")).where(F.col("time") <= LATEST)
    turns = turns.withColumn("slot", F.floor(F.col("time") * slots).cast("long"))
    turns = materialise(turns, "mix-turns")
    # One row for each slot, at most LATEST * MAX_SLOTS + 1 in all.
    running = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    filled = turns.groupBy("slot").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(running))
    over = filled.where(F.col("upto") > budget).orderBy("slot").select("slot", (F.col("upto") - F.col("words")).alias("before")).first()
    key = F.struct("time", "rank", "h", "id", "turn")
    if over is None:
        cut = turns.agg(F.max(key).alias("key")).first()
    else:
        # The rows of one slot of virtual time; equal keys are taken together or not at all.
        within = Window.orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        slot = turns.where(F.col("slot") == over["slot"]).select(key.alias("key"), F.sum("size").over(within).alias("upto"))
        kept = slot.where(F.col("upto") <= budget - over["before"]).agg(F.max("key").alias("key"))
        earlier = turns.where(F.col("slot") < over["slot"]).agg(F.max(key).alias("key"))
        cut = kept.unionByName(earlier).agg(F.max("key").alias("key")).first()
    return Plan(sources, starts, cut["key"], few)


def _taken(turn: int, cut: Row | None) -> Column:
    if cut is None:
        return F.lit(turn == 0)
    key = F.struct(_time(turn).alias("time"), F.col("rank"), F.col("h"), F.col("id"), F.lit(turn).alias("turn"))
    last = F.struct(
        F.lit(cut["time"]).alias("time"),
        F.lit(cut["rank"]).cast("int").alias("rank"),
        F.lit(cut["h"]).cast("long").alias("h"),
        F.lit(cut["id"]).cast("long").alias("id"),
        F.lit(cut["turn"]).alias("turn"),
    )
    return (key <= last) & ((F.col("size") > 0) | F.lit(turn == 0))


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), draw("doc_id").alias("h")
    )


def shares(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, size, source_size, target, taken, copies, finish.

    ``taken`` is ``copies`` (0 to 3) times ``size``. Documents of no words cost nothing: they have at most one
    copy. Repeated rows are documents of their own. No rows give no rows.
    """
    rows = materialise(slim(docs), "mix-rows")
    found = plan(rows)
    rows = _finished(rows, found.sources, found.starts, found.few)
    copies = sum((_taken(t, found.cut).cast("int") for t in range(1, REPEATS)), _taken(0, found.cut).cast("int"))
    rows = rows.withColumn("copies", copies)
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        _time(0).alias("finish"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` with all columns, as often as they are taken, in order of finish time.

    The time is added as ``finish`` (underscores before it where the name is taken).
    """
    found = plan(materialise(slim(docs), "mix-rows"))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), draw("doc_id").alias("h")
    )
    rows = _finished(rows, found.sources, found.starts, found.few)
    turns = F.array(*[F.when(_taken(t, found.cut), _time(t)) for t in range(REPEATS)])
    rows = rows.select("row", F.explode(F.filter(turns, lambda t: t.isNotNull())).alias("time"))
    rows = rows.repartitionByRange("time").sortWithinPartitions("time")
    return rows.select("row.*", F.col("time").alias(unused(docs, "finish")))


ORACLE = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    substr(md5(cast(doc_id as varchar)), 1, 15) as h
  from documents
), per as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as rank
  from sized group by source
), weighed as (
  select *, rank % 3 + 1 as weight, source_size * 3 as cap from per
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level
  from weighed
), targets as (
  select source, source_size, rank, least(cast(cap as double), max(level) over () * weight) as target from levels
), line as (
  select doc_id, size, h, rank, source_size, target, sum(size) over (partition by rank order by h, doc_id, size rows unbounded preceding) as done
  from sized join targets on sized.source is not distinct from targets.source
), turns as (
  select line.*, turn, (turn * source_size + cast(done as bigint)) / target as time from line, range(3) as r(turn) where size > 0
), upto as (
  select *, sum(size) over (order by time, rank, h, doc_id, turn range unbounded preceding) as words from turns where time <= 4
), taken as (
  select doc_id, count(*) as copies from upto where words <= (select sum(source_size) from per) group by doc_id
)
select line.doc_id, cast(size as bigint) as size, source_size, target, cast(size * coalesce(copies, 0) as bigint) as taken
from line left join taken using (doc_id)
"""
