"""CSV files of any size, parsed by many tasks.

Spark cuts files into ranges and gives every line to the range in which it begins. A line is read alike whatever stands
before it but for one bit: whether it begins inside a quoted cell. So each range is a function from that bit at its
start to that bit at its end; a first pass finds these functions, their composition over a file's ranges in order
(constants and swaps only, so a window's last value and a sum) gives the bit for every range, and a second pass parses
all ranges at once. A record belongs to the range in which it begins. What it has in later ranges is passed on in
pieces, at most two for a range, which are put together by a group of their own.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import CELL_SEPARATOR
from quern.session import materialise

TEXT_HEADER = "text"
# Up to so many ranges, of some hundred bytes, are sent to all tasks; more are joined by a shuffle of the lines.
BROADCAST_RANGES = 200_000
RECORDS_AT_ONCE = 1000
MARK = "\ufeff"

# From inside a cell's quotes to the cell's end; and one cell with what ends it. A quote counts where it begins a cell.
_REST = re.compile(rb'(?:[^"]++|"")*+"[^,\r]*+')
_CELL = re.compile(rb'(?:"(?:[^"]++|"")*+"[^,\r]*+|(?!")[^,\r]*+)(?:[,\r]|\Z)')


def ends_open(line: bytes, is_open: bool) -> bool:
    """Whether the end of a line, which has no line feed in it, is inside a quoted cell."""
    if b'"' not in line:
        return is_open
    at = 0
    if is_open:
        rest = _REST.match(line)
        if rest is None:
            return True
        at = rest.end() + 1
    while at < len(line):
        cell = _CELL.match(line, at)
        if cell is None:
            return True
        at = max(cell.end(), at + 1)
    return False


def _lines(spark: SparkSession, path: str, names: str) -> DataFrame:
    files = spark.read.text(path, lineSep="\n", pathGlobFilter=names)
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("line"),
    )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch, list[bytes]]]:
    """((path, block), rows, lines) for runs of lines of one range; a range may go on in the next batch."""
    for batch in batches:
        paths, blocks, lines = (batch.column(c).to_pylist() for c in ("path", "block", "line"))
        begin = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or blocks[i] != blocks[begin] or paths[i] != paths[begin]:
                yield (paths[begin], blocks[begin]), batch.slice(begin, i - begin), lines[begin:i]
                begin = i


_RANGE = "path string, block long, size long, bytes long, zero boolean, one boolean, head binary"
_RANGE_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: its bytes, the bit at its end for either bit at its start, and the first record of a file."""
    names = [c.split()[0] for c in _RANGE.split(", ")]
    at: dict = {}

    def row() -> pa.RecordBatch:
        values = [*at["place"], at["size"], at["bytes"], at["ends"][0], at["ends"][1], b"".join(at["head"]) if at["place"][1] == 0 else None]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _RANGE_TYPES, strict=True)], names=names)

    for place, rows, lines in _by_range(batches):
        if at.get("place") != place:
            if at:
                yield row()
            at = {"place": place, "size": rows.column("size")[0].as_py(), "bytes": 0, "ends": (False, True), "head": [], "in_head": place[1] == 0}
        at["bytes"] += sum(map(len, lines)) + len(lines)
        zero, one = at["ends"]
        for line in lines:
            if at["in_head"]:
                at["head"].append(line + b"\n")
            if b'"' in line:
                zero, one = ends_open(line, zero), ends_open(line, one)
            at["in_head"] = at["in_head"] and zero
        at["ends"] = (zero, one)
    if at:
        yield row()


_LAYOUT = "path string, text_at int, picks array<int>, width int"


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a file's first record says of the others: the place of the text column, or those of all columns.

    A blank first line means that there is no header. Of a repeated header the last cell counts.
    """
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        found = []
        for path, head, marked in zip(*(batch.column(c).to_pylist() for c in ("path", "head", "marked")), strict=True):
            header = next(csv.reader(io.StringIO((MARK if marked else "") + head.decode("utf-8", "replace"), newline="")), [])
            last = {name: i for i, name in enumerate(header)}
            text = next((name for name in header if name.lower() == TEXT_HEADER), None)
            found.append((path, None if text is None else last[text], list(last.values()), len(header)))
        types = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=[c.split()[0] for c in _LAYOUT.split(", ")])


def _ranges(lines: DataFrame) -> DataFrame:
    """One row for each range: path, block, open (whether it begins inside a quoted cell), last, and the file's layout."""
    found = materialise(lines.select("path", "block", "size", "line").mapInArrow(_functions, _RANGE), "csv-functions")
    of_file = Window.partitionBy("path")
    upto = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("zero") == F.col("one")
    swap = (F.col("zero") & ~F.col("one")).cast("long")
    rows = found.withColumn("swaps", F.sum(swap).over(upto))
    fixed = F.last(F.when(constant, F.struct("zero", "swaps")), ignorenulls=True).over(before)
    rows = rows.withColumn("fixed", fixed).withColumn("had", F.coalesce(F.lag("swaps").over(of_file.orderBy("block")), F.lit(0)))
    swapped = (F.col("had") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    # Spark's line reader leaves a byte-order mark out, so a file has three bytes more than its lines.
    rows = rows.select(
        "path", "block", "head",
        (F.coalesce("fixed.zero", F.lit(False)) != swapped).alias("open"),
        (F.col("block") == F.max("block").over(of_file)).alias("last"),
        (F.col("size") - F.sum("bytes").over(of_file) >= 2).alias("marked"),
    )
    rows = materialise(rows, "csv-ranges")
    layouts = rows.where("block = 0").select("path", "head", "marked").mapInArrow(_layouts, _LAYOUT)
    return materialise(rows.drop("head", "marked").join(layouts, "path"), "csv-layouts")


def _value(cells: list[str], text_at: int | None, picks: list[int], width: int) -> str | None:
    if text_at is not None:
        return cells[text_at] if text_at < len(cells) else None
    picked = [cells[i] for i in picks if i < len(cells)] + cells[width:]
    return CELL_SEPARATOR.join(cell for cell in map(str.strip, picked) if cell)


_RECORD = "path string, block long, row long, value string, error string, piece binary, begins boolean"
_RECORD_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_())


def _rows_of(path: str, block: int, rows: list[tuple]) -> pa.RecordBatch:
    rows = [(path, block, *r) for r in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(_RECORD_TYPES)], names=[c.split()[0] for c in _RECORD.split(", ")]
    )


class _Range:
    """The records that begin in one range, from its lines in order."""

    def __init__(self, is_open: bool, last: bool, skip: bool, layout: tuple):
        self.is_open, self.last, self.skip, self.layout = is_open, last, skip, layout
        self.head: list[bytes] | None = [] if is_open else None
        self.held: list[bytes] = []
        self.whole = 0
        self.row = 0

    def add(self, line: bytes) -> None:
        self.is_open = ends_open(line, self.is_open)
        (self.held if self.head is None else self.head).append(line + b"\n")
        if self.head is None and not self.is_open:
            self.whole = len(self.held)

    def taken(self) -> Iterator[tuple]:
        """(row, value, error, piece, begins) of what is complete by now."""
        if self.head is not None and not self.is_open:
            yield 0, None, None, b"".join(self.head), False
            self.head = None
        lines, self.held, self.whole = self.held[: self.whole], self.held[self.whole :], 0
        yield from self._parsed(lines)

    def _parsed(self, lines: list[bytes]) -> Iterator[tuple]:
        try:
            for cells in csv.reader(io.StringIO(b"".join(lines).decode("utf-8", "replace"), newline="")):
                if self.skip:
                    self.skip = False
                    continue
                yield self.row, _value(cells, *self.layout), None, None, None
                self.row += 1
        except csv.Error as problem:
            yield self.row, None, f"{type(problem).__name__}: {problem}", None, None

    def rest(self) -> Iterator[tuple]:
        """What is left at the end of the range; at the end of a file an open cell ends too."""
        yield from self.taken()
        if self.head is not None:
            yield 0, None, None, b"".join(self.head), False
        elif self.held and self.last:
            yield from self._parsed(self.held)
        elif self.held:
            yield self.row, None, None, b"".join(self.held), True


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(sys.maxsize)
    now, place = None, ("", 0)
    for here, rows, lines in _by_range(batches):
        if now is None or here != place:
            if now is not None:
                yield _rows_of(*place, list(now.rest()))
            is_open, last, *layout = (rows.column(c)[0].as_py() for c in ("open", "last", "text_at", "picks", "width"))
            now, place = _Range(is_open, last, here[1] == 0, tuple(layout)), here
        for begin in range(0, len(lines), RECORDS_AT_ONCE):
            for line in lines[begin : begin + RECORDS_AT_ONCE]:
                now.add(line)
                if now.head is not None and not now.is_open:
                    yield _rows_of(*place, list(now.taken()))
            yield _rows_of(*place, list(now.taken()))
    if now is not None:
        yield _rows_of(*place, list(now.rest()))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from their pieces."""
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        for path, block, row, pieces, *layout in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one = _Range(False, True, False, tuple(layout))
            one.row = row
            yield _rows_of(path, block, list(one._parsed(pieces)))


def csv_records(spark: SparkSession, path: str, names: str) -> DataFrame:
    """path, block, row, value and error: every record's text, placed by the range in which it begins.

    The first pass over the files runs at once.
    """
    lines = _lines(spark, path, names)
    ranges = _ranges(lines)
    if ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        rows = lines.drop("size").join(F.broadcast(ranges), ["path", "block"])
    else:
        rows = lines.drop("size").join(ranges, ["path", "block"])
        rows = rows.repartition("path", "block").sortWithinPartitions("path", "block", "at")
    found = rows.drop("at").mapInArrow(_records, _RECORD)
    if ranges.where("open").isEmpty():
        return found.select("path", "block", "row", "value", "error")
    found = materialise(found, "csv-records")
    in_order = Window.partitionBy("path").orderBy("block", "begins").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.last(F.when(F.col("begins"), F.struct("block", "row")), ignorenulls=True).over(in_order)
    pieces = found.where("piece is not null").select("path", "block", "piece", begin.alias("begin"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"])
    pieces = pieces.groupBy("path", "begin").agg(joined.alias("pieces"))
    layouts = ranges.where("block = 0").select("path", "text_at", "picks", "width")
    pieces = pieces.join(layouts, "path").select("path", "begin.block", "begin.row", "pieces", "text_at", "picks", "width")
    whole = pieces.mapInArrow(_assembled, _RECORD)
    return found.where("piece is null").unionByName(whole).select("path", "block", "row", "value", "error")
