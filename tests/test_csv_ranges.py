"""CSV files cut into ranges of a few bytes against one reader over the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quern.schemas import FILE_ORDER
from quern.sources import csv_ranges
from quern.sources.documents import read_csv_documents


def plain(content: bytes) -> list[str]:
    """The texts of a file, read from its first byte to its last."""
    records = list(csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8", "replace", newline="")))
    header, found = (records[0] if records else []), []
    for cells in records[1:]:
        wanted = [h for h in header if h.lower() == "text"]
        if wanted:
            place = max(i for i, h in enumerate(header) if h == wanted[0])
            found.append(cells[place].strip() if place < len(cells) else "")
        else:
            places = sorted({h: header.index(h) for h in header}.values())
            last = [max(i for i, h in enumerate(header) if h == header[p]) for p in places]
            cells = [cells[i] for i in last if i < len(cells)] + cells[len(header) :]
            found.append(" | ".join(c.strip() for c in cells if c.strip()))
    return [t for t in found if t]


@pytest.fixture
def small_ranges(spark, monkeypatch):
    # Stored tables would be read in such ranges too.
    monkeypatch.setattr(csv_ranges, "materialise", lambda df, label: spark.createDataFrame(df.collect(), df.schema))
    sizes = {"spark.sql.files.maxPartitionBytes": "24", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    yield
    for key in sizes:
        spark.conf.unset(key)


CELLS = ["a", "", "two words", 'say ""yes""', "line\nend", "cr\r\nlf", "one, two", "é\n\né", "x" * 90, '""', "\n\n\n", 'tail"']


def cell(draw):
    text = draw.choice(CELLS)
    if draw.random() < 0.15:
        return draw.choice(['in"side', 'a"b"c', "plain", '"closed" and more'])
    return f'"{text.rstrip(chr(34))}"' if any(c in text for c in ',\n\r"') or draw.random() < 0.3 else text


def made(seed):
    draw = random.Random(seed)
    header = draw.choice([b"n,Text\n", b"a,b,c\n", b"\n", b"text,n,text\r\n", b'"long\nname",text\n', b"\xef\xbb\xbftext,n\n"])
    end = draw.choice(["\n", "\r\n"])
    body = end.join(",".join(cell(draw) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(25)))
    return header + body.encode() + draw.choice([b"", b"\n", b',"never closed\nand, on', b"\xff\n"])


def test_bit_of_lines():
    for line, after in [(b'a,"b', (True, False)), (b"a,b", (False, True)), (b'a"b', (False, False)), (b'"a""', (True, False)), (b'",",",', (True, False)), (b'x"y","z', (True, True))]:
        assert (csv_ranges.ends_open(line, False), csv_ranges.ends_open(line, True)) == after


def test_files_in_ranges(spark, tmp_path, small_ranges):
    want = []
    for i in range(14):
        content = made(i)
        (tmp_path / f"{i:03}.csv").write_bytes(content)
        want += plain(content)
    df = read_csv_documents(spark, str(tmp_path))
    assert [r.text for r in df.orderBy(*FILE_ORDER).collect()] == want
    assert df.select("path", "block").distinct().count() > 40


def test_ranges_by_shuffle(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(csv_ranges, "BROADCAST_RANGES", 0)
    contents = [made(i) for i in range(40, 43)]
    for i, content in enumerate(contents):
        (tmp_path / f"{i}.CSV").write_bytes(content)
    df = read_csv_documents(spark, str(tmp_path))
    assert [r.text for r in df.orderBy(*FILE_ORDER).collect()] == [t for c in contents for t in plain(c)]


def test_one_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f'line {i} ""of"" it' for i in range(60))
    content = f'id,text\n1,first\n2,"{long}"\n3,last\n'.encode()
    (tmp_path / "a.csv").write_bytes(content)
    df = read_csv_documents(spark, str(tmp_path))
    rows = df.orderBy(*FILE_ORDER).collect()
    assert [r.text for r in rows] == ["first", long.replace('""', '"'), "last"]
    assert df.where(F.col("block") > 0).count() == 1 and rows[2].block > 24 * 20


def test_without_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("no table")
    (tmp_path / "empty.csv").write_text("")
    assert read_csv_documents(spark, str(tmp_path)).collect() == []
