import csv
from datetime import datetime, timezone
from pathlib import Path

from quern import sinks
from quern.operators import inventory, runlog


def listing(spark, rows):
    return spark.createDataFrame(rows, "root string, category string, path string, length long")


def test_listing_and_plan(spark, tmp_path):
    for name, size in (("models/m1/a.bin", 5), ("models/m1/.hidden", 2), ("models/.git/x", 9), ("models/m2/_part", 4), ("models/_cache/x", 6), ("data/d1.txt", 3), ("cache/c/d/e", 1)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    roots = {str(tmp_path / "models"): "models", str(tmp_path / "data"): "datasets", str(tmp_path / "cache"): "cache"}
    (tmp_path / "models/empty").mkdir()
    files = inventory.list_files(spark, roots)
    whole = {(r.category, r.entry): r.size_bytes for r in inventory.entry_sizes(inventory.list_entries(spark, roots)).collect()}
    sizes = {(r.category, r.entry): r.size_bytes for r in inventory.entry_sizes(files).collect()}
    assert sizes[("datasets", "d1.txt")] == 3 and sizes[("cache", "c")] == 1
    assert sizes[("models", "m1")] == 7 and sizes[("models", "m2")] == 4 and sizes[("models", "_cache")] == 6
    assert ("models", ".git") not in sizes
    assert whole == {**sizes, ("models", "empty"): 0}
    taken = spark.createDataFrame([("/new/data/d1.txt",), ("/new/data/d1.txt",)], "destination string")
    plan = inventory.plan_moves(files, taken, {"models": "/new/models", "datasets": "/new/data"}, "/new/cache")
    got = {(r.source.rsplit("/", 1)[1], r.destination, r.action) for r in plan.collect()}
    assert got == {
        ("m1", "/new/models/m1", "move"),
        ("m2", "/new/models/m2", "move"),
        ("_cache", "/new/models/_cache", "move"),
        ("d1.txt", "/new/data/d1.txt", "skip-conflict"),
        ("c", "/new/cache/c", "move"),
    }


def test_rollup(spark):
    files = listing(spark, [("/r", "a", "x/1", 1), ("/r", "a", "x/2", 2), ("/r", "b", "y", 4), ("/r", "b", ".z", 8)])
    got = {(r.category, r.entry): r.size_bytes for r in inventory.size_rollup(files).collect()}
    assert got == {("a", "x"): 3, ("a", None): 3, ("b", "y"): 4, ("b", None): 4, (None, None): 7}


def test_format_flags(spark):
    names = ["m.GGUF", "sub/w.ggml", "Model-GPTQ-4bit.pt", "deep/er/w.safetensors"]
    rows = [("all", "c", n, 1) for n in names] + [("none", "c", "a.bin", 1), ("folder", "c", "x-gptq/a.bin", 1)]
    got = {r.root: (r.gguf, r.ggml, r.gptq, r.safetensors) for r in inventory.format_flags(listing(spark, rows)).collect()}
    assert got == {"all": (True,) * 4, "none": (False,) * 4, "folder": (False, False, True, False)}


def test_snapshot_states(spark):
    cases = {
        "gone": [],
        "only_refs": [("refs/main", False)],
        "complete": [("snapshots", True), ("snapshots/r1", True), ("snapshots/r1/w.bin", False), ("refs", True), ("refs/main", False)],
        "listed_files_only": [("snapshots/r1/w.bin", False), ("refs/main", False)],
        "empty": [("snapshots", True), ("refs/main", False)],
        "no_refs": [("snapshots/r1/w.bin", False)],
        "empty_refs": [("snapshots/r1/w.bin", False), ("refs", True)],
        "empty_folder": [("snapshots/r1", True), ("refs/main", False)],
        "top_lock": [("snapshots/x.lock", False), ("snapshots/r1/w.bin", False), ("refs/main", False)],
        "top_tmp_is_fine": [("snapshots/x.tmp", False), ("snapshots/r1/w.bin", False), ("refs/main", False)],
        "nested_tmp": [("snapshots/r1/a/x.tmp", False), ("refs/main", False)],
        "incomplete_folder": [("snapshots/r.incomplete", True), ("snapshots/r.incomplete/y.tmp", False), ("refs/main", False)],
        "download": [("snapshots/r1/w.bin", False), ("refs/main", False), ("downloads/a/x.partial", False)],
        "download_incomplete_is_fine": [("snapshots/r1/w.bin", False), ("refs/main", False), ("downloads/x.incomplete", False)],
        "files_only": [("snapshots/w.bin", False), ("refs/main", False)],
    }
    repos = spark.createDataFrame([(r,) for r in cases], "repo string")
    rows = [(repo, path, is_dir) for repo, paths in cases.items() for path, is_dir in paths]
    got = {
        r.repo: (r.state, r.markers)
        for r in inventory.snapshot_state(repos, spark.createDataFrame(rows, "repo string, path string, is_dir boolean")).collect()
    }
    assert got == {
        "gone": ("missing", 0),
        "only_refs": ("missing", 0),
        "complete": ("complete", 0),
        "listed_files_only": ("complete", 0),
        "empty": ("incomplete", 0),
        "no_refs": ("incomplete", 0),
        "empty_refs": ("incomplete", 0),
        "empty_folder": ("incomplete", 1),
        "top_lock": ("incomplete", 1),
        "top_tmp_is_fine": ("complete", 0),
        "nested_tmp": ("incomplete", 1),
        "incomplete_folder": ("incomplete", 1),
        "download": ("incomplete", 1),
        "download_incomplete_is_fine": ("complete", 0),
        "files_only": ("incomplete", 0),
    }


def test_run_log(spark, tmp_path):
    now = datetime(2024, 3, 5, 6, 7, 8, 9900, tzinfo=timezone.utc)
    rows = runlog.run_log(spark, "r1", "job", [("info", "start", None), ("error", "é, \"x\"", {"b": 1, "a": [2]})], now)
    path = str(tmp_path / "log")
    sinks.append_run_log(rows.coalesce(1), path)
    sinks.append_run_log(rows.coalesce(1), path)
    read = []
    for part in Path(path).glob("part-*"):
        with part.open(newline="", encoding="utf-8") as handle:
            lines = list(csv.reader(handle))
        assert lines[0] == ["run_id", "timestamp", "level", "component", "message", "context"]
        read += lines[1:]
    one = ["r1", "2024-03-05T06:07:08.009Z", "INFO", "job", "start", ""]
    two = ["r1", "2024-03-05T06:07:08.009Z", "ERROR", "job", 'é, "x"', '{"a": [2], "b": 1}']
    assert sorted(read) == sorted([one, two] * 2)


def test_log_rows_and_summary(spark):
    df = spark.sql(
        "select 'r' run_id, timestamp'2024-01-01 00:00:00' timestamp, 'warn' level, 'c' component, 'm' message, "
        "cast(null as int) b, 'x' a union all select 'r', timestamp'2024-01-01 00:00:00', 'info', 'c', 'm', null, null"
    )
    got = {(r.level, r.context) for r in runlog.log_rows(df, ["b", "a"]).collect()}
    assert got == {("WARN", '{"a":"x"}'), ("INFO", "")}
    items = spark.createDataFrame([("a", "failed"), ("b", "success"), ("c", "failed")], "item string, status string")
    assert {r.status: r["items"] for r in runlog.status_summary(items).collect()} == {"failed": 2, "success": 1}
    assert {r.item for r in runlog.failures(items).collect()} == {"a", "c"}
