"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of local cores. Every query runs once
to warm up and once for the clock, each time to its last row without collecting anything.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from quern.session import local_session
from quern.suite.queries import QUERIES

FILE_BYTES = 1 << 20

HEADLINE = (
    "normalise_text",
    "dedup_exact_first",
    "dedup_report",
    "flag_context",
    "flag_split_counts",
    "retained_rows",
    "phrase_scan",
    "blocklist_filter",
    "banned_word_filter",
    "redact_phrases",
    "record_text_keys",
    "ndjson_concat",
    "source_head_n",
    "mix_capped",
    "shuffled_order",
    "train_test_split",
    "vocab_topn",
    "token_arrays",
    "training_set",
    "classification_set",
    "knn_top5",
    "rag_prompts",
    "corpus_report",
    "snapshot_state",
)


def lay_out(spark, sf: str) -> str:
    """A copy of the tables in several files each, as a data set of any size has them.

    The given tables are one row group each, which one task would have to read.
    """
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in Path(sf).glob("*.parquet"):
        size = sum(f.stat().st_size for f in path.rglob("*")) if path.is_dir() else path.stat().st_size
        files = min(16, 1 + size // FILE_BYTES)
        spark.read.parquet(str(path)).repartition(files).write.parquet(f"{folder}/{path.name}")
    return folder


def run(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    tables = lay_out(spark, sf)
    times = {}
    for name in names:
        cold = run(spark, tables, name)
        times[name] = round(run(spark, tables, name), 3)
        print(f"{name}: first {cold:.2f}s, then {times[name]:.2f}s", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total warm time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
