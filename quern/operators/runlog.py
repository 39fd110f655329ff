"""Structured run logs and run summaries."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import log_timestamp
from quern.schemas import RUN_LOG


def run_log(
    spark: SparkSession,
    run_id: str,
    component: str,
    events: Sequence[tuple[str, str, Mapping[str, Any] | None]],
    now: datetime | None = None,
) -> DataFrame:
    """Log rows from (level, message, context); the handful of a run's own messages."""
    moment = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    stamp = moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"
    rows = [
        (
            run_id, stamp, level.upper(), component, message,
            json.dumps(context, ensure_ascii=False, sort_keys=True) if context else "",
        )
        for level, message, context in events
    ]
    return spark.createDataFrame(rows, RUN_LOG)


def log_rows(df: DataFrame, context: Sequence[str] = ()) -> DataFrame:
    """Log rows from a table with run_id, timestamp, level, component and message columns.

    The named ``context`` columns become JSON with sorted keys, or empty text without any value.
    """
    fields = F.to_json(F.struct(*[F.col(c) for c in sorted(context)])) if context else F.lit("{}")
    stamp = log_timestamp(F.col("timestamp"))
    return df.select(
        "run_id",
        stamp.alias("timestamp"),
        F.upper("level").alias("level"),
        "component",
        "message",
        F.when(fields == "{}", "").otherwise(fields).alias("context"),
    )


def status_summary(items: DataFrame, status: str = "status") -> DataFrame:
    """Items per status."""
    return items.groupBy(status).agg(F.count("*").alias("items"))


def failures(items: DataFrame, status: str = "status", failed: str = "failed") -> DataFrame:
    """The failed items themselves; a table, as there may be many."""
    return items.filter(F.col(status) == failed)
