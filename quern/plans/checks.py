"""Validate a stored dataset and record what it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from quern import sinks
from quern.operators.validation import ValidationResult, dataset_metadata, validate


def record_validation(
    spark: SparkSession,
    path: str,
    output: str,
    required_columns: Sequence[str] = (),
    min_size: int = 1,
) -> ValidationResult:
    """Check the dataset at ``path``; its length and columns go to ``output`` only if it is valid.

    ``output`` is a folder of its own, so metadata of the build is never written over.
    """
    result = validate(spark, path, required_columns, min_size)
    if result.valid:
        sinks.write_metadata(dataset_metadata(spark.read.parquet(path)), output)
    return result
