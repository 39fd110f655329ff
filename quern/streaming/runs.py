"""Run row-wise operators over files as they arrive, and drop repeated texts among them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import checkpoint_root


def stream_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    names: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """The Parquet files of a folder, now and later, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(
    stream: DataFrame, operator: Callable[[DataFrame], DataFrame], output: str, name: str
) -> None:
    """Apply an operator to everything that has arrived, then stop.

    The stream's position is kept in the checkpoint folder under ``name``, so the next run goes
    on where this one ended, and a run cut short is repeated without doubles.
    """
    checkpoint = f"{checkpoint_root(stream.sparkSession)}/streams/{name}"
    query = (
        operator(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()


def without_repeats(stream: DataFrame, event_time: str, delay: str, text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """The first row to arrive of every text (and ``keys``), for as long as the watermark keeps it.

    The state is a digest for each text, dealt over tasks by the digest, and goes once the watermark is ``delay`` past
    the row that stayed; so a text that comes again no more than ``delay`` later in event time is always dropped, and
    much later it may stay again. Rows behind the watermark are late and dropped. Null text is a text of its own. Of
    equal texts that arrive together any may stay. A table that is no stream has no watermark: each text stays once.
    """
    digest = _unused(stream, "digest")
    keyed = stream.withColumn(digest, F.sha2(F.col(text), 256))
    by = [digest, *keys]
    if not stream.isStreaming:
        return keyed.dropDuplicates(by).drop(digest)
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(by).drop(digest)


def _unused(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
