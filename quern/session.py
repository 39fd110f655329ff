"""Session helpers: a local session for tests and durable intermediate tables."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_scopes: list[list[str]] = []

# Where local sessions keep intermediate tables unless told otherwise.
LOCAL_CHECKPOINTS = "quern-checkpoints"


def local_session(cores: str = "*", name: str = "quern", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": f"{tempfile.gettempdir()}/{LOCAL_CHECKPOINTS}",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="quern-")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset a session in one process takes a temporary folder; on a cluster, whose machines do not
    share one, this fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Unlike a cached DataFrame the table survives the loss of executors, and unlike an RDD
    checkpoint it stays columnar, so later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that ``materialise`` wrote inside; for jobs whose results are written."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
