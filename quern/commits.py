"""Stored datasets with a commit record.

A writer first leaves STARTED in the dataset's folder and last COMMIT, a small JSON file with the number of rows and a digest
of them. The table FILES beside it holds the rows of every part file. Rows and digest are observed by the very
tasks that write, so they cost no second pass; the commit compares them with the footers of the files that are there.

A folder with STARTED and no COMMIT is what an ended job left: readers and the catalog pass over it, and the next
write to it begins anew. A folder with neither was written by others and is read as it is, never replaced. One writer a folder at a time.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.sources import paths

STARTED, COMMIT, FILES = "_started.json", "_commit.json", "_files"


def row_digest(df: DataFrame) -> Column:
    """A sum over all rows that does not depend on their order; columns that hold maps are left out, as Spark hashes none."""
    hashed = [F.col(f"`{name.replace('`', '``')}`") for name, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    value = F.xxhash64(*hashed) if hashed else F.lit(0)
    return F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def is_committed(spark: SparkSession, path: str) -> bool:
    return paths.exists(spark, f"{path}/{COMMIT}")


def is_unfinished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder began and was not committed."""
    return paths.exists(spark, f"{path}/{STARTED}") and not is_committed(spark, path)


def record(spark: SparkSession, path: str) -> dict[str, object]:
    """What the commit says: rows, digest, files, committed_at and whatever the writer added."""
    return json.loads(paths.read_text(spark, f"{path}/{COMMIT}"))


def begin(spark: SparkSession, path: str) -> None:
    """Takes a folder for one write; the files of an unfinished one are removed."""
    if paths.exists(spark, path):
        if not is_unfinished(spark, path):
            raise FileExistsError(path)
        paths.delete(spark, path)
    paths.put_text(spark, f"{path}/{STARTED}", json.dumps({"started_at": _now()}))


def commit(spark: SparkSession, path: str, **fields: object) -> None:
    paths.put_text(spark, f"{path}/{COMMIT}", json.dumps({**fields, "committed_at": _now()}))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _stored_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """(file, rows) of the part files that are there, from their footers."""
    stored = spark.read.schema(schema).parquet(path)
    return stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))


def write_committed(df: DataFrame, path: str, **fields: object) -> int:
    """Writes ``df`` as Parquet to ``path`` and commits it with ``fields``; returns the number of rows.

    Fails where a committed dataset, or one of others, is.
    """
    spark = df.sparkSession
    begin(spark, path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), row_digest(df).alias("digest")).write.mode("append").parquet(path)
    rows, digest = seen.get["rows"], seen.get["digest"]
    _stored_files(spark, path, df.schema).write.parquet(f"{path}/{FILES}")
    files = spark.read.schema("file string, rows long").parquet(f"{path}/{FILES}")
    there, stored = files.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if stored != rows:
        raise OSError(f"{path} holds {stored} rows of {rows} that were written")
    commit(spark, path, **fields, rows=rows, digest=digest, files=there)
    return rows


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The dataset; an error where its write was not finished."""
    if is_unfinished(spark, path):
        raise FileNotFoundError(f"{path} was never committed")
    return spark.read.parquet(path)


def damage(spark: SparkSession, path: str) -> DataFrame:
    """Files whose rows are not those of the commit: file, expected, found; the row of file null is the digest of all rows.

    Empty for a whole dataset. Reads everything once.
    """
    stored = spark.read.parquet(path)
    want = spark.read.schema("file string, rows long").parquet(f"{path}/{FILES}").withColumnRenamed("rows", "expected")
    have = _stored_files(spark, path, stored.schema).withColumnRenamed("rows", "found")
    files = want.join(have, "file", "full_outer").where("not (expected <=> found)")
    files = files.select("file", F.col("expected").cast("string").alias("expected"), F.col("found").cast("string").alias("found"))
    digest = stored.agg(row_digest(stored).alias("found"))
    digest = digest.select(F.lit(None).cast("string").alias("file"), F.lit(record(spark, path)["digest"]).alias("expected"), "found")
    return files.unionByName(digest.where("expected <> found"))
