"""Exact duplicates by a persistent digest index.

The index is a Parquet table, bucketed and sorted by the digest of the normalised text (A-Z in lower case).
New data is digested and reduced to one row for each text, anti-joined with the index by a sort-merge join
whose index side is read without a shuffle (it is sorted again, as a bucket gets a file with every batch), and what is
new is appended as further files of the buckets. The table lies in a folder of its own and is opened by that path, so
later sessions go on with it; the number of its buckets is stored beside it.

A batch has a name, kept with the texts that it brought. A job that is repeated under the name of its batch gets the
answer of the first time, whether that was stored, lost or cut short: what the index has of this batch counts as new.

Only DataFrame functions run here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import lower_az
from quern.session import checkpoint_root, materialise
from quern.sources.paths import exists

BUCKETS = 32
# A text with at least this part of all rows is hot: at most HOT_PARTS texts, which are sent to all tasks.
HOT_PARTS = 1000
COLUMNS = "text_sha256 string, keep_id long, keep_row long, group_size long, batch string"


def new_index_path(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/digest-index-{uuid.uuid4().hex}"


class DigestIndex:
    """The index in the folder ``path``; it is created empty where there is none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        stored = f"{path.rstrip('/')}.buckets"
        if exists(spark, stored):
            had = spark.read.schema("buckets long").parquet(stored).first()
            if had is not None and had.buckets != buckets:
                raise ValueError(f"the index in {path} has {had.buckets} buckets, not {buckets}")
        else:
            spark.range(1).select(F.lit(int(buckets)).cast("long").alias("buckets")).write.parquet(stored)
        spark.sql(
            f"create table {self.table} ({COLUMNS}) using parquet "
            f"clustered by (text_sha256) sorted by (text_sha256) into {int(buckets)} buckets location '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """Rows (text_sha256, keep_id, keep_row, group_size, batch) that the index has not."""
        rows = fresh.select("text_sha256", "keep_id", "keep_row", "group_size", "batch")
        # One file for each bucket, not one for each bucket and task.
        rows.repartition(self.buckets, "text_sha256").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forgets the table's name; the folder stays."""
        self.spark.sql(f"drop table if exists {self.table}")


def digested(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_sha256), written once; ``row`` numbers the rows, so repeated rows differ."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(lower_az("text").cast("binary"), 256).alias("text_sha256"),
    )
    return materialise(rows, "digests")


def ingest(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Appends the texts of ``docs`` that the index has not, and decides on every row of ``docs``.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Of new equal texts the row with the largest doc_id
    stays (a null id counts as smaller than any; of repeated rows with that id one stays). ``group_size``
    counts the equal rows of the batch that brought the text. A text that the index had keeps
    its first ``keep_id`` and all its new rows go. Null counts as empty text.

    ``batch`` names these rows and no others; with it the call can be repeated. Without a name every call is a batch of its
    own, so that a repeat finds all its texts known.
    """
    batch = batch or uuid.uuid4().hex
    rows = digested(docs)
    groups = rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    groups = groups.select("text_sha256", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size", F.lit(batch).alias("batch"))
    groups = materialise(groups, "digest-groups")
    index.append(groups.join(index.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti"))

    # The row that stays has another number when a batch is read again.
    known = index.rows().drop("keep_row").join(groups.select("text_sha256", "keep_row").hint("merge"), "text_sha256")
    known = materialise(known.withColumn("own", F.col("batch") == batch).drop("batch"), "digest-known")
    # A text with a large part of the rows would meet in one task; so few can be that large that they are sent.
    total = rows.count()
    hot = groups.where(F.col("group_size") * HOT_PARTS >= F.lit(total)).select("text_sha256")
    hot_known = F.broadcast(known.join(F.broadcast(hot), "text_sha256", "left_semi"))
    is_hot = F.broadcast(hot.withColumn("hot", F.lit(True)))
    marked = rows.join(is_hot, "text_sha256", "left")
    found = marked.where("hot").drop("hot").join(hot_known, "text_sha256")
    found = found.unionByName(marked.where("hot is null").drop("hot").join(known, "text_sha256"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("own") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


ORACLE = """
with digests as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
), grouped as (
  select *, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size
  from digests
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from grouped
"""
