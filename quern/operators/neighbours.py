"""Exact nearest neighbours by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.schemas import NEIGHBOURS

# Fixed value: neighbours per question.
TOP_K = 5

# Queries up to this many bytes (as doubles) go to every task whole; beyond, both sides are cut
# into blocks of at most about BLOCK_ROWS rows, blocks are put together to bands, and every pair of
# bands becomes one task's work. There are GRID bands, or more where one would exceed BAND_BYTES (as doubles).
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 50_000
GRID = 16
BAND_BYTES = 64 << 20
# Documents compared at a time, and distances held at once by one task.
_CHUNK = 1 << 10
_CELLS = 1 << 18


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix of doubles."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


class _Best:
    """The ``k`` smallest (distance, id) pairs of every query met so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries = queries
        self.norms = np.einsum("ij,ij->i", queries, queries)
        self.k = k
        self.d2 = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.einsum("ij,ij->i", vectors, vectors)
        for first in range(0, len(ids), _CHUNK):
            own = slice(first, first + _CHUNK)
            step = max(1, _CELLS // len(ids[own]))
            for start in range(0, len(self.queries), step):
                self._add(slice(start, start + step), ids[own], vectors[own], norms[own])

    def _add(self, part: slice, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        queries, d2, own = self.queries[part], self.d2[part], self.ids[part]
        rough = queries @ vectors.T
        rough *= -2.0
        rough += norms[None, :]
        rough += self.norms[part, None]
        # The product form loses digits, so everything near the k-th distance is measured again.
        slack = 1e-9 * (1.0 + self.norms[part].max(initial=0.0) + norms.max(initial=0.0))
        bound = d2[:, -1]
        near = rough <= bound[:, None] + slack
        if rough.shape[1] > self.k and np.count_nonzero(near) > 2 * self.k * len(queries):
            bound = np.minimum(bound, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
            near = rough <= bound[:, None] + slack
        rows, cols = np.nonzero(near)
        if not len(rows):
            return
        exact = ((queries[rows] - vectors[cols]) ** 2).sum(axis=1)
        # Only queries that met something near are ordered anew.
        met, of = np.unique(rows, return_inverse=True)
        all_rows = np.concatenate([of, np.repeat(np.arange(len(met)), self.k)])
        all_d2 = np.concatenate([exact, d2[met].ravel()])
        all_ids = np.concatenate([ids[cols], own[met].ravel()])
        order = np.lexsort((all_ids, all_d2, all_rows))
        first = np.searchsorted(all_rows[order], np.arange(len(met)))
        take = order[(first[:, None] + np.arange(self.k)[None, :]).ravel()]
        d2[met] = all_d2[take].reshape(-1, self.k)
        own[met] = all_ids[take].reshape(-1, self.k)

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        known = np.isfinite(self.d2).ravel()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_ids, self.k)[known]),
                pa.array(self.ids.ravel()[known]),
                pa.array(self.d2.ravel()[known]),
            ],
            names=NEIGHBOURS.names,
        )


def _final(partial: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of the partial results; Spark prunes each map partition to ``k`` first."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "doc_id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k)


def _against_all(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    table = queries.toArrow()
    ids = table.column("_id").to_numpy()
    matrix = docs.sparkSession.sparkContext.broadcast((ids, _matrix(table.column("_vector"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = matrix.value
        best = _Best(vectors, k)
        for batch in batches:
            best.add(batch.column("_id").to_numpy(), _matrix(batch.column("_vector")))
        yield best.batch(query_ids)

    return docs.mapInArrow(scan, NEIGHBOURS)


def _bands(rows: int, width: int, block_rows: int) -> int:
    """Bands for ``rows`` vectors: never more than blocks, and no more than GRID while they fit into BAND_BYTES."""
    return min(-(-rows // block_rows), max(GRID, -(-rows * (width + 1) * 8 // BAND_BYTES))) or 1


def _by_bands(
    docs: DataFrame, queries: DataFrame, k: int, doc_bands: int, query_bands: int
) -> DataFrame:
    """Every band of documents meets every band of queries once.

    Ids are spread by hash, so bands have equal sizes; documents are copied once per query
    band and queries once per document band.
    """

    def grid(df: DataFrame, own: str, own_bands: int, other: str, other_bands: int) -> DataFrame:
        band = F.pmod(F.xxhash64("_id"), F.lit(own_bands)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(other_bands - 1)))
        return df.select("*", band.alias(own), copies.alias(other))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(_matrix(right.column("_vector")), k)
        if left.num_rows and right.num_rows:
            ids = left.column("_id").to_numpy()
            for start in range(0, len(ids), _CHUNK):
                best.add(ids[start : start + _CHUNK], _matrix(left.column("_vector").slice(start, _CHUNK)))
        return pa.Table.from_batches([best.batch(right.column("_id").to_numpy())])

    left = grid(docs, "_db", doc_bands, "_qb", query_bands).groupBy("_db", "_qb")
    right = grid(queries, "_qb", query_bands, "_db", doc_bands).groupBy("_db", "_qb")
    return left.cogroup(right).applyInArrow(cell, NEIGHBOURS)


def knn(
    docs: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest documents of every query: query_id, doc_id, d2, rank.

    Ties go to the smaller id, and with fewer than ``k`` documents there are fewer rows. Counts
    the queries first (an action) to choose between sending them to every task and the grid of
    bands, which have ``block_rows`` rows or more. Either way a task keeps ``k`` candidates per query, never all pairs.
    """
    kept = F.col(vector).isNotNull()
    left = docs.filter(kept).select(
        F.col(doc_id).cast("long").alias("_id"), F.col(vector).alias("_vector")
    )
    right = queries.filter(kept).select(
        F.col(query_id).cast("long").alias("_id"), F.col(vector).alias("_vector")
    )
    n, width = right.agg(F.count("*"), F.coalesce(F.max(F.size("_vector")), F.lit(0))).first()
    if n * (width + 1) * 8 <= broadcast_bytes:
        return _final(_against_all(left, right, k), k)
    doc_bands = _bands(left.count(), width, block_rows)
    return _final(_by_bands(left, right, k, doc_bands, _bands(n, width, block_rows)), k)
