"""Centroid clustering with an incremental distance matrix.

Vectors have exactly ``DIMENSIONS`` components, none null or non-finite; others are left out. A component x becomes
the integer floor(1024 x), and all arithmetic after that is exact. Every round assigns each vector to the nearest
centroid (squared Euclidean distance, ties to the smaller number) and then replaces each centroid that has vectors by
the componentwise floor of their mean.

The exact dot products of every vector with every centroid are stored with the vectors. When a centroid moves, only
those of its components that changed are multiplied and added to the stored product; the distance is
|x|^2 - 2 x.c + |c|^2, of which only the middle is per pair. A centroid that stays costs nothing.

A row of the stored table is a block of up to ``BLOCK`` vectors with its products and its sums by cluster. A round
reads the table, updates the products, assigns, and writes the next table; what the centroids need, the sums, are a
small column of their own, added up by an aggregate. So no vector is ever shuffled, whatever share of them one cluster
has, the driver gets some hundred numbers a round, and a lost executor costs the tasks it had. The table before the
last is removed once a round is written.

Numbers whose products might not fit into 64 bits are handled as Python integers, block by block.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import checkpoint_root

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BLOCK = 1024
# Up to this size of a component, distances of DIMENSIONS components fit into 64 bits.
NARROW = 1 << 27
# Sums travel as digits of so many bits, so that adding them up never overflows.
DIGIT = 32
_COUNT, _INERTIA = -1, -2
# Comes after all hashes.
NO_ID = "none"

_SUM = "cluster int, part int, digit int, value long"
_STATE = f"ids array<long>, x binary, dots binary, cluster binary, distance binary, sums array<struct<{_SUM}>>"
_ARROW = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        *((name, pa.binary()) for name in ("x", "dots", "cluster", "distance")),
        ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("part", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())]))),
    ]
)


@dataclass(frozen=True)
class Clusters:
    """Centroids, vectors by cluster and sums of distances, as exact integers."""

    centroids: list[list[int]]
    sizes: list[int]
    inertias: list[int]


def whole(x: float) -> int:
    """floor(1024 x), exactly."""
    return math.floor(x * SCALE) if abs(x) < 2.0**40 else int(x) * SCALE


def _dump(values: np.ndarray) -> bytes:
    """A letter for the kind, then the numbers: 32 or 64 bits each, or decimals."""
    if values.dtype == object:
        return b"W" + " ".join(map(str, values.ravel())).encode()
    return (b"4" if values.dtype == np.int32 else b"8") + values.tobytes()


def _load(data: bytes, width: int) -> np.ndarray:
    if data[:1] == b"W":
        return np.array([int(v) for v in data[1:].split()], dtype=object).reshape(-1, width)
    return np.frombuffer(data, np.int32 if data[:1] == b"4" else np.int64, offset=1).astype(np.int64).reshape(-1, width)


def _block(ids: list, x: np.ndarray, dots: np.ndarray, cluster: np.ndarray, distance: np.ndarray, sums: list) -> pa.RecordBatch:
    x = x if x.dtype == object else x.astype(np.int32)
    sums = [dict(zip(("cluster", "part", "digit", "value"), s, strict=True)) for s in sums]
    values = [ids, *(_dump(v) for v in (x, dots, cluster, distance)), sums]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW, strict=True)], schema=_ARROW)


def _digits(value: int) -> Iterator[tuple[int, int]]:
    place, half = 0, 1 << (DIGIT - 1)
    while not -half <= value < half:
        yield place, value & ((1 << DIGIT) - 1)
        value >>= DIGIT
        place += 1
    yield place, value


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the vectors that count, with products of nothing."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            ids, lists = batch.column(0).slice(at, BLOCK), batch.column(1).slice(at, BLOCK)
            flat = lists.flatten()  # null lists have no part in it
            values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # null becomes NaN
            sizes = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            rows = np.flatnonzero(sizes == DIMENSIONS)
            x = values[begin[rows][:, None] + np.arange(DIMENSIONS)] if len(rows) else np.zeros((0, DIMENSIONS))
            good = np.isfinite(x).all(axis=1)
            rows, x = rows[good], x[good]
            if not len(rows):
                continue
            wide = bool((np.abs(x) * SCALE >= NARROW).any())
            x = np.array([[whole(v) for v in row] for row in x.tolist()], dtype=object) if wide else np.floor(x * SCALE).astype(np.int64)
            none = np.zeros(0, np.int64)
            yield _block(ids.take(pa.array(rows)).to_pylist(), x, np.zeros((len(x), 0), np.int64), none, none, [])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, x) of the vectors of each block that come first, x as decimals."""
    for batch in batches:
        found = []
        for ids, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = _load(data.as_py(), DIMENSIONS)
            hashes = [NO_ID if i is None else hashlib.sha256(f"{SEED}:{i}".encode()).hexdigest() for i in ids]
            last = sorted(hashes)[:CLUSTERS][-1]
            block = [(h, " ".join(map(str, x[i].tolist()))) for i, h in enumerate(hashes) if h <= last]
            found += sorted(block)[:CLUSTERS]
        found = sorted(found)[:CLUSTERS]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["hash", "x"])


def _nearest(x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; argmin takes the first of equal ones."""
    distance = (x * x).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]
    cluster = distance.argmin(axis=1)
    return cluster.astype(np.int64), distance[np.arange(len(x)), cluster]


def _moved(x: np.ndarray, dots: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The products with the ``new`` centroids, from those with the ``old`` and the components that changed."""
    dots = dots.copy()
    for k in range(len(new)):
        changed = np.flatnonzero(new[k] != old[k])
        if len(changed):
            dots[:, k] += x[:, changed] @ (new[k][changed] - old[k][changed])
    return dots


def _round(old: list[list[int]], new: list[list[int]]):
    """A step over the stored blocks: products with ``new`` centroids, nearest ones, sums."""
    wide = any(abs(v) >= NARROW for c in [*old, *new] for v in c)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, dots = (batch.column(c)[i].as_py() for c in range(3))
                x = _load(x, DIMENSIONS)
                kind = object if wide or x.dtype == object else np.int64
                x = x.astype(kind)
                dots = _load(dots, len(new)) if len(dots) > 1 else np.zeros((len(x), len(new)), np.int64)
                dots = _moved(x, dots.astype(kind), np.array(old, kind), np.array(new, kind))
                cluster, distance = _nearest(x, dots, np.array(new, kind))
                sums = []
                for k in np.unique(cluster).tolist():
                    mine = cluster == k
                    parts = [(_COUNT, int(mine.sum())), (_INERTIA, sum(distance[mine].tolist())), *enumerate(x[mine].sum(axis=0).tolist())]
                    sums += [(k, part, digit, value) for part, total in parts for digit, value in _digits(total)]
                stored = x if (np.abs(x) >= NARROW).any() else x.astype(np.int64)
                yield _block(ids, stored, dots, cluster, distance, sums)

    return step


def _summed(state: DataFrame) -> dict[tuple[int, int], int]:
    """The exact total of each part of each cluster; at most some hundred rows come to the driver."""
    totals: dict[tuple[int, int], int] = {}
    sums = state.select(F.explode("sums").alias("s")).select("s.*")
    for r in sums.groupBy("cluster", "part", "digit").agg(F.sum("value").alias("value")).collect():
        totals[r.cluster, r.part] = totals.get((r.cluster, r.part), 0) + (r.value << (DIGIT * r.digit))
    return totals


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, Clusters]:
    """The stored blocks after the last assignment, and the clusters.

    The first centroids are the ``CLUSTERS`` vectors whose ids have the smallest hashes, fewer if there are fewer
    vectors. Vectors without an id come last there, and those of one id in the order of their components' decimals.
    """
    spark = vectors.sparkSession
    folder = f"{checkpoint_root(spark)}/centroids-{uuid.uuid4().hex}"

    def stored(blocks: DataFrame, name: int) -> DataFrame:
        path = f"{folder}/{name}"
        blocks.write.parquet(path)
        return spark.read.schema(_STATE).parquet(path)

    given = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[embedding].cast("array<double>").alias("x"))
    state = stored(given.mapInArrow(_kept, _STATE), 0)
    first = state.select("ids", "x").mapInArrow(_first, "hash string, x string").orderBy("hash", "x").limit(CLUSTERS).collect()
    centroids = [[int(v) for v in r.x.split()] for r in first]
    before = [[0] * DIMENSIONS for _ in centroids]
    if not centroids:
        return state, Clusters([], [], [])
    for n in range(rounds + 1):
        state = stored(state.mapInArrow(_round(before, centroids), _STATE), n + 1)
        _remove(spark, f"{folder}/{n}")
        totals = _summed(state)
        before, last = centroids, [totals.get((k, _COUNT), 0) for k in range(len(centroids))]
        if n < rounds:
            centroids = [[totals.get((k, j), 0) // size for j in range(DIMENSIONS)] if size else c for k, (c, size) in enumerate(zip(centroids, last, strict=True))]
    return state, Clusters(centroids, last, [totals.get((k, _INERTIA), 0) for k in range(len(centroids))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, cluster, distance in zip(*(batch.column(c) for c in range(3)), strict=True):
            distance = [d if d < 1 << 63 else None for d in _load(distance.as_py(), 1).ravel().tolist()]
            arrays = [ids.values, pa.array(_load(cluster.as_py(), 1).ravel(), pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])


def assigned(state: DataFrame) -> DataFrame:
    """vec_id, cluster, distance for each vector that counts; a distance beyond 64 bits is null."""
    return state.select("ids", "cluster", "distance").mapInArrow(_rows, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame) -> DataFrame:
    """One row for each vector that counts: vec_id, cluster, distance, cluster_inertia, inertia, centroid.

    Inertias are sums of distances, null beyond 64 bits; ``centroid`` holds the components as decimals joined by
    commas. Null, short, long and non-finite vectors have no row; repeated rows and ids have one each; other columns
    are not looked at.
    """
    state, clusters = fit(vectors)
    long = lambda v: F.lit(v if v < 1 << 63 else None).cast("long")
    per = [F.struct(long(i).alias("inertia"), F.lit(",".join(map(str, c))).alias("centroid")) for i, c in zip(clusters.inertias, clusters.centroids, strict=True)]
    own = F.get(F.array(*per or [F.struct(long(0).alias("inertia"), F.lit("").alias("centroid"))]), F.col("cluster"))
    return assigned(state).select(
        "vec_id", "cluster", "distance", own["inertia"].alias("cluster_inertia"), long(sum(clusters.inertias)).alias("inertia"), own["centroid"].alias("centroid")
    )
