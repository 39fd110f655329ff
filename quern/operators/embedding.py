"""Document vectors: any encoder as a pandas UDF, or a built-in hashed TF-IDF."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.tokens import words

DIMENSIONS = 256


def word_dimension(word: str, dimensions: int) -> int:
    """The first 32 bits of the word's md5 modulo the number of dimensions."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dimensions


def _counts(lists: pa.Array, dimensions: int) -> np.ndarray:
    """One row of hashed term counts for each list of words."""
    coded = pc.dictionary_encode(lists.flatten())
    place = np.array([word_dimension(w, dimensions) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), lengths)
    at = of * dimensions + place[coded.indices.to_numpy(zero_copy_only=False)]
    return np.bincount(at, minlength=len(lists) * dimensions).reshape(-1, dimensions)


def _listed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, dimensions = rows.shape
    offsets = pa.array(np.arange(n + 1) * dimensions, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))


def _words(text: str) -> Column:
    return words(F.coalesce(F.col(text), F.lit("")))


def fit_weights(df: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> list[float]:
    """Inverse document frequencies of a corpus: one pass, one number per dimension (an action)."""

    @F.arrow_udf("array<long>")
    def counted(lists: pa.Array) -> pa.Array:
        return _listed(_counts(lists, dimensions), pa.int64())

    seen = df.select(F.posexplode(counted(_words(text))).alias("dimension", "n"))
    found = seen.groupBy("dimension").agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("documents")).collect()
    weights = [0.0] * dimensions
    for r in found:
        weights[r["dimension"]] = math.log((r["rows"] + 1) / (r["documents"] + 1))
    return weights


def embed(
    df: DataFrame,
    encoder: Callable[[Column], Column] | None = None,
    weights: Sequence[float] | None = None,
    text: str = "text",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """Add ``embedding``: ``encoder(text)``, or unit-length hashed TF-IDF vectors.

    Documents and questions must share the encoder, or the ``weights`` of one corpus. A text without words has
    the zero vector.
    """
    if encoder is not None:
        return df.withColumn("embedding", encoder(F.col(text)))
    factors = np.ones(dimensions) if weights is None else np.array(weights, dtype=np.float64)

    @F.arrow_udf("array<float>")
    def unit(lists: pa.Array) -> pa.Array:
        weighted = _counts(lists, dimensions) * factors
        length = np.sqrt((weighted * weighted).sum(axis=1, keepdims=True))
        return _listed((weighted / np.where(length > 0, length, 1.0)).astype(np.float32), pa.float32())

    return df.withColumn("embedding", unit(_words(text)))
