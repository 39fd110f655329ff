"""Build a vector store and answer batches of questions from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from quern import sinks
from quern.operators.embedding import embed
from quern.operators.neighbours import TOP_K
from quern.operators.prompts import rag_prompts


def build_store(
    docs: DataFrame,
    path: str,
    encoder: Callable[[Column], Column] | None = None,
    weights: Sequence[float] | None = None,
    doc_id: str = "doc_id",
) -> None:
    """Write doc_id, text and embedding of every document."""
    sinks.write_vectors(embed(docs, encoder, weights).withColumnRenamed(doc_id, "doc_id"), path)


def ask(
    spark: SparkSession,
    store: str,
    questions: DataFrame,
    k: int = TOP_K,
    encoder: Callable[[Column], Column] | None = None,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """Prompts for a table of (query_id, question)."""
    asked = embed(questions, encoder, weights, text="question")
    return rag_prompts(spark.read.parquet(store), asked, k)
