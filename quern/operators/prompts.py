"""Prompts with retrieved context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import prompt
from quern.operators.neighbours import TOP_K, knn


def contexts(neighbours: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per query: the neighbours' texts in rank order, one per line.

    A document that is near very many queries makes its join key hot; adaptive execution splits
    such partitions of the neighbour side. A group has at most ``k`` texts.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "_text")))
    return (
        neighbours.join(texts, "doc_id")
        .groupBy("query_id")
        .agg(ranked.alias("_ranked"))
        .select("query_id", F.array_join(F.col("_ranked._text"), "\n").alias("context"))
    )


def rag_prompts(
    docs: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    text: str = "text",
    question: str = "question",
    vector: str = "embedding",
) -> DataFrame:
    """Answer-ready prompts for a batch of questions: query_id, context, prompt."""
    near = knn(docs, queries, k, doc_id, query_id, vector)
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(question).alias("_q"))
    return (
        contexts(near, docs, doc_id, text)
        .join(asked, "query_id")
        .select("query_id", "context", prompt(F.col("context"), F.col("_q")).alias("prompt"))
    )
