"""Phrases that are a table themselves: an inverted join by each phrase's rarest run of words, then a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.tokens import words
from quern.session import materialise

# Words of a run that meets the documents; shorter phrases meet them whole.
GRAM = 3

_NO_GRAMS = "array<struct<gram:bigint,at:int>>"


def _grams(tokens: Column, width: int) -> Column:
    """(hash, place) of all runs of ``width`` words."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - width),
        lambda i: F.struct(
            F.xxhash64(F.lit(width), *[F.get(tokens, i + j) for j in range(width)]).alias("gram"), i.alias("at")
        ),
    )
    return F.when(F.size(tokens) >= width, runs).otherwise(F.array().cast(_NO_GRAMS))


def phrase_list(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Distinct phrases by their words: ``phrase``, joined by one space, and ``size``; without those that have no word."""
    tokens = words(F.coalesce(F.col(phrase), F.lit("")))
    listed = phrases.select(F.array_join(tokens, " ").alias("phrase")).filter("phrase <> ''").distinct()
    return listed.withColumn("size", F.size(F.split("phrase", " ")))


def _phrase_grams(listed: DataFrame) -> DataFrame:
    cut = listed.select("phrase", "size", F.split("phrase", " ").alias("_words"))
    grams = _grams(F.col("_words"), GRAM)
    for width in range(1, GRAM):
        grams = F.when(F.col("size") == width, _grams(F.col("_words"), width)).otherwise(grams)
    return cut.select("phrase", "size", F.inline_outer(grams))


def _keys(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """One run of every phrase that may stand in a document: its rarest, with its place in the phrase.

    A phrase with a run that no document has is out already.
    """
    counts = places.groupBy("gram").agg(F.count("*").alias("n"))
    found = wanted.join(counts, "gram").groupBy("phrase", "size")
    rarest = found.agg(F.min(F.struct("n", "at", "gram")).alias("key"), F.count("*").alias("runs"))
    whole = F.col("runs") == F.greatest(F.col("size") - (GRAM - 1), F.lit(1))
    return rarest.filter(whole).select("phrase", "size", F.col("key.gram"), F.col("key.at").alias("offset"))


def phrase_places(
    docs: DataFrame, phrases: DataFrame, text: str = "text", doc_id: str = "doc_id", phrase: str = "phrase"
) -> DataFrame:
    """Every place where a phrase's words stand consecutively: ``doc_id``, ``phrase``, ``start`` (words from 0).

    Words are runs of ASCII letters and digits in lower case, on both sides. Neither side has a size limit: only runs of words
    that some phrase has leave the documents' map side, and the phrase goes to the places of its rarest run, so
    a frequent word costs nothing unless a phrase has no rarer. What the hashes let through is compared word by word
    while documents and candidates are merged. Ids are unique; a null id has no places, a null text has no words,
    equal phrases count once. The runs found are stored (an action), so the result follows later changes of the
    texts no more.
    """
    listed = materialise(phrase_list(phrases, phrase), "phrases")
    wanted = _phrase_grams(listed)
    widths = [r[0] for r in listed.select(F.least("size", F.lit(GRAM))).distinct().collect()]
    cut = docs.select(F.col(doc_id).alias("doc_id"), words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    if not widths:
        return cut.select("doc_id", F.lit("").alias("phrase"), F.lit(0).alias("start")).limit(0)
    # An inner explode would get a filter on its array, which cuts the text once for every word.
    runs = cut.select("doc_id", F.inline_outer(F.concat(*[_grams(F.col("_words"), w) for w in sorted(widths)])))
    places = materialise(runs.join(wanted.select("gram").distinct(), "gram", "left_semi"), "places")
    keys = _keys(wanted, places)
    candidates = places.join(keys, "gram").select(
        F.col("doc_id").alias("_of"), "phrase", "size", (F.col("at") - F.col("offset")).alias("start")
    )
    here = F.array_join(F.slice("_words", F.col("start") + 1, F.col("size")), " ")
    met = (F.col("doc_id") == F.col("_of")) & (here == F.col("phrase"))
    return cut.join(candidates.filter("start >= 0"), met).select("doc_id", "phrase", "start")


def phrase_counts(places: DataFrame) -> DataFrame:
    """Places and documents of every phrase found; the second count meets on (phrase, document) first."""
    by_document = places.groupBy("phrase", "doc_id").agg(F.count("*").alias("n"))
    return by_document.groupBy("phrase").agg(F.sum("n").alias("places"), F.count("*").alias("documents"))
