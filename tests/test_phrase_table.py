import random

from pyspark.sql import functions as F

from plain import phrase_places
from quern.operators import phrase_table


def found(spark, texts, phrases):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    rows = phrase_table.phrase_places(docs, listed).collect()
    return sorted((r.doc_id, r.phrase, r.start) for r in rows)


def test_random_texts_equal_plain_scan(spark):
    draw = random.Random(5)
    vocabulary = ["a", "b", "c", "dé", "E1", "f"]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randrange(60))) for _ in range(60)]
    phrases = [" ".join(draw.choices(vocabulary, k=draw.randrange(1, 9))) for _ in range(80)]
    want = phrase_places(texts, phrases)
    assert found(spark, texts, phrases) == want and len(want) > 500


def test_edges(spark):
    texts = [None, "", "...", "One-two three", "one two", "two three one two three", "a a a a a"]
    phrases = [None, "", "!?", "ONE two", "one  two", "two, three.", "one two three four", "a a a", "three"]
    assert found(spark, texts, phrases) == phrase_places(texts, phrases)
    assert (3, "one two", 0) in found(spark, texts, phrases)


def test_nothing_on_one_side(spark):
    assert found(spark, ["one two"], []) == [] == found(spark, [], ["one two"])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert phrase_table.phrase_places(empty, empty, phrase="text").columns == ["doc_id", "phrase", "start"]


def test_hot_word_and_long_text(spark):
    texts = ["the " * 30_000 + "needle in the hay", "the " * 200]
    assert found(spark, texts, ["needle in the hay", "the the needle"]) == [
        (0, "needle in the hay", 30_000), (0, "the the needle", 29_998)
    ]


def test_clashing_columns_and_counts(spark):
    rows = [(1, "one two one two", 7, 8, "x"), (2, "one two", 7, 8, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gram long, at int, phrase string")
    listed = spark.createDataFrame([("one two", 3)], "phrase string, doc_id int")
    places = phrase_table.phrase_places(docs, listed)
    assert places.columns == ["doc_id", "phrase", "start"]
    assert [tuple(r) for r in phrase_table.phrase_counts(places).collect()] == [("one two", 3, 2)]


def test_only_runs_of_phrases_leave_the_documents(documents):
    """The rarest run decides: a phrase with a run that no document has meets none."""
    listed = phrase_table.phrase_list(documents.limit(3).select(F.substring_index("text", " ", 6).alias("phrase")))
    grams = phrase_table._phrase_grams(listed)
    assert grams.groupBy("phrase").count().count() == listed.count()
    nowhere = grams.select("gram", F.lit(0).alias("at"), F.lit(1).alias("doc_id")).limit(0)
    assert phrase_table._keys(grams, nowhere).isEmpty()
