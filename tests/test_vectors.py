import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SMALL
from plain import nearest, words
from quern.functions.vectors import squared_l2
from quern.operators import embedding, neighbours, prompts
from quern.plans import retrieval


def frame(spark, vectors, name):
    return spark.createDataFrame([(i, v) for i, v in vectors], f"{name} long, embedding array<float>")


def found(df):
    return sorted((r.query_id, r.rank, r.doc_id) for r in df.collect())


def test_embeddings_equal_plain_loop(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(120)
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want = sorted(nearest(rows, rows, 5))
    docs, asked = frame(spark, rows, "doc_id").repartition(3), frame(spark, rows, "query_id")
    assert found(neighbours.knn(docs, asked)) == want
    for block_rows in (1000, 50, 7):
        assert found(neighbours.knn(docs, asked, broadcast_bytes=0, block_rows=block_rows)) == want


def test_copies_grow_no_faster_than_the_rows(spark, monkeypatch):
    """However small the blocks, a vector meets at most GRID bands; each gives k candidates."""
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.random())) for _ in range(3)]) for i in range(400)]
    docs, asked = frame(spark, rows, "doc_id"), frame(spark, rows, "query_id")
    assert found(neighbours.knn(docs, asked, k=2, broadcast_bytes=0, block_rows=4)) == sorted(nearest(rows, rows, 2))
    monkeypatch.setattr(neighbours, "_final", lambda partial, k: partial)
    assert neighbours.knn(docs, asked, k=2, broadcast_bytes=0, block_rows=4).count() <= 400 * 2 * 16
    # Bands have a bounded size, so there are more of them for very many vectors.
    assert neighbours._bands(10_000_000, 64, 300) == 78


def test_ties_and_few_vectors(spark):
    vectors = [(9, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0])]
    docs, asked = frame(spark, vectors, "doc_id"), frame(spark, [(1, [1.0, 0.0])], "query_id")
    want = [(1, 1, 3), (1, 2, 9), (1, 3, 5)]
    assert found(neighbours.knn(docs, asked)) == want
    assert found(neighbours.knn(docs, asked, broadcast_bytes=0)) == want
    assert found(neighbours.knn(docs, asked, k=2)) == want[:2]
    assert found(neighbours.knn(docs.limit(0), asked)) == []
    assert found(neighbours.knn(docs, asked.limit(0))) == []
    assert found(neighbours.knn(docs.limit(0), asked, broadcast_bytes=0)) == []


def test_many_equal_vectors(spark):
    """Ties across batches and blocks are all decided by the id."""
    vectors = [(i, [float(i % 3), 1.0, 0.5]) for i in range(400)]
    asked = [(i, [float(i), 1.0, 0.5]) for i in range(3)]
    want = sorted(nearest(vectors, asked, 7))
    docs, queries = frame(spark, vectors, "doc_id").repartition(5), frame(spark, asked, "query_id")
    assert found(neighbours.knn(docs, queries, k=7)) == want
    assert found(neighbours.knn(docs, queries, k=7, broadcast_bytes=0, block_rows=60)) == want


def test_close_distances_far_from_the_origin(spark):
    """The product form alone would lose these differences."""
    rng = random.Random(2)
    vectors = [(i, [float(np.float32(5000 + rng.random())), float(np.float32(-7000 + rng.random()))]) for i in range(300)]
    docs, asked = frame(spark, vectors, "doc_id"), frame(spark, vectors[:40], "query_id")
    assert found(neighbours.knn(docs, asked)) == sorted(nearest(vectors, vectors[:40], 5))


def test_missing_vectors_are_left_out(spark):
    docs = frame(spark, [(1, [1.0]), (2, None)], "doc_id")
    asked = frame(spark, [(7, [0.0]), (8, None)], "query_id")
    assert found(neighbours.knn(docs, asked)) == [(7, 1, 1)]


def test_squared_distance(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert df.select(squared_l2(F.col("a"), F.col("b")).alias("d")).first().d == 25.0


def test_hashed_tfidf_equals_plain_loop(spark, documents, document_rows):
    dimensions = 64
    weights = embedding.fit_weights(documents, dimensions=dimensions)
    got = {r.doc_id: r.embedding for r in embedding.embed(documents, weights=weights, dimensions=dimensions).collect()}

    def bucket(word):
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimensions

    counts = []
    for row in document_rows:
        vector = [0] * dimensions
        for word in words(row["text"]):
            vector[bucket(word)] += 1
        counts.append(vector)
    n = len(counts)
    idf = [math.log((n + 1) / (sum(1 for c in counts if c[j]) + 1)) for j in range(dimensions)]
    for row, vector in zip(document_rows, counts):
        weighted = [c * w for c, w in zip(vector, idf)]
        norm = math.sqrt(sum(w * w for w in weighted)) or 1.0
        assert np.allclose(got[row["doc_id"]], [w / norm for w in weighted], atol=1e-6)


def test_contexts_follow_rank(spark):
    near = spark.createDataFrame([(1, 30, 0.0, 1), (1, 10, 0.5, 2), (2, 10, 0.1, 1)], "query_id long, doc_id long, d2 double, rank int")
    docs = spark.createDataFrame([(10, "ten"), (30, "thirty"), (40, "forty")], "doc_id long, text string")
    got = {r.query_id: r.context for r in prompts.contexts(near, docs).collect()}
    assert got == {1: "thirty\nten", 2: "ten"}


def test_store_and_ask(spark, documents, tmp_path):
    path = str(tmp_path / "store")
    weights = embedding.fit_weights(documents)
    retrieval.build_store(documents.select("doc_id", "text"), path, weights=weights)
    asked = documents.filter("doc_id in (3, 8)").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    rows = retrieval.ask(spark, path, asked, k=2, weights=weights).collect()
    assert {r.query_id for r in rows} == {3, 8}
    source = {r.doc_id: r.text for r in documents.collect()}
    for row in rows:
        # A document is its own nearest neighbour, or an equal one with a smaller id is.
        assert row.context.startswith(source[row.query_id])
        assert row.prompt.endswith("\n\nQuestion: " + source[row.query_id])


def test_custom_encoder(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "aaaa")], "doc_id long, text string")
    encoded = embedding.embed(docs, lambda text: F.array(F.length(text).cast("float")))
    assert [list(r.embedding) for r in encoded.orderBy("doc_id").collect()] == [[2.0], [4.0]]
