import math

from pyspark.sql import functions as F

from conftest import SMALL
from plain import encoded, vocabulary
from quern.functions import tokens as K
from quern.operators import encoding
from quern.plans import training


def test_vocabulary(documents, document_rows):
    want = vocabulary([d["text"] for d in document_rows], 300)
    got = {r.token: r.token_id for r in encoding.build_vocab(documents, 300).collect()}
    assert got == want


def test_token_arrays_equal_plain_loop(documents, document_rows):
    vocab = encoding.build_vocab(documents, 300)
    want = vocabulary([d["text"] for d in document_rows], 300)
    rows = encoding.encode(documents, vocab, 40, "copy", row_id="doc_id").collect()
    assert len(rows) == len(document_rows)
    texts = {d["doc_id"]: d["text"] for d in document_rows}
    for row in rows:
        ids, mask = encoded(texts[row.doc_id], want, 40)
        assert (row.input_ids, row.attention_mask, row.labels) == (ids, mask, ids)
    masked = encoding.encode(documents, vocab, 40, "masked", row_id="doc_id").collect()
    assert all(r.labels == [t or -100 for t in r.input_ids] for r in masked)


def test_joined_vocabulary_gives_the_same_ids(documents):
    vocab = encoding.build_vocab(documents, 300)
    small = encoding.token_ids(documents, vocab, 40, row_id="doc_id")
    large = encoding.token_ids(documents, vocab, 40, row_id="doc_id", broadcast_words=10)
    assert large.columns == small.columns
    assert large.exceptAll(small).isEmpty() and large.count() == 200


def test_odd_texts(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "..."), (3, "a b"), (4, "é b")], "seq int, text string")
    vocab = spark.createDataFrame([("b", 2)], "token string, token_id int")
    for words in (10, 0):
        ids = {r.seq: r.ids for r in encoding.token_ids(df, vocab, 5, broadcast_words=words).collect()}
        assert ids == {0: [], 1: [], 2: [], 3: [1, 2], 4: [2]}


def test_custom_tokenizer(spark):
    @F.pandas_udf("array<int>")
    def lengths(texts):
        return texts.map(lambda t: [len(w) for w in t.split()])

    df = spark.createDataFrame([(0, "a bbb cc")], "seq int, text string")
    row = encoding.encode(df, None, 2, tokenizer=lengths).first()
    assert row.input_ids == [1, 3] and row.attention_mask == [1, 1]


def test_prefix(spark):
    df = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.text for r in encoding.add_prefix(df, "> ").collect()] == ["> a", "> "]
    for options in ({"instruction": ""}, {"instruction": "> ", "enabled": False}, {"instruction": "", "enabled": True}):
        assert [r.text for r in encoding.add_prefix(df, **options).collect()] == ["a", None]


def test_training_set(spark, documents, document_rows):
    talks = spark.read.parquet(f"{SMALL}/conversations.parquet")
    parts = [
        documents.select(F.col("doc_id").alias("seq"), "text"),
        talks.select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "text"),
    ]
    kept = [r.text for p in parts for r in p.collect() if "licen" not in r.text.lower()]
    rows = training.assemble_training(parts, ["licen"], "Read this: ", 20, vocabulary_size=200).collect()
    vocab = vocabulary(["Read this: " + t for t in kept], 200)
    assert len(rows) == len(kept)
    assert sum(r.split == "test" for r in rows) == math.ceil(0.1 * len(kept))
    for row in rows:
        assert row.text.startswith("Read this: ")
        ids, mask = encoded(row.text, vocab, 22)
        assert (row.input_ids, row.attention_mask, row.labels) == (ids, mask, ids)


def test_classification_set(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = documents.join(labels, "doc_id").withColumnRenamed("doc_id", "seq").select("seq", "text", "quality")
    out = training.assemble_classification([rows], "quality", 16, vocabulary_size=100)
    assert set(out.columns) == {"seq", "text", "labels", "source_rank", "split", "input_ids", "attention_mask"}
    got = out.collect()
    assert len(got) == labels.count() and all(len(r.input_ids) == 16 for r in got)
    assert sum(r.split == "test" for r in got) == math.ceil(0.1 * len(got))


def test_prefix_budget():
    assert training.prefix_tokens("Read this: 2 é texts!") == 4
    assert K.sequence_budget(4) == 260
