"""One query per operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import commits, sinks
from quern.functions import text as T
from quern.functions import tokens as K
from quern.functions.records import joined_responses, pick_text, with_json_text
from quern.functions.vectors import squared_l2
from quern.operators import dedup, embedding, encoding, flagging, inventory, mixing
from quern.operators import neighbours, ordering, phrase_table, prompts, runlog, validation
from quern.plans import corpus, mixture, training
from quern.session import checkpoint_root
from quern.sources import documents as document_files
from quern.sources import lines as line_files
from quern.sources import registry
from quern.sources.paths import file_names, is_directory, rename_file
from quern.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]

# A neutral policy that finds something in the given texts.
PATTERNS = (r"licen[cs]e[ds]?", r'token = "[0-9a-f]+', r"all rights reserved")
CONTEXT = ("from", "est")
PHRASES = ("license", "all rights reserved", "information", "the of")
REDACTED = ("all rights reserved", "license", "the of", "red")
BANNED = ("password", "all rights reserved", "secret", "licen")
BANNED_LETTERS = 10
INSTRUCTION = "Summarise the following text: "
HEAD = 10
VOCABULARY = 1000
QUICK_ROWS = 50
PHRASE_WORDS = 5
FILES_PER_FOLDER = 200

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def listed(array: Column | str) -> Column:
    """An array as text, so that engines compare values and not list types."""
    column = F.col(array) if isinstance(array, str) else array
    return F.array_join(column.cast("array<string>"), " ")


# Text and duplicates


@query
def normalise_text(spark, sf):
    """Documents padded with Unicode blanks, every French one reduced to blanks."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "fr", "  \n")
        .otherwise(F.concat(F.lit("　\n "), "text", F.lit("\t ")))
        .alias("text"),
    )
    return flagging.normalise(docs)


@query
def dedup_exact_first(spark, sf):
    docs = table(spark, sf, "documents")
    return dedup.dedup_exact(docs, order=["doc_id"]).select("doc_id", "lang", "source", "n_chars")


@query
def dedup_report(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup.dedup_report(docs, "text", "doc_id").select("doc_id", "is_duplicate")


@query
def root_dedup(spark, sf):
    """Page hosts in changing case, the first of every host kept."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    roots = table(spark, sf, "pages").select(
        "page_id", F.when(F.col("page_id") % 2 == 0, F.upper(host)).otherwise(host).alias("root")
    )
    return dedup.dedup_report(roots, "root", "page_id", lower=True)


# Phrase policies


@query
def flag_context(spark, sf):
    """Flagged distinct documents with their counting matches and excerpts.

    The raw-hit filter depends on the text alone, so it runs before equal texts are merged and
    only rows with a hit are shuffled.
    """
    docs = flagging.normalise(table(spark, sf, "documents").select("doc_id", "text"))
    unique = dedup.dedup_exact(flagging.raw_hits(docs, PATTERNS), order=["doc_id"], carry=True)
    hit = flagging.flagged(unique, PATTERNS, CONTEXT)
    return sinks.quarantine_rows(hit, "doc_id").withColumnRenamed("index", "doc_id")


@query
def flag_split_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return flagging.flag_counts(flagging.flag_phrases(docs, PATTERNS, CONTEXT))


@query
def retained_rows(spark, sf):
    return flagging.retained(table(spark, sf, "documents"), PATTERNS, CONTEXT).select("doc_id", "n_chars")


@query
def phrase_scan(spark, sf):
    return flagging.scan_phrases(table(spark, sf, "documents").select("doc_id", "text"), PHRASES)


@query
def phrase_summary(spark, sf):
    return flagging.phrase_summary(table(spark, sf, "documents"), PHRASES)


@query
def blocklist_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return flagging.has_phrase(docs, PHRASES).select("doc_id", "blocked")


@query
def banned_word_filter(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text")
    talks = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "text")
    kept = flagging.filter_banned(mixing.concat_sources([docs, talks]), BANNED)
    return kept.select("source_rank", "seq", F.length("text").alias("characters"))


def _listed_places(spark, sf):
    """Places of the benchmark's runs of five words in the documents."""
    items = table(spark, sf, "benchmark").select(K.words(F.col("text")).alias("own"))
    starts = F.sequence(F.lit(1), F.size("own") - (PHRASE_WORDS - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("own", i, PHRASE_WORDS), " "))
    runs = F.when(F.size("own") >= PHRASE_WORDS, runs)
    phrases = items.select(F.explode_outer(runs).alias("phrase"))
    return phrase_table.phrase_places(table(spark, sf, "documents"), phrases)


@query
def phrase_table_places(spark, sf):
    return _listed_places(spark, sf)


@query
def phrase_table_counts(spark, sf):
    return phrase_table.phrase_counts(_listed_places(spark, sf))


@query
def redact_phrases(spark, sf):
    return flagging.redact(table(spark, sf, "documents").select("doc_id", "text"), REDACTED)


# Records and projections


@query
def record_text_keys(spark, sf):
    """Turns as JSON lines whose text sits under changing keys, read with both fallbacks."""
    turn = F.col("turn") % 4
    line = (
        F.when(turn == 0, F.to_json(F.struct("text", "role")))
        .when(turn == 1, F.to_json(F.struct(F.col("text").alias("prompt"), "turn")))
        .when(turn == 2, F.to_json(F.struct(F.lit("").alias("text"), F.lit(0).alias("prompt"), F.col("text").alias("content"))))
        .otherwise(F.to_json(F.struct("role", "turn", F.lit(" ").alias("gap"), F.col("text").alias("body"))))
    )
    lines = table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))
    first = with_json_text(lines, "line", fallback="first", text="first_text")
    both = with_json_text(first, "line", fallback="join", text="joined_text")
    return both.drop("line")


@query
def row_as_json(spark, sf):
    talks = table(spark, sf, "conversations").withColumnRenamed("text", "body")
    return talks.select("conv_id", "turn", pick_text(talks))


@query
def instruction_prefix(spark, sf):
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return encoding.add_prefix(talks, INSTRUCTION)


@query
def cells_joined(spark, sf):
    blank_some = F.when(F.col("c_nationkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment"))
    cells = [F.col("c_name"), blank_some, F.col("c_nationkey").cast("string")]
    return table(spark, sf, "customer").select("c_custkey", T.join_cells(cells).alias("text"))


@query
def ndjson_concat(spark, sf):
    """Every turn's words as a response stream with a broken line at its end."""
    words = F.transform(
        F.split("text", " "), lambda w: F.to_json(F.struct(F.concat(w, F.lit(" ")).alias("response")))
    )
    body = F.concat(F.array_join(words, "\n"), F.lit('\n\n{"response": 5}\n{"response": "lost'))
    return table(spark, sf, "conversations").select("conv_id", "turn", joined_responses(body).alias("answer"))


@query
def name_rules(spark, sf):
    """Safe names, cache names and families of names made of source and language."""
    family = (
        F.when(F.col("lang") == "en", "Llama-2")
        .when(F.col("lang") == "de", "Qwen")
        .when(F.col("lang") == "fr", "dphn_x")
        .otherwise("Other")
    )
    name = F.concat_ws("/", "source", family)
    kind = F.when(F.col("lang") == "en", "dataset").when(F.col("lang") == "es", "media").otherwise("model")
    return table(spark, sf, "documents").select(
        "doc_id",
        T.safe_name(name).alias("safe"),
        T.cache_name(name, kind).alias("cache"),
        T.name_family(family).alias("family"),
    )


# Order, limits, mixing and splits


@query
def source_head_n(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return ordering.head_per_source(docs, HEAD, "source", ["doc_id"])


def _three_sources(spark, sf):
    return [
        table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text"),
        table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "text"),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), "text"),
    ]


@query
def mix_capped(spark, sf):
    return mixing.mix_sources(_three_sources(spark, sf), shuffle=True)


@query
def concat_sources(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("seq"), "url")
    return mixing.concat_sources([*_three_sources(spark, sf)[:2], None, pages])


@query
def quick_subset(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ordering.first_rows(docs, QUICK_ROWS, ["doc_id"])


@query
def shuffled_order(spark, sf):
    """The seeded order itself: every document's key and its place among all keys."""
    docs = ordering.shuffle_rows(table(spark, sf, "documents").select("doc_id"), ["doc_id"])
    return ordering.assign_seq(docs, ["shuffle_key", "doc_id"], "place")


@query
def train_test_split(spark, sf):
    return ordering.split_exact(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query
def train_test_buckets(spark, sf):
    return ordering.split_by_bucket(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


# Token arrays and training sets


@query
def vocab_topn(spark, sf):
    return encoding.build_vocab(table(spark, sf, "documents").select("text"), VOCABULARY)


@query
def token_arrays(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = encoding.encode(
        docs, encoding.build_vocab(docs, VOCABULARY), K.QUICK_RUN_LENGTH, "masked", row_id="doc_id"
    )
    return coded.select(
        "doc_id",
        listed("input_ids").alias("input_ids"),
        listed("attention_mask").alias("attention_mask"),
        listed("labels").alias("labels"),
    )


def _training_rows(spark, sf):
    return training.assemble_training(
        _three_sources(spark, sf)[:2], BANNED, INSTRUCTION, vocabulary_size=VOCABULARY
    )


@query
def training_set(spark, sf):
    return _training_rows(spark, sf).select(
        "source_rank", "seq", "split", listed("input_ids").alias("input_ids"),
        listed("labels").alias("labels"),
    )


@query
def training_set_stats(spark, sf):
    mask = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        _training_rows(spark, sf)
        .groupBy("split")
        .agg(F.count("*").alias("examples"), F.sum(mask).alias("tokens"))
    )


@query
def classification_set(spark, sf):
    """Labelled documents; the labels table is keyed by document, so neither side is skewed."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    rows = rows.withColumnRenamed("doc_id", "seq")
    coded = training.assemble_classification([rows], "quality", vocabulary_size=VOCABULARY)
    return coded.select(
        "seq", "labels", "split", listed("input_ids").alias("input_ids"),
        listed("attention_mask").alias("attention_mask"),
    )


# Retrieval


@query
def vector_distance(spark, sf):
    """The distance of every vector to the one after it."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = vectors.join(after, "vec_id")
    return pairs.select("vec_id", F.round(squared_l2(F.col("embedding"), F.col("other")), 6).alias("d2"))


def _store(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query
def knn_top5(spark, sf):
    docs = _store(spark, sf)
    near = neighbours.knn(docs, docs.withColumnRenamed("doc_id", "query_id"))
    return near.select("query_id", "doc_id", F.round("d2", 6).alias("d2"), "rank")


@query
def knn_blocks(spark, sf):
    """The same neighbours by the block grid that large question sets take."""
    docs = _store(spark, sf)
    near = neighbours.knn(
        docs, docs.withColumnRenamed("doc_id", "query_id"), broadcast_bytes=0, block_rows=300
    )
    return near.select("query_id", "doc_id", F.round("d2", 6).alias("d2"), "rank")


@query
def rag_prompts(spark, sf):
    """Every stored document asked about, by its language and source."""
    docs = table(spark, sf, "documents").join(_store(spark, sf), "doc_id")
    asked = docs.select(
        F.col("doc_id").alias("query_id"),
        F.concat(F.lit("What does "), "source", F.lit(" say in "), "lang", F.lit("?")).alias("question"),
        "embedding",
    )
    return prompts.rag_prompts(docs.select("doc_id", "text", "embedding"), asked)


@query
def tfidf_neighbours(spark, sf):
    """Benchmark items as questions over documents, both with hashed TF-IDF vectors."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    weights = embedding.fit_weights(docs)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    near = neighbours.knn(embedding.embed(docs, weights=weights), embedding.embed(asked, weights=weights))
    return near.select("query_id", "doc_id", F.round("d2", 6).alias("d2"), "rank")


# Checks, logs and listings


@query
def validation_report(spark, sf):
    docs = table(spark, sf, "documents")
    return validation.validation_report(docs, ["text", "lang", "summary"], min_size=5_000_000_000)


@query
def dataset_metadata(spark, sf):
    made = validation.dataset_metadata(table(spark, sf, "documents"))
    return made.select("length", listed("columns").alias("columns"))


@query
def estimated_length(spark, sf):
    return validation.estimated_length(table(spark, sf, "events"))


@query
def latest_by_kind(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.col("event_id").alias("path")
    )
    newest = registry.latest_by_kind(events)
    return newest.select("kind", "path", T.log_timestamp(F.col("created_at")).alias("created_at"))


@query
def committed_dataset(spark, sf):
    """All documents as a stored dataset, found through the catalog beside a newer one whose write was not finished."""
    root = scratch(spark, "datasets")
    commits.write_committed(table(spark, sf, "documents"), f"{root}/custom_dataset_1")
    commits.begin(spark, f"{root}/sanitized_dataset_2")
    table(spark, sf, "benchmark").write.mode("append").parquet(f"{root}/sanitized_dataset_2")
    path = registry.preferred_dataset(registry.stored_datasets(spark, root)).first().path
    told = commits.record(spark, path)
    damaged = F.lit(not commits.damage(spark, path).isEmpty())
    stored = registry.read_dataset(spark, path)
    return stored.select("doc_id", F.md5("text").alias("text_md5"), F.lit(told["rows"]).cast("long").alias("n"), damaged.alias("damaged"))


@query
def preferred_dataset(spark, sf):
    """Purchases stand for sanitized datasets, clicks for custom ones, the rest for other folders."""
    prefix = (
        F.when(F.col("event_type") == "purchase", "sanitized_dataset_")
        .when(F.col("event_type") == "click", "custom_dataset_")
        .otherwise("other_")
    )
    path = F.concat(F.lit("/data/"), prefix, F.col("event_id").cast("string"))
    catalog = table(spark, sf, "events").select(path.alias("path"), F.col("ts").alias("created_at"))
    catalog = catalog.withColumn("kind", registry.dataset_kind(F.col("path")))
    return registry.preferred_dataset(catalog).select("kind", "path")


def _statuses(spark, sf):
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "skipped")
        .otherwise("success")
    )
    return table(spark, sf, "events").select("event_id", "user_id", status.alias("status"))


@query
def status_summary(spark, sf):
    return runlog.status_summary(_statuses(spark, sf))


@query
def failed_items(spark, sf):
    return runlog.failures(_statuses(spark, sf)).select("event_id", "user_id")


@query
def run_log_rows(spark, sf):
    events = table(spark, sf, "events").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.lit("loader").alias("component"),
        F.col("event_type").alias("message"),
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("user"),
        F.when(F.col("event_type") != "view", F.col("props")).alias("detail"),
    )
    return runlog.log_rows(events, ["user", "detail"])


def _page_files(spark, sf):
    """Pages as files: the host is the root's entry, the language the category."""
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    host = parts[0]
    return table(spark, sf, "pages").select(
        F.lit("/old").alias("root"),
        F.when(parts[1] == "en", "models").when(parts[1] == "de", "datasets").otherwise("cache").alias("category"),
        F.concat(
            F.when(host.startswith("m."), ".").otherwise(""), host, F.lit("/"), F.col("page_id").cast("string"),
            F.lit("-"), parts[2],
        ).alias("path"),
        F.length("html").cast("long").alias("length"),
    )


@query
def entry_sizes(spark, sf):
    return inventory.entry_sizes(_page_files(spark, sf))


@query
def size_rollup(spark, sf):
    return inventory.size_rollup(_page_files(spark, sf))


@query
def move_plan(spark, sf):
    """Hosts with an .html page are taken already."""
    files = _page_files(spark, sf)
    folders = {"models": "/new/models", "datasets": "/new/datasets"}
    folder = F.when(F.col("category") == "models", "/new/models").when(
        F.col("category") == "datasets", "/new/datasets"
    ).otherwise("/new/cache")
    taken = files.filter(F.col("path").endswith(".html")).select(
        F.concat_ws("/", folder, inventory.entry_of(F.col("path"))).alias("destination")
    )
    return inventory.plan_moves(files, taken, folders, "/new/cache")


@query
def format_flags(spark, sf):
    """Page paths renamed to look like weights, one root per host."""
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    name = (
        F.when(F.col("url").endswith(".html"), "W.GGUF")
        .when(F.col("url").endswith("#top"), "w.safetensors")
        .when(F.col("url").contains("utm_source"), "my-GPTQ.pt")
        .otherwise("w.bin")
    )
    files = table(spark, sf, "pages").select(
        parts[0].alias("root"), F.concat_ws("/", parts[1], name).alias("path")
    )
    return inventory.format_flags(files)


@query
def snapshot_state(spark, sf):
    """Hosts as repositories, their pages as the files of a download cache."""
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    area = F.when(parts[1] == "en", "snapshots").when(parts[1] == "fr", "refs").otherwise("downloads")
    ending = (
        F.when(F.col("url").contains("utm_source"), ".partial")
        .when(F.col("url").endswith("#top"), ".tmp")
        .otherwise("")
    )
    number = F.regexp_extract(parts[2], "^[0-9]+", 0)
    path = F.when(area == "snapshots", F.concat(area, F.lit("/rev/"), number, ending)).otherwise(
        F.concat(area, F.lit("/"), number, ending)
    )
    pages = table(spark, sf, "pages").select(parts[0].alias("repo"), path.alias("path"), F.lit(False).alias("is_dir"))
    return inventory.snapshot_state(pages.select("repo").distinct(), pages)


# Sources and sinks: tables written in one format and read back by its reader


@query
def csv_text_column(spark, sf):
    """Conversations as CSV files with a text column."""
    path = scratch(spark, "csv")
    table(spark, sf, "conversations").select("conv_id", F.col("text").alias("Text"), "role").write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return document_files.read_csv_documents(spark, path).select("text")


@query
def csv_joined_cells(spark, sf):
    """Customers as CSV files without a text column."""
    path = scratch(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.csv(
        path, header=True
    )
    return document_files.read_csv_documents(spark, path).select("text")


@query
def csv_headerless(spark, sf):
    """Suppliers as a CSV file whose blank first line says that it has no header."""
    path = scratch(spark, "csv")
    quoted = F.concat(F.lit('"'), "s_name", F.lit(', Ltd"'))
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat_ws(",", "s_suppkey", quoted, "s_nationkey").alias("line"))
    blank = spark.createDataFrame([(None, "")], "s_suppkey long, line string")
    rows.unionByName(blank).orderBy(F.col("s_suppkey").asc_nulls_first()).select("line").coalesce(1).write.text(path)
    for name in file_names(spark, path):
        if name.endswith(".txt"):
            rename_file(spark, name, f"{name}.csv")
    return document_files.read_csv_documents(spark, path).select("text")


@query
def text_folder(spark, sf):
    """Pages as text files, one each; a task's rows of one id share a file."""
    path = scratch(spark, "texts")
    pages = table(spark, sf, "pages")
    folders = -(-pages.count() // FILES_PER_FOLDER) or 1
    own = ["page_id", "part"]
    rows = pages.select("page_id", F.spark_partition_id().alias("part"), F.concat(F.lit(" \n"), "html").alias("line"))
    lines = F.array_join(F.collect_list(F.coalesce("line", F.lit(""))), "\n")
    files = rows.repartition(folders, *own).groupBy(*own).agg(lines.alias("value"))
    files = files.select("value", F.pmod(F.hash(*own), F.lit(folders)).alias("folder"))
    # Folders of many files, moved by the tasks that wrote them: a folder for each file is made, moved and listed one by one.
    writer = files.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    writer.partitionBy("folder").text(path)
    return document_files.read_text_documents(spark, f"{path}/*").select("text")


@query
def mixed_folder(spark, sf):
    """Documents as CSV cells of many commas and the benchmark as one text file, built into a corpus."""
    path, root = scratch(spark, "folder"), scratch(spark, "built")
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit(", ")).alias("text"))
    docs.write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    items = table(spark, sf, "benchmark").orderBy("item_id").select("text")
    items.coalesce(1).write.mode("append").text(path)
    done = corpus.build_corpus(spark, path, root)
    counted = spark.read.json(done.metadata).select(F.lit("metadata").alias("text"), F.col("document_count").alias("documents"))
    stored = spark.read.parquet(done.dataset).select("text", F.lit(1).cast("long").alias("documents"))
    return stored.unionByName(counted)


@query
def clean_copy(spark, sf):
    """A stored dataset's clean copy and the counts in its metadata."""
    path, root = scratch(spark, "stored"), scratch(spark, "clean")
    table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text").write.parquet(path)
    done = corpus.sanitize(spark, path, corpus.Policy(PATTERNS, CONTEXT), root, stamp="now")
    counts = spark.read.json(f"{root}/metadata/sanitization_now").select(
        F.lit("metadata").alias("kind"), F.col("flagged_examples").alias("a"), F.col("retained_examples").alias("b")
    )
    kept = spark.read.parquet(done.dataset).select(
        F.lit("row").alias("kind"), F.col("seq").alias("a"), F.length("text").cast("long").alias("b")
    )
    return kept.unionByName(counts)


@query
def word_lists(spark, sf):
    """Benchmark items as a word list with comments, read in all three modes."""
    path = scratch(spark, "words")
    words = F.substring_index(F.regexp_replace("text", r"\s+", " "), " ", 3)
    mark = F.element_at(F.array(F.lit("# "), F.lit(" # "), F.lit(" ")), (F.col("item_id") % 3 + 1).cast("int"))
    table(spark, sf, "benchmark").select(F.concat(mark, words)).write.text(path)
    rows = [
        (mode, word)
        for mode in ("none", "raw", "stripped")
        for word in line_files.read_word_list(spark, path, mode, lower=mode == "raw")
    ]
    return spark.createDataFrame(rows, "mode string, word string")


@query
def banned_long_list(spark, sf):
    """Documents without any of the benchmark's long words, a list for the automaton."""
    path = scratch(spark, "banned")
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    words.where(F.length("word") >= BANNED_LETTERS).distinct().write.text(path)
    banned = line_files.read_word_list(spark, path, "raw", lower=True)
    return flagging.filter_banned(table(spark, sf, "documents"), banned).select("doc_id", "n_chars")


@query
def redact_single_pass(spark, sf):
    return flagging.redact(table(spark, sf, "documents").select("doc_id", "text"), REDACTED, mode="single_pass")


@query
def vector_store(spark, sf):
    """Vectors written as a store and read back."""
    path = scratch(spark, "store")
    docs = table(spark, sf, "documents").join(_store(spark, sf), "doc_id").select("doc_id", "text", "embedding")
    sinks.write_vectors(docs, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select(
        "doc_id", "text", F.size("embedding").alias("dimensions"), F.round(total, 6).alias("total")
    )


@query
def jsonl_round_trip(spark, sf):
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf, "conversations"), path)
    return line_files.read_jsonl(spark, path).select("text")


@query
def line_source(spark, sf):
    """Benchmark items as text lines; their own line ends make more lines."""
    path = scratch(spark, "lines")
    table(spark, sf, "benchmark").select(F.concat(F.lit("  "), "text", F.lit("\n"))).write.text(path)
    return line_files.read_lines(spark, path).select("text")


@query
def corpus_report(spark, sf):
    """Build a corpus of all documents and give its quarantine report, positions included."""
    root = scratch(spark, "corpus")
    docs = table(spark, sf, "documents").select(
        F.lit(0).alias("format_rank"),
        F.lit("documents").alias("path"),
        F.lit(0).cast("long").alias("block"),
        F.col("doc_id").alias("row"),
        T.strip(F.col("text")).alias("text"),
    )
    done = corpus.store_corpus(docs, sf, root, corpus.Policy(PATTERNS, CONTEXT))
    return spark.read.csv(
        done.quarantine, header=True, quote='"', escape='"', multiLine=True,
        schema="index long, matched_phrases string, excerpt string",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


@query
def manifest_sources(spark, sf):
    """Every source a list or a stored manifest names, whole; a split that a source lacks is its first one.

    Readers pass their columns on but for those a training text has no use for.
    """
    path = scratch(spark, "manifest")
    lines = table(spark, sf, "region").select(
        F.when(F.col("r_regionkey") == 0, "# sources").when(F.col("r_regionkey") == 1, " benchmark ")
        .when(F.col("r_regionkey") == 2, "  # pages").otherwise("").alias("value")
    )
    lines.write.text(path)
    sources = registry.SourceRegistry()
    for name in ("documents", "conversations", "benchmark"):
        sources.add(name, lambda session, name=name: table(session, sf, name).drop("lang", "source", "n_chars", "role", "turn"))
    sources.add("conversations", lambda session: table(session, sf, "conversations").where("turn = 0").drop("role", "turn"), "first")
    parts = []
    for name in registry.source_names(spark, "documents, conversations", path):
        rows = registry.load_source(spark, sources, name, "first")
        number = next(c for c in rows.columns if c.endswith("_id"))
        parts.append(rows.select(F.lit(name).alias("name"), F.col(number).alias("number"), *rows.drop(number).columns))
    return mixing.concat_sources(parts).select("source_rank", "name", "number", F.md5("text").alias("text_md5"))


@query
def prepared_mixture(spark, sf):
    """Two named sources and a stored JSON lines file, the first 200 of each, shuffled."""
    stored = scratch(spark, "stored") + ".jsonl"
    sinks.write_jsonl(table(spark, sf, "benchmark"), stored)
    sources = registry.SourceRegistry()
    for name in ("documents", "conversations"):
        sources.add_parquet(name, f"{sf}/{name}.parquet")
    specs = [registry.SourceSpec("documents"), registry.SourceSpec("conversations", split="test")]
    return mixture.prepare_mixture(spark, specs, sources, custom=stored, shuffle=True)


@query
def stream_flagged(spark, sf):
    """The documents as a stream, flagged by the batch operator."""
    docs = table(spark, sf, "documents")
    path = f"{sf}/documents.parquet"
    if is_directory(spark, path):
        stream = runs.stream_table(spark, path, docs.schema)
    else:
        stream = runs.stream_table(spark, sf, docs.schema, names="documents.parquet")
    output = scratch(spark, "stream")
    runs.run_available(
        stream,
        lambda df: sinks.quarantine_rows(flagging.flagged(df, PATTERNS, CONTEXT), "doc_id"),
        output,
        uuid.uuid4().hex,
    )
    return spark.read.schema("index long, matched_phrases string, excerpt string").parquet(output)




# Event time, in days, of the documents of each of four deliveries; the last also brings old ones.
DELIVERIES, LATE_DAY, DELAY_DAYS = (1, 3, 20, 21), 2, 5


@query
def stream_distinct(spark, sf):
    """Documents in four deliveries, repeated texts dropped across them; the last brings late ones too.

    Between the second and the third the watermark passes what came before, so texts of the first two stay again.
    """
    delivery, late = F.col("doc_id") % len(DELIVERIES), F.col("doc_id") % (2 * len(DELIVERIES)) == 2 * len(DELIVERIES) - 1
    day = F.when(late, LATE_DAY).otherwise(F.element_at(F.array(*map(F.lit, DELIVERIES)), (delivery + 1).cast("int")))
    docs = table(spark, sf, "documents").select("doc_id", "text", day.alias("day"))
    docs = docs.withColumn("at", F.timestamp_seconds(F.col("day") * 86_400))
    source, output, name = scratch(spark, "deliveries"), scratch(spark, "distinct"), uuid.uuid4().hex
    for i in range(len(DELIVERIES)):
        docs.where(delivery == i).write.mode("append").parquet(source)
        stream = runs.stream_table(spark, source, docs.schema)
        runs.run_available(stream, lambda df: runs.without_repeats(df, "at", f"{DELAY_DAYS} days"), output, name)
    return spark.read.schema(docs.schema).parquet(output).select(F.md5("text").alias("text_md5"), F.col("day").cast("long").alias("day"))
