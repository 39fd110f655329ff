"""One query per operator over the whole ``documents`` table, and SQL for DuckDB where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import centroids, decontamination, exact_dedup, golay_dedup, language_id, lattice_lm, licenses, mixing, near_dedup, periodic_runs, quality, sharding, token_files
from quern.llm.common import documents, fold
from quern.session import checkpoint_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_language_id(spark, sf_dir):
    """Fold 2 of 4 is held out of learning; every text is predicted from its letters alone."""
    docs = documents(spark, sf_dir)
    part = docs.select("doc_id", "text", "lang", fold("doc_id", 4).alias("fold"))
    model = language_id.learn(part.where("fold <> 2"))
    found = language_id.identify(part.select("doc_id", (part.fold == 2).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "langs", "shares")


@query
def op3_minhash_near_dedup(spark, sf_dir):
    """Classes of documents whose five-word shingles are similar to 0.8 or more."""
    found = near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "kept")


@query
def op2_source_mix(spark, sf_dir):
    """The whole table as one mix of as many words as it has."""
    found = mixing.shares(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", "taken")


SQL["op2_source_mix"] = mixing.ORACLE


@query
def op6_benchmark_leaks(spark, sf_dir):
    """Documents with the benchmark items that stand in them, with the same or other values."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.leaks(documents(spark, sf_dir), benchmark)
    return found.select("doc_id", "item_id", "n_tokens", "n_item_tokens", "n_slots", "n_changed")


@query
def op10_minimax_shards(spark, sf_dir):
    """40 shards of nearly equal bytes, equal texts together."""
    found = sharding.assign(documents(spark, sf_dir))
    none = F.lit(None).cast("int")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard"))


@query
def op8_exact_dedup(spark, sf_dir):
    """All documents against a new index."""
    index = exact_dedup.DigestIndex(spark, exact_dedup.new_index_path(spark))
    return exact_dedup.ingest(documents(spark, sf_dir), index)


SQL["op8_exact_dedup"] = exact_dedup.ORACLE


@query
def op9_license_scan(spark, sf_dir):
    """Phrases, tags and labels of every document."""
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op5_token_files(spark, sf_dir):
    """Written to files and read back from them."""
    import public_tokenizers

    folder = f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder)
    found = token_files.read_tokens(spark, folder)
    return found.mapInArrow(token_files.crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query
def op7_quality(spark, sf_dir):
    """Fold 1 of 3 is held out of learning; every text is scored by its bytes alone."""
    docs = documents(spark, sf_dir).select("doc_id", "text", fold("doc_id", 3).alias("fold"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)
    model = quality.learn(docs.where("fold <> 1"), labels)
    found = quality.score(docs.select("doc_id", (docs.fold == 1).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_lattice_score(spark, sf_dir):
    """Fold 1 of 5 is held out of learning; every text is scored."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text", fold("doc_id", 5).alias("fold"))
    held_out = F.col("fold") == 1
    model = lattice_lm.learn(docs, held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return lattice_lm.score(docs, held_out, model)


@query
def op11_golay_simhash(spark, sf_dir):
    """Classes of documents whose fingerprints differ in four bits at most."""
    found = golay_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op12_centroid_clusters(spark, sf_dir):
    """Eight clusters of all vectors of 64 components, after ten rounds."""
    found = centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.col("centroid").cast("binary"), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _repeated_ends(docs: DataFrame) -> DataFrame:
    """Texts of which some go on, from a word on, with the words from there over and over, as the id's crc32 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    docs = docs.select("*", F.when(F.col("h") % 10 == 0, words).alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    new = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", place(i)))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    """Runs of all texts; a tenth of them get a periodic end first."""
    found = periodic_runs.periodic_runs(_repeated_ends(documents(spark, sf_dir)))
    # Larger length / period first, compared exactly, then the smaller start, then the smaller period.
    ratio = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    order = lambda x, y: F.when(ratio(x, y) != 0, -F.signum(ratio(x, y))).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")
    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.select("doc_id", "n_words", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}") for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
