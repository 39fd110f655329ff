"""Build a corpus: collect documents, keep the first of equal ones, sanitize, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import commits, sinks
from quern.functions.phrases import CONTEXT_WINDOW
from quern.operators.dedup import dedup_exact
from quern.operators.flagging import flagged, retained
from quern.operators.ordering import assign_seq
from quern.schemas import FILE_ORDER
from quern.session import intermediate_tables, materialise
from quern.sources.documents import MAX_FILE_BYTES, collect_documents, rejected_files
from quern.sources import paths
from quern.sources.registry import DATASET_PREFIXES, read_dataset

# At 8 bytes an id, the ids of flagged rows stay near 100 MB when they go to every task.
BROADCAST_FLAGGED = 10_000_000


@dataclass(frozen=True)
class Policy:
    """Patterns that flag a text, and keywords that excuse a match shortly after them."""

    patterns: Sequence[str] = ()
    context_keywords: Sequence[str] = ()
    window: int = CONTEXT_WINDOW


@dataclass(frozen=True)
class SanitizeResult:
    flagged: int
    retained: int
    quarantine: str
    dataset: str | None = None


@dataclass(frozen=True)
class CorpusResult:
    documents: int = 0
    flagged: int = 0
    dataset: str | None = None
    sanitized: str | None = None
    quarantine: str | None = None
    metadata: str | None = None
    fields: dict[str, object] = field(default_factory=dict)


def timestamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


def sanitize(
    spark: SparkSession,
    dataset: str,
    policy: Policy,
    root: str | None = None,
    quarantine: str | None = None,
    save: bool = True,
    stamp: str | None = None,
    broadcast_flagged: int = BROADCAST_FLAGGED,
) -> SanitizeResult:
    """Split a stored dataset (with ``seq`` and ``text``) into a report and a clean copy.

    The findings, without the texts, are written once. The clean copy leaves out their ids by a
    broadcast while there are at most ``BROADCAST_FLAGGED`` of them, and beyond evaluates the
    policy once more rather than shuffle all texts.
    """
    stamp = stamp or timestamp()
    root = root or dataset.rstrip("/").rsplit("/", 1)[0]
    df = read_dataset(spark, dataset)
    rules = (policy.patterns, policy.context_keywords, policy.window)
    found = flagged(df.select("seq", "text"), *rules).drop("text")
    findings = materialise(found, "findings")
    quarantine = quarantine or f"{root}/quarantine_{stamp}.csv"
    sinks.write_quarantine(findings.orderBy("seq"), quarantine)
    hits = findings.count()
    kept = df.count() - hits
    target = None
    if save:
        if hits <= broadcast_flagged:
            clean = df.join(F.broadcast(findings.select("seq")), "seq", "left_anti")
        else:
            clean = retained(df, *rules)
        target = f"{root}/{DATASET_PREFIXES['sanitized']}{stamp}"
        sinks.write_dataset(clean.select(*df.columns), target)
        metadata = {
            "source_dataset": dataset,
            "created_at": stamp,
            "quarantine_report": quarantine,
            "flagged_examples": hits,
            "retained_examples": kept,
        }
        sinks.write_metadata(_one_row(spark, metadata), f"{root}/metadata/sanitization_{stamp}")
    return SanitizeResult(hits, kept, quarantine, target)


def _one_row(spark: SparkSession, fields: dict[str, object]) -> DataFrame:
    names = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in fields.items())
    return spark.createDataFrame([tuple(fields.values())], names)


def build_corpus(
    spark: SparkSession,
    source: str,
    root: str,
    policy: Policy | None = None,
    parsers: dict[str, Callable[[bytes], str]] | None = None,
    stamp: str | None = None,
    accept_rejects: bool = False,
    max_bytes: int = MAX_FILE_BYTES,
) -> CorpusResult:
    """Documents of a folder -> dataset, and with a policy its report and clean copy.

    Without any document nothing is written. ``seq`` is a document's position after removal of
    duplicates. Files that cannot be read end the build, unless the caller accepts them; then they are
    stored beside the dataset as ``rejects_<stamp>`` and counted in its metadata.
    """
    with intermediate_tables(spark):
        rejects = materialise(rejected_files(spark, source, parsers, max_bytes), "rejects")
        n = rejects.count()
        if n and not accept_rejects:
            first = "; ".join(f"{r.path} ({r.reason})" for r in rejects.orderBy("path").take(10))
            raise ValueError(f"{n} files cannot be read: {first}")
        documents = collect_documents(spark, source, parsers, max_bytes)
        return store_corpus(documents, source, root, policy, stamp, rejects if n else None)


def store_corpus(
    documents: DataFrame,
    source: str,
    root: str,
    policy: Policy | None = None,
    stamp: str | None = None,
    rejects: DataFrame | None = None,
) -> CorpusResult:
    """``build_corpus`` from a table of documents in ``schemas.FILE_ORDER``.

    The metadata are committed last. A build that ended before may be repeated under its stamp: what it left is removed first.
    """
    with intermediate_tables(documents.sparkSession):
        return _stored(documents, source, root, policy, stamp or timestamp(), rejects)


def _stored(
    documents: DataFrame, source: str, root: str, policy: Policy | None, stamp: str, rejects: DataFrame | None
) -> CorpusResult:
    spark = documents.sparkSession
    unique = assign_seq(dedup_exact(documents, order=FILE_ORDER), FILE_ORDER)
    if unique.isEmpty():
        return CorpusResult()
    target = f"{root}/{DATASET_PREFIXES['custom']}{stamp}"
    metadata = f"{root}/metadata/build_{stamp}"
    sanitized = f"{root}/{DATASET_PREFIXES['sanitized']}{stamp}"
    sanitization = f"{root}/metadata/sanitization_{stamp}"
    outputs = [target, sanitized, f"{root}/quarantine_{stamp}.csv", f"{root}/rejects_{stamp}", sanitization]
    if commits.is_unfinished(spark, metadata):
        for path in outputs:
            paths.delete(spark, path)
    elif any(paths.exists(spark, path) for path in outputs):
        raise FileExistsError(f"{root} holds files of {stamp} that no unfinished build left")
    commits.begin(spark, metadata)
    written = sinks.write_dataset(unique.select("seq", "path", "text"), target)
    # The keys of the metadata.
    fields: dict[str, object] = {"created_at": stamp, "source_documents_dir": source}
    if rejects is not None:
        sinks.write_dataset(rejects, f"{root}/rejects_{stamp}")
        fields["rejected_files"] = rejects.count()
    done = None
    if policy is not None:
        done = sanitize(spark, target, policy, root, stamp=stamp)
        documents_count = done.flagged + done.retained
        fields |= {
            "document_count": documents_count,
            "sanitized_dataset": done.dataset,
            "flagged_count": done.flagged,
            "quarantine_report": done.quarantine,
        }
    else:
        documents_count = written
        fields["document_count"] = documents_count
    sinks.write_metadata(_one_row(spark, fields), metadata, mode="append")
    commits.commit(spark, metadata, dataset=target)
    return CorpusResult(
        documents_count,
        done.flagged if done else 0,
        target,
        done.dataset if done else None,
        done.quarantine if done else None,
        metadata,
        fields,
    )
