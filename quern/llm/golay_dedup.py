"""SimHash near-duplicates by Golay-code fuzzy hashing.

The fingerprint of a text has 64 bits: bit b is set if it is in more than half of the XXH64 hashes of the text's
shingles of ``WORDS`` words (lower-case A-Z, words between ASCII white space, repeats counted; fewer words are one
shingle, none give fingerprint zero). Texts are linked if their fingerprints differ in at most ``NEAR`` bits; classes
are the connected components of all links.

Links are found without comparing all pairs. A fingerprint is cut into three segments, each read as a word of the
binary Golay code of length 23, which is perfect: every word lies within three bits of exactly one codeword. The keys
of a segment are the indices of all codewords within four bits of it. That is one, or six where the nearest is three
bits away, and two segments that differ in at most two bits always have a key in common: either the nearest codeword
of one is a key of the other, or the changed bits lie in the four that lead to a second codeword of both. Of
``NEAR`` errors at most one segment has three or more, so in two of the three segments the keys meet. A fingerprint
has one row for each pair of keys of two segments, 24 bits each, and joins those with the same pair. What meets is
verified on all 64 bits.

Equal fingerprints are one node. The rows of a bucket come to one task in order of their keys, which holds one bucket
at a time and passes on links that join it, not its pairs. Buckets of more than ``HEAVY`` rows, as a large group of
copies makes, are found beforehand by counts and left to joins: all rows are held against one of them, and then only
rows of different components against each other. So a group of n copies costs its rows and not its pairs there; the
work left grows with the product of the sizes of distinct components that share a bucket. Of unrelated fingerprints
so many meet as fall on one of 2^24 keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.near_dedup import components
from quern.llm.text_bytes import U64
from quern.session import materialise

WORDS, SEED, NEAR = 4, 42, 4
# (first bit, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
LENGTH, CHECKS = 23, 11
# Fixed value: the generator of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
# Hashes whose bits are counted at once.
HASHES_AT_ONCE = 1 << 15
ROWS_AT_ONCE = 4096
# A task holds a bucket of up to HEAVY rows; those of up to FEW are compared together.
HEAVY, FEW = 1 << 14, 32


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainders by the generator."""
    rest = np.array(words, np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECKS))
    return rest


def _errors() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error to the nearest codeword, and the five errors of four bits (0 where none)."""
    nearest, others = np.zeros(1 << CHECKS, np.int64), np.zeros((1 << CHECKS, 5), np.int64)
    filled = np.zeros(1 << CHECKS, np.int64)
    for weight in range(1, 5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for error, syndrome in zip(errors.tolist(), _syndromes(errors).tolist(), strict=True):
            if weight < 4:
                nearest[syndrome] = error
            else:
                others[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return nearest, others


_tables: list[np.ndarray] = []


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, valid), six columns: the codewords within four bits of each word, the nearest first."""
    if not _tables:
        _tables.extend(_errors())
    nearest, others = _tables
    syndromes = _syndromes(words)
    errors = np.concatenate([nearest[syndromes][:, None], others[syndromes]], axis=1)
    valid = np.ones(errors.shape, bool)
    valid[:, 1:] = errors[:, 1:] > 0
    return (words[:, None] ^ errors) >> CHECKS, valid


def pair_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of all ``fingerprints``; a key holds the two segments it is from."""
    keys = [codeword_keys(((fingerprints >> U64(first)) & U64((1 << bits) - 1)).astype(np.int64)) for first, bits in SEGMENTS]
    rows, found = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (left, has), (right, also) = keys[i], keys[j]
        row, a, b = np.nonzero(has[:, :, None] & also[:, None, :])
        rows.append(row)
        found.append((pair << 24) | (left[row, a] << 12) | right[row, b])
    return np.concatenate(rows), np.concatenate(found)


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    n = max(1, len(words) - WORDS + 1)
    ends = ends[WORDS - 1 :] if len(words) >= WORDS else ends[-1:]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(data[a:b], SEED) for a, b in zip(starts[:n], ends, strict=True)], U64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], U64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print, the fingerprint as a signed number, for each row of ``docs``."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return docs.mapInArrow(_fingerprinted, "doc_id long, print long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        for at in range(0, len(prints), ROWS_AT_ONCE):
            part = prints[at : at + ROWS_AT_ONCE]
            row, key = pair_keys(part.view(U64))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[row])], names=["key", "node"])


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= NEAR


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # The bits of signed numbers would be those of their absolute values.
    return np.bitwise_count((a ^ b).view(U64))


def _joined(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all nodes of a bucket which lie in one component: a tree for each component."""
    a, b = [], []
    unseen = nodes
    while len(unseen):
        front, unseen = [unseen[0]], unseen[1:]
        while front and len(unseen):
            node = front.pop()
            near = _differing(unseen, node) <= NEAR
            if near.any():
                found, unseen = unseen[near], unseen[~near]
                a.append(np.full(len(found), node))
                b.append(found)
                front.extend(found)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _of_buckets(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows that are sorted by key."""
    borders = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    sizes = np.diff(borders)
    few = np.repeat(sizes <= FEW, sizes)
    found = [_joined(nodes[borders[i] : borders[i + 1]]) for i in np.flatnonzero(sizes > FEW)]
    keys, nodes = keys[few], nodes[few]
    for apart in range(1, FEW):  # rows so far apart in all small buckets at once
        at = np.flatnonzero(keys[apart:] == keys[:-apart])
        if not len(at):
            break
        at = at[_differing(nodes[at], nodes[at + apart]) <= NEAR]
        found.append((nodes[at], nodes[at + apart]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets; rows come sorted by key, and the last bucket of a batch may go on in the next."""
    keys, nodes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def links_of(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _of_buckets(keys, nodes)], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int32)])
        nodes = np.concatenate([nodes, np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)])
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if last:
            yield links_of(keys[:last], nodes[:last])
            keys, nodes = keys[last:], nodes[last:]
    if len(keys):
        yield links_of(keys, nodes)


def _heavy(rows: DataFrame) -> DataFrame | None:
    """The keys of more than ``HEAVY`` rows, None if there are none.

    Keys are first counted in groups, of which most together hold less than that.
    """
    groups = max(1 << 12, rows.count() // HEAVY * 16)
    group = F.pmod(F.xxhash64("key"), F.lit(groups))
    dense = rows.groupBy(group.alias("of")).count().where(F.col("count") > HEAVY).select("of")
    dense = materialise(dense, "golay-dense")
    if dense.isEmpty():
        return None
    keys = rows.join(dense, group == F.col("of"), "left_semi").groupBy("key").count().where(F.col("count") > HEAVY)
    return materialise(keys.select("key"), "golay-heavy")


def _heavy_links(rows: DataFrame) -> DataFrame:
    """Links within buckets of any size, by joins: with one node of each bucket, then between other components."""
    # Which node a bucket is held against is drawn, so that a group's nodes do not all choose the same neighbour.
    drawn = F.min(F.struct(F.xxhash64("node").alias("draw"), "node")).alias("first")
    shared = materialise(rows.join(rows.groupBy("key").agg(drawn).select("key", F.col("first.node").alias("pivot")), "key"), "golay-shared")
    star = shared.where("node <> pivot").where(_near("node", "pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    star = materialise(star, "golay-star")
    classes = materialise(components(star), "golay-classes")

    at = classes.select(F.col("node").alias("pivot"), F.col("class").alias("pivot_class"))
    own = F.coalesce("class", "node")
    placed = shared.join(classes, "node", "left").join(at, "pivot", "left")
    placed = placed.select("key", "node", own.alias("class"), (own != F.coalesce("pivot_class", "pivot")).alias("other"))
    placed = materialise(placed, "golay-placed")
    # The component of a bucket's pivot needs no links within itself.
    other = placed.where("other").select("key", F.col("node").alias("b"), F.col("class").alias("d"))
    every = placed.select("key", F.col("node").alias("a"), F.col("class").alias("c"))
    met = every.join(other.hint("merge"), (every["key"] == other["key"]) & (F.col("c") != F.col("d")) & _near("a", "b"))
    return star.unionByName(met.select("a", "b").distinct())


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of the distinct fingerprints ``nodes`` that have the components of all their links."""
    # Nodes are small and their keys many, so the nodes are dealt to as many tasks as the keys will need.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node").repartition(tasks, "node").mapInArrow(_keyed, "key int, node long")
    rows = materialise(rows, "golay-rows")
    heavy = _heavy(rows)
    light = rows if heavy is None else rows.join(heavy, "key", "left_anti")
    found = light.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long")
    if heavy is not None:
        found = found.unionByName(_heavy_links(rows.join(heavy, "key", "left_semi")))
    return materialise(found.distinct(), "golay-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, print (the fingerprint as a signed number) and component_id.

    ``component_id`` is the smallest doc_id that links lead to, null only if no text there has an id. Null and blank
    texts have fingerprint zero and are linked like others; repeated rows and ids have a row each; other columns are
    not looked at.
    """
    prints = materialise(fingerprints(docs), "golay-prints")
    nodes = prints.groupBy(F.col("print").alias("node")).agg(F.min("doc_id").alias("least"))
    nodes = materialise(nodes, "golay-nodes")
    classes = materialise(components(links(nodes)), "golay-components")
    of = materialise(nodes.join(classes, "node", "left").select("node", "least", F.coalesce("class", "node").alias("class")), "golay-of")
    # Most classes are single nodes, so the sum is over nodes, not over documents.
    least = of.groupBy("class").agg(F.min("least").alias("component_id"))
    of = materialise(of.join(least, "class").select(F.col("node").alias("print"), "component_id"), "golay-ids")
    return prints.join(of, "print").select("doc_id", "print", "component_id")
