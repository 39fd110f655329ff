"""MinHash near-duplicates by DartMinHash.

A text is the weighted set of its shingles of five words (lower-case A-Z; words are runs of letters and
digits; a shorter text is one shingle of all its words). A shingle found c times weighs 1 + ln(c), so a
line repeated a thousand times does not outweigh the rest. Similarity is the weighted Jaccard index.

Darts are a fixed Poisson process over (shingle, weight, rank), drawn from hashes: a text is hit by the
darts that fall below its shingle's weight. A dart belongs to one of ``K`` coordinates, and the dart of
smallest rank in each coordinate is the signature. Only ranks up to about (ln K + 2) K / total weight are
drawn, and more for texts that still lack a coordinate, so the cost is the text's length plus the darts.

Texts of equal words are one node. Bands of the signatures join the nodes into buckets. Within a bucket
all nodes are first held against one pivot; nodes that this leaves in other components are held against
all nodes of other components in blocks of bounded size, whose links join components only. Every link is
verified exactly on the shingles.
Classes are the connected components of the links, found by alternating star contractions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import unused
from quern.llm.text_bytes import LOWER, U64, SpanHash, chunks, mix, word_spans
from quern.session import materialise

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
K = BANDS * ROWS
# Signatures of texts at SIMILAR agree in less than this part of the coordinates once in a million.
AGREE = SIMILAR - 5 * (SIMILAR * (1 - SIMILAR) / K) ** 0.5
BLOCK = 500

_PLACES = np.array([int.from_bytes(hashlib.sha256(f"place {i}".encode()).digest()[:8], "little") | 1 for i in range(WORDS)], dtype=U64)
_STEP, _CELL, _DART = (U64(int.from_bytes(hashlib.sha256(x).digest()[:8], "little") | 1) for x in (b"step", b"cell", b"dart"))


def shingle_sets(column: pa.Array) -> Iterator[tuple[bytes | None, np.ndarray, np.ndarray]]:
    """For each text (digest of its words, sorted distinct shingles, their weights); None without words."""
    for _, data, borders in chunks(column):
        data = LOWER[data]
        starts, ends, first = word_spans(data, borders)
        words = SpanHash(data)(starts, ends)
        full = np.zeros(len(words), dtype=U64)
        if len(words) >= WORDS:
            n = len(words) - WORDS + 1
            for k in range(WORDS):
                full[:n] += words[k : k + n] * _PLACES[k]
            full = mix(full)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if a == b:
                yield None, np.zeros(0, U64), np.zeros(0)
                continue
            digest = hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest()
            if b - a >= WORDS:
                shingles, n = np.unique(full[a : b - WORDS + 1], return_counts=True)
            else:
                shingles, n = mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True)), np.ones(1)
            yield digest, shingles, 1.0 + np.log(n)


def _darts(doc, seed, cell, weight, limit):
    """(doc, rank, dart) of all darts with a rank up to the text's ``limit`` that hit."""
    found = []
    rank = np.zeros(len(seed))
    step = 0
    while len(seed):
        many = 1 if len(seed) > 4096 else 16
        steps = np.arange(step + 1, step + many + 1, dtype=U64) * _STEP
        step += many
        draw = mix(seed[:, None] + steps[None, :])
        gaps = -np.log(((draw >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53)
        ranks = rank[:, None] + np.cumsum(gaps, axis=1)
        inside = ranks <= limit[doc][:, None]
        at = np.nonzero(inside)
        darts = mix(draw[at] ^ _DART)
        hit = cell[at[0]] + (darts >> U64(40)).astype(np.float64) * 2.0**-24 < weight[at[0]]
        found.append((doc[at[0]][hit], ranks[at][hit], darts[hit]))
        alive = inside[:, -1]
        doc, seed, cell, weight, rank = doc[alive], seed[alive], cell[alive], weight[alive], ranks[alive, -1]
    return [np.concatenate(parts) for parts in zip(*found, strict=True)]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """One row of ``k`` darts for each non-empty weighted set."""
    out = np.zeros((len(sets), k), dtype=U64)
    totals = np.array([w.sum() for _, w in sets])
    open_, limit = np.arange(len(sets)), k * (np.log(k) + 2.0) / totals
    while len(open_):
        doc = np.repeat(np.arange(len(open_)), [len(sets[i][0]) for i in open_])
        shingle = np.concatenate([sets[i][0] for i in open_])
        weight = np.concatenate([sets[i][1] for i in open_])
        cells = np.ceil(weight).astype(np.int64)
        of = np.repeat(np.arange(len(doc)), cells)
        cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = mix(shingle[of] + cell.astype(U64) * _CELL)
        hit, rank, dart = _darts(doc[of], seed, cell.astype(np.float64), weight[of], limit[open_])
        slot = hit * k + ((dart & U64(0xFFFFFFFF)) % U64(k)).astype(np.int64)
        least = np.full(len(open_) * k, np.inf)
        np.minimum.at(least, slot, rank)
        first = rank == least[slot]
        darts = np.zeros(len(open_) * k, dtype=U64)
        darts[slot[first]] = dart[first]
        whole = np.isfinite(least).reshape(-1, k).all(axis=1)
        out[open_[whole]] = darts.reshape(-1, k)[whole]
        open_ = open_[~whole]
        limit[open_] *= 2
    return out


def _bands(signs: np.ndarray) -> np.ndarray:
    """The bucket keys of signatures, one column for each band."""
    parts = signs.reshape(len(signs), BANDS, ROWS)
    keys = np.full(parts.shape[:2], 1, dtype=U64) * np.arange(1, BANDS + 1, dtype=U64)[None, :]
    for i in range(ROWS):
        keys = mix(keys * _STEP + parts[:, :, i])
    return keys.view(np.int64)


_SIGNED = "doc_id long, text_hash long, digest binary, sign binary, bands array<long>"
ROWS_AT_ONCE = 256


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            sets = list(shingle_sets(part.column(2)))
            having = [i for i, s in enumerate(sets) if s[0] is not None]
            signs = signatures([sets[i][1:] for i in having]) if having else np.zeros((0, K), U64)
            keys = _bands(signs) if having else np.zeros((0, BANDS), np.int64)
            short = (signs >> U64(48)).astype(np.uint16)
            row = {i: j for j, i in enumerate(having)}
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([s[0] for s in sets], pa.binary()),
                    pa.array([short[row[i]].tobytes() if i in row else None for i in range(len(sets))], pa.binary()),
                    pa.array([keys[row[i]] if i in row else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "digest", "sign", "bands"],
            )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id as long, a hash of the text, and the text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"
    )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            sets = list(shingle_sets(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([s.tobytes() for _, s, _ in sets], pa.binary()),
                    pa.array([w.astype(np.float32).tobytes() for _, _, w in sets], pa.binary()),
                ],
                names=["node", "shingles", "weights"],
            )


def weighted_jaccard(a, wa, b, wb) -> float:
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64)
    return float(shared / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - shared))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, sa, wa, sb, wb = (c.to_pylist() for c in batch.columns)
        value = [
            weighted_jaccard(
                np.frombuffer(sa[i], U64), np.frombuffer(wa[i], np.float32), np.frombuffer(sb[i], U64), np.frombuffer(wb[i], np.float32)
            )
            for i in range(len(a))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.float64())], names=["a", "b", "similarity"])


def _sets(wanted: DataFrame, signed: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """(node, shingles, weights) for the nodes ``wanted``."""
    places = signed.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("of"), F.col("text_hash").alias("by"))
    texts = keyed(docs).join(places, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("by")))
    texts = texts.select("node", "text").mapInArrow(_shingled, "node long, shingles binary, weights binary")
    return materialise(texts, f"{label}-sets")


def _verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose exact similarity reaches SIMILAR."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    sets = _sets(wanted, signed, docs, "star")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "wa", "sb", "wb")
    measured = joined.mapInArrow(_measured, "a long, b long, similarity double")
    return materialise(measured.where(F.col("similarity") >= SIMILAR).select("a", "b", "similarity").distinct(), "star-links")


def components(links: DataFrame) -> DataFrame:
    """(node, class) with the smallest node of its component, for nodes of the links (a, b).

    Alternates the two star contractions; the minimum of a node's neighbours is an aggregate and goes
    back to its edges by a join, so no node's neighbourhood meets in one task.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()

    def least(pairs: DataFrame) -> DataFrame:
        return materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), "star")

    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both.unionByName(edges.select("u", F.col("u").alias("v"))).unionByName(edges.select(F.col("v").alias("u"), "v")))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        m = least(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m.select("u", F.col("m").alias("v")))
        edges = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("class"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(roots)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of one unit after another; rows come sorted by unit, which may run over several batches."""
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        unit = np.array(columns["unit"])
        borders = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1), len(unit)]
        for x, y in zip(borders[:-1], borders[1:], strict=True):
            if held and held["unit"][0] != unit[x]:
                yield held
                held = {}
            for name, values in columns.items():
                held.setdefault(name, []).extend(values[x:y])
    if held:
        yield held


def _agreeing(unit: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreeing coordinates) of a unit's rows of different components with similar signatures."""
    part, side = np.array(unit["class"]), np.array(unit["side"])
    signs = np.frombuffer(b"".join(unit["sign"]), np.uint16).reshape(len(part), K)
    two = side.min() != side.max()
    found = []
    for i in np.flatnonzero(side == side.min()) if two else range(len(part)):
        others = np.flatnonzero((part != part[i]) & ((side != side[i]) if two else (np.arange(len(part)) > i)))
        if len(others):
            equal = (signs[others] == signs[i]).sum(axis=1)
            near = equal >= AGREE * K
            found.append((np.full(near.sum(), i), others[near], equal[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of units that agree with any row of another component."""
    for unit in _units(batches):
        i, j, _ = _agreeing(unit)
        rows = np.union1d(i, j)
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit[c][r] for r in rows], t) for c, t in _UNIT.items()], names=list(_UNIT)
            )


_UNIT = {"unit": pa.int64(), "node": pa.int64(), "class": pa.int64(), "side": pa.int32(), "sign": pa.binary()}


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links that join the components of each unit: at most one for each row.

    The most similar signatures go first. A pair whose components are joined by then needs no check.
    """
    for unit in _units(batches):
        i, j, equal = _agreeing(unit)
        root = {c: c for c in unit["class"]}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        sets = [(np.frombuffer(s, U64), np.frombuffer(w, np.float32)) for s, w in zip(unit["shingles"], unit["weights"], strict=True)]
        a, b, value = [], [], []
        for x in np.argsort(-equal, kind="stable"):
            p, q = int(i[x]), int(j[x])
            c, d = find(unit["class"][p]), find(unit["class"][q])
            if c != d and (similarity := weighted_jaccard(*sets[p], *sets[q])) >= SIMILAR:
                root[c] = d
                a.append(unit["node"][p])
                b.append(unit["node"][q])
                value.append(similarity)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value)], names=["a", "b", "similarity"])


def _left_links(shared: DataFrame, classes: DataFrame, signed: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between rows of a bucket that lie in different components.

    The pivot's component in a bucket needs no links within itself. The other rows are cut into blocks and
    held against each other and against blocks of the pivot's component. Shingles are
    fetched only for rows whose signatures agree with one of another component.
    """
    at = classes.select(F.col("node").alias("pivot"), F.col("class").alias("pivot_class"))
    rows = shared.join(classes, "node", "left").join(at, "pivot", "left")
    rows = rows.select(
        "key",
        "node",
        F.coalesce("class", "node").alias("class"),
        (F.coalesce("class", "node") != F.coalesce("pivot_class", "pivot")).alias("other"),
    )
    rows = materialise(rows, "bucket-rows")
    cut = rows.groupBy("key").agg(F.count_if("other").alias("n_other"), F.count_if(~F.col("other")).alias("n_own")).where("n_other > 0")
    cut = materialise(cut, "bucket-cut")
    rows = rows.join(cut, "key")
    blocks = F.ceil(F.col("n_other") / BLOCK).cast("long")
    owns = F.ceil(F.col("n_own") / BLOCK).cast("long")
    draw = F.xxhash64("node")
    others = rows.where("other").withColumn("i", F.pmod(draw, blocks))
    among = others.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j")
    ).select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(0).alias("kind"), "node", "class", F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"))
    against = others.select("*", F.explode(F.sequence(F.lit(0).cast("long"), owns - 1)).alias("j")).select(
        "key", "i", "j", F.lit(1).alias("kind"), "node", "class", F.lit(0).alias("side")
    )
    own = (
        rows.where("not other")
        .withColumn("j", F.pmod(draw, owns))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("i"))
        .select("key", "i", "j", F.lit(1).alias("kind"), "node", "class", F.lit(1).alias("side"))
    )
    units = among.unionByName(against).unionByName(own)
    units = units.join(signed.select("node", "sign"), "node")
    units = units.select(F.xxhash64("key", "kind", "i", "j").alias("unit"), "node", "class", "side", "sign")
    units = units.repartition("unit").sortWithinPartitions("unit")
    units = units.mapInArrow(_promising, "unit long, node long, class long, side int, sign binary")
    units = materialise(units, "units")
    sets = _sets(units.select("node").distinct(), signed, docs, "unit")
    rows = units.join(sets, "node").repartition("unit").sortWithinPartitions("unit")
    rows = rows.select("unit", "node", "class", "side", "sign", "shingles", "weights")
    return materialise(rows.mapInArrow(_linked, "a long, b long, similarity double"), "unit-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, class_id, class_size, kept.

    ``class_id`` is the smallest doc_id of the class, whose row stays; of repeated rows with that id one
    stays. Rows whose text is null or has no words are alone, and rows without an id come after those
    with one.
    """
    signed = keyed(docs).mapInArrow(_sign, _SIGNED).withColumn("row", F.monotonically_increasing_id())
    signed = materialise(signed, "signed")
    nodes = signed.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"))
    nodes = materialise(nodes, "nodes")
    lead = materialise(
        signed.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "lead"
    )
    members = lead.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node"), "node")).alias("p"))
    buckets = materialise(buckets.where("n > 1").select("key", F.col("p.node").alias("pivot")), "buckets")
    shared = materialise(members.join(buckets, "key"), "shared")
    pairs = materialise(
        shared.where("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct(), "pairs"
    )
    once = docs.select("doc_id", "text").dropDuplicates() if _repeats(signed) else docs
    links = _verified(pairs, lead, once)
    classes = materialise(components(links), "classes")
    more = _left_links(shared, classes, lead, once)
    if not more.isEmpty():
        classes = materialise(components(links.unionByName(more)), "all-classes")

    of_words = nodes.join(classes, "node", "left").select("digest", F.coalesce("class", "node").alias("class"))
    of_words = materialise(of_words, "of-words")
    rows = signed.select("row", "doc_id", "text_hash", "digest").join(of_words, "digest", "left")
    rows = rows.select("row", "doc_id", "text_hash", F.coalesce("class", "row").alias("class"))
    rows = materialise(rows, "rows")
    first = rows.groupBy("class").agg(
        F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    )
    first = materialise(first.select("class", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("stays")), "first")
    # Classes of several rows need the join; the class of a single row is known from the row itself.
    return rows.join(first, "class").select(
        "doc_id", "text_hash", "class_id", "class_size", (F.col("row") == F.col("stays")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each class of near-duplicates stays."""
    found = materialise(near_duplicates(docs).where("kept"), "kept")
    names = [unused(docs, c) for c in ("keep_of", "keep_by")]
    keep = found.select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    rows = docs.join(keep, docs["doc_id"].eqNullSafe(keep[names[0]]) & (hashed == keep[names[1]]), "left_semi")
    # Repeated rows, equal in id and text, are still several.
    return rows.dropDuplicates(["doc_id", "text"]) if _repeats(docs) else rows


def _repeats(docs: DataFrame) -> bool:
    """Whether ids repeat; reads ids only."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
