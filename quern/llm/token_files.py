"""Token ids of documents in Simple-8b files.

A data set is a Parquet folder whose rows are chunks of consecutive documents in order of doc_id:

- ``part``, ``chunk``: place of the chunk; parts are ranges of doc_id, in order.
- ``start``: ids in the part before the chunk; ``doc_ids`` and ``counts``: its documents and their ids.
- ``words``: the ids as little-endian 64-bit words. The four low bits of a word select how many ids of how many bits
  the other 60 hold, the first id lowest. Selector 15 is an escape: the next word is one id of up to 64 bits.
- ``offsets``: for each block of BLOCK ids the number of words before it (32 bits each). Blocks start with a new
  word, so any block can be decoded alone, and all blocks of a chunk are decoded side by side.

Spark writes the files, so a lost task leaves nothing behind, and any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.text_bytes import slices

BLOCK = 256
CHUNK_IDS = 1 << 16
END_ID = 2
# Ids and bits of the selectors 0 to 14; ids left over at a block's end are filled up with zeros.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = 15
U64 = np.uint64
SCHEMA = "part int, chunk int, start long, doc_ids array<long>, counts array<long>, words binary, offsets binary"
# Words of up to so many bytes are encoded once per Python worker, up to so many of them.
MEMO_WORDS, MEMO_CHARS = 600_000, 64
SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORD_END = "</w>"
# The file's words and normalisation, for which the encoder cuts texts itself.
FILE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FILE_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

LETTER, NUMBER, BLANK, SIGN = range(4)
# The kinds of lower-case Latin-1 characters.
RUN_KINDS = np.full(256, SIGN, dtype=np.uint8)
RUN_KINDS[[*range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = LETTER
RUN_KINDS[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, *range(0xBC, 0xBF)]] = NUMBER
RUN_KINDS[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = BLANK
KIND_OF = RUN_KINDS.tobytes()
BLANKS = np.flatnonzero(RUN_KINDS == BLANK).astype(np.uint8).tobytes()
LOWERED = bytes(range(256)).decode("latin-1").lower().encode("latin-1")


def _class(kind: int) -> str:
    return "".join(rf"\x{c:02x}" for c in np.flatnonzero(RUN_KINDS == kind))


LATIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class(LETTER)}]+|[{_class(NUMBER)}]|[^{_class(LETTER)}{_class(NUMBER)}{_class(BLANK)}]+"
)


def _widths(ids: np.ndarray) -> np.ndarray:
    width = np.ones(len(ids), dtype=np.uint8)
    for bit in range(1, 61):
        over = ids >= U64(1 << bit)
        if not over.any():
            break
        width += over
    return width


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offsets of the blocks) of unsigned 64-bit ids.

    Every word takes as many of the block's next ids as any selector can.
    """
    ids = np.ascontiguousarray(ids, dtype=U64)
    n = len(ids)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.uint32)
    width = _widths(ids)
    choice = np.full(n, ESCAPE, dtype=np.uint8)
    widest = width.copy()
    span = 1
    for s in range(len(COUNTS) - 1, -1, -1):
        while span < min(int(COUNTS[s]), n):
            np.maximum(widest[: n - span], width[span:], out=widest[: n - span])
            span += 1
        fits = widest <= BITS[s]
        if not fits.any():
            break
        # Near the end of the ids ``widest`` covers fewer than the selector's count, and zeros fill the rest.
        choice[fits] = s
    starts = np.arange(0, n, BLOCK)
    ends = np.minimum(starts + BLOCK, n)
    # A run that would leave its block is cut at the block's end by its place there; the selector stays valid.
    at, blocks, order = starts.copy(), np.arange(len(starts)), 0
    begins, of, steps = [], [], []
    takes = np.append(COUNTS, [1, 1])
    while len(blocks):
        begins.append(at)
        of.append(blocks)
        steps.append(np.full(len(at), order))
        at = at + takes[choice[at]]
        order += 1
        alive = at < ends[blocks]
        at, blocks = at[alive], blocks[alive]
    begin, block = np.concatenate(begins), np.concatenate(of)
    sorted_ = np.lexsort((np.concatenate(steps), block))
    begin, block = begin[sorted_], block[sorted_]
    selector = choice[begin]
    size = 1 + (selector == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=U64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        first, end = begin[mine], ends[block[mine]]
        if s == ESCAPE:
            words[place[mine]] = U64(ESCAPE)
            words[place[mine] + 1] = ids[first]
            continue
        word = np.full(len(mine), s, dtype=U64)
        for k in range(int(COUNTS[s])):
            take = first + k
            inside = take < end
            if not inside.any():
                break
            value = np.where(inside, ids[np.minimum(take, n - 1)], U64(0))
            word |= value << U64(4 + k * int(BITS[s]))
        words[place[mine]] = word
    firsts = np.searchsorted(block, np.arange(len(starts)))
    return words, place[firsts].astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of ``pack``; all words of all blocks are decoded together."""
    if not n:
        return np.zeros(0, U64)
    selector = (words & U64(15)).astype(np.int64)
    if (selector == ESCAPE).any():
        # A word after an escape is a plain id, also if its low bits look like a selector.
        run = np.flatnonzero(selector == ESCAPE)
        plain = np.zeros(len(words), dtype=bool)
        for i in run:
            if not plain[i]:
                plain[i + 1] = True
        heads = np.flatnonzero(~plain)
    else:
        heads = np.arange(len(words))
    kind = selector[heads]
    takes = np.append(COUNTS, [1, 1])[kind]
    block = np.searchsorted(offsets, heads, side="right") - 1
    before = np.cumsum(takes) - takes
    begin = before - before[np.searchsorted(heads, offsets)][block] + block * BLOCK
    ends = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, dtype=U64)
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[begin[mine]] = words[heads[mine] + 1]
            continue
        payload = words[heads[mine]] >> U64(4)
        mask = U64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            place = begin[mine] + k
            inside = place < ends[mine]
            if not inside.any():
                break
            out[place[inside]] = (payload[inside] >> U64(k * int(BITS[s]))) & mask
    return out


def _is_latin(text: str) -> bool:
    if "<|" in text:  # may begin a special token, which is found before anything else
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _cuts_like_words(path: str) -> bool:
    """Whether the tokenizer file normalises and splits texts as ``Encoder`` does."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    normal, split, model = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}, made.get("model") or {}
    steps = split.get("pretokenizers") or [{}]
    return (
        normal.get("normalizers") == FILE_NORMAL
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": FILE_WORDS}
        and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
        and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
        and model.get("end_of_word_suffix") == WORD_END
        and not made.get("post_processor")
        and all("<|" in x["content"] and not re.search(r"\s", x["content"]) for x in made.get("added_tokens") or [])
    )


class Encoder:
    """Texts to their ids as little-endian 32-bit bytes, one by one equal to the tokenizer's own.

    With a file that normalises and splits like ``word_bpe_49k`` (NFC, lower case) a text of Latin-1 letters is
    cut into the tokenizer's own words here, any other at ASCII white space, across which
    the tokenizer never looks. A word met before is not encoded again; new ones go to the tokenizer many at once, where a
    token with the mark of a word's end closes each. With any other file whole texts go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = _cuts_like_words(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith(WORD_END)
        # Latin-1 words met before, the number of ids of each, and all their ids one after another.
        self.known = pa.array([], pa.binary())
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")
        self.memo: dict[str, bytes] = {"": b""}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[bytes] = [b""] * len(texts)
        plain, other = [], []
        for i, text in enumerate(texts):
            (plain if _is_latin(text) and "'" not in text else other).append(i)
        for i, ids in zip(plain, self._runs([texts[i] for i in plain]), strict=True):
            out[i] = ids
        for i, ids in zip(other, self._one_by_one([texts[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def _runs(self, texts: list[str]) -> Iterator[bytes]:
        """Latin-1 texts without apostrophes: words are runs of letters, single numbers and runs of other signs."""
        if not texts:
            return
        data = "\n".join([*texts, ""]).encode("latin-1").translate(LOWERED)
        kind = np.frombuffer(data.translate(KIND_OF), np.uint8)
        solid = kind != BLANK
        first = np.ones(len(kind), dtype=bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        packed = data.translate(None, BLANKS)
        borders = np.append(np.flatnonzero(first[solid]), len(packed)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(packed)])
        found = pc.index_in(runs, value_set=self.known)
        fresh = runs.filter(pc.is_null(found))
        new = fresh.unique()
        new_sizes, new_ids = self._encoded(new)
        of = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        of[of < 0] = len(self.known) + pc.index_in(fresh, value_set=new).to_numpy()
        sizes, ids = np.concatenate([self.sizes, new_sizes]), np.concatenate([self.ids, new_ids])
        self._keep(new, new_sizes, new_ids)
        size = sizes[of]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[of] - upto[:-1], size) + np.arange(upto[-1])]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        ends = np.cumsum(np.add.reduceat(solid, np.cumsum(lengths) - lengths, dtype=np.int64))
        at = 0
        for stop in upto[np.searchsorted(borders, ends)].tolist():
            yield ids[at:stop].tobytes()
            at = stop

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of every Latin-1 word, and their ids."""
        cuts = pa.array([*range(0, len(words), WORDS_AT_ONCE), len(words)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(cuts, words), b"\n").to_pylist() if len(words) else []
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        groups = self.tokenizer.encode_batch([g.decode("latin-1") for g in joined], add_special_tokens=False)
        for group, found in zip(joined, groups, strict=True):
            part = np.array(found.ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[part]) + 1
            if len(ends) == group.count(b"\n") + 1 and ends[-1] == len(part):
                size = np.diff(ends, prepend=0)
            else:
                each = self.tokenizer.encode_batch(group.decode("latin-1").split("\n"), add_special_tokens=False)
                size = np.array([len(e.ids) for e in each], dtype=np.int64)
                part = np.array([i for e in each for i in e.ids], dtype="<u4")
            sizes.append(size)
            ids.append(part)
        return np.concatenate(sizes), np.concatenate(ids)

    def _keep(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remembers new words while there is room."""
        room = MEMO_WORDS - len(self.known)
        short = np.flatnonzero(pc.binary_length(words).to_numpy() <= MEMO_CHARS)[: max(room, 0)]
        if len(short):
            kept = np.zeros(len(words), dtype=bool)
            kept[short] = True
            self.known = pa.concat_arrays([self.known, words.filter(pa.array(kept))])
            self.sizes = np.concatenate([self.sizes, sizes[kept]])
            self.ids = np.concatenate([self.ids, ids[np.repeat(kept, sizes)]])

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        latin = [_is_latin(text) for text in texts]
        split = [LATIN_WORDS.findall(t.lower()) if plain else SPACES.split(t) for t, plain in zip(texts, latin, strict=True)]
        memo = self.memo
        words = {w for found, plain in zip(split, latin, strict=True) if plain for w in set(found)} - memo.keys()
        chunks = {w for found, plain in zip(split, latin, strict=True) if not plain for w in set(found)} - memo.keys()
        fresh = self._words(list(words)) | self._chunks(list(chunks - words))
        memo |= fresh
        out = [b"".join(map(memo.__getitem__, found)) for found in split]
        full = len(memo) > MEMO_WORDS
        for word in fresh:
            if full or len(word) > MEMO_CHARS:
                del memo[word]
        return out

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch(chunks, add_special_tokens=False)
        return {c: np.array(e.ids, dtype="<u4").tobytes() for c, e in zip(chunks, found, strict=True)}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        sizes, ids = self._encoded(pa.array([w.encode("latin-1") for w in words], pa.binary()))
        data, ends = ids.tobytes(), np.cumsum(sizes) * 4
        return {w: data[end - 4 * n : end] for w, n, end in zip(words, sizes.tolist(), ends.tolist(), strict=True)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer's encoder, one for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# Words that the tokenizer takes as one text, and bytes of texts that are cut together.
WORDS_AT_ONCE = 256
TEXT_BYTES = 4 << 20


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> None:
    """Writes the ids of every text, ``end_id`` after each, in ascending order of doc_id to ``folder``.

    Null texts count as empty. Rows without an id come first; rows of equal ids stand in order of their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        part, chunk, start = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, names, counts, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            words, offsets = pack(np.frombuffer(b"".join(ids), dtype="<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([chunk], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    pa.array([offsets.astype("<u4").tobytes()], pa.binary()),
                ],
                names=["part", "chunk", "start", "doc_ids", "counts", "words", "offsets"],
            )

        for rows in slices(batches, 1, TEXT_BYTES):
            texts = [t or "" for t in rows.column(1).to_pylist()]
            for name, found in zip(rows.column(0).to_pylist(), encode(texts), strict=True):
                ids += (found, end)
                names.append(name)
                counts.append(len(found) // 4 + 1)
                held += counts[-1]
                if held >= CHUNK_IDS:
                    yield out()
                    chunk, start = chunk + 1, start + held
                    ids, names, counts, held = [], [], [], 0
        if names:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian 32-bit) of every document in ``folder``."""
    chunks = spark.read.schema(SCHEMA).parquet(folder)
    # One row for each part; the window runs over the parts, not over documents.
    sums = chunks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("part", before.alias("part_start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], dtype=np.int64)
                words, offsets = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<u4")
                ids = unpack(words, offsets.astype(np.int64), int(counts.sum())).astype("<u4")
                ends = np.cumsum(counts)
                begins = ends - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["part_start"] + row["start"] + begins, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return chunks.join(starts, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``read_tokens`` with the crc32 of the ids in their place."""
    for batch in batches:
        sums = pa.array([zlib.crc32(ids.as_buffer()) for ids in batch.column(3)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sums], names=["doc_id", "start", "n_tokens", "ids_crc32"])
