"""Benchmark decontamination: Wu-Manber multi-pattern search over words, many positions at a time."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Hasher, as_bytes, mixed, packed, parts, released

#: Bytes of words once A-Z is lower-cased: digits, a-z and everything beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Adjoining words that index the shift table, and words of a suffix that select a bucket.
BLOCK, SUFFIX = 2, 4
#: Bytes of documents that pass through one block of the benchmark after another.
TOGETHER = 32 << 20
_hash = Hasher(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts: lower-cased bytes, spans, hashes, and the text of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], LETTER[data], [False]))))
        self.data, self.a, self.b = data.tobytes(), edge[::2], edge[1::2]
        self.hash = _hash.between(_hash.sums(data), self.a, self.b)
        self.doc = np.searchsorted(offsets, self.a, side="right") - 1

    def runs(self, n: int) -> np.ndarray:
        """For each word the hash of the n words that end with it; where fewer come before, of some that wrap around."""
        h = np.zeros(len(self.hash), dtype=np.uint64)
        for i in range(n - 1, -1, -1):
            h = mixed(h * _STEP + np.roll(self.hash, i))
        return h

    def same(self, end: int, n: int, other: Words, other_end: int) -> bool:
        """Direct comparison of n words with as many of the other's."""
        mine = [self.data[a:b] for a, b in zip(self.a[end - n + 1 : end + 1], self.b[end - n + 1 : end + 1], strict=True)]
        return mine == [other.data[a:b] for a, b in zip(other.a[other_end - n + 1 : other_end + 1], other.b[other_end - n + 1 : other_end + 1], strict=True)]


class Patterns:
    """Search tables for the word sequences of one length: arrays sorted by hash.

    shift: for each block of words, how far the next possible end of a pattern is at least; a block in no pattern is
    as good as length - block + 1. bucket: the ends of patterns by the hash of their suffix.
    """

    def __init__(self, length: int, words: Words, ends: np.ndarray):
        self.length, self.block, self.suffix = length, min(BLOCK, length), min(SUFFIX, length)
        self.far = length - self.block + 1
        blocks = words.runs(self.block)
        keys = np.concatenate([blocks[ends - d] for d in range(self.far)])
        order = np.argsort(keys, kind="stable")  # the least shift of a block comes first
        self.keys, first = np.unique(keys[order], return_index=True)
        self.shift = np.repeat(np.arange(self.far, dtype=np.int16), len(ends))[order][first]
        suffixes = words.runs(self.suffix)[ends]
        order = np.argsort(suffixes, kind="stable")
        self.bucket, self.ends = suffixes[order], ends[order].astype(np.int32)

    def search(self, text: Words, patterns: Words):
        """Yields (end in the text, end in the patterns) of every occurrence.

        A position can only end a pattern if the blocks that end there and before it, back to the pattern's first, all allow it by their shifts.
        """
        n = len(text.hash)
        if n < self.length:
            return
        blocks = text.runs(self.block)
        at = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
        shift = np.where(self.keys[at] == blocks, self.shift[at], self.far)
        possible = np.zeros(n, dtype=bool)
        possible[self.length - 1 :] = text.doc[self.length - 1 :] == text.doc[: n - self.length + 1]
        for d in range(self.far):
            possible[d:] &= shift[: n - d] <= d
        ends = np.flatnonzero(possible)
        if not len(ends):
            return
        key = text.runs(self.suffix)[ends]
        lo, hi = np.searchsorted(self.bucket, key, "left"), np.searchsorted(self.bucket, key, "right")
        for end, a, b in zip(ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for p in self.ends[a:b].tolist():
                if text.same(end, self.length, patterns, p):
                    yield end, p


class Tables:
    """One block of the benchmark: its words, item ids, and patterns of each length, some 6 bytes for each of its own."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        data = b" ".join(t for _, t in items) + b" "
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for _, t in items])))
        lower = np.frombuffer(data.lower(), dtype=np.uint8)
        self.ids, self.words = [i for i, _ in items], Words(lower, offsets)
        n = np.bincount(self.words.doc, minlength=len(items))
        size = np.minimum(n, window)[self.words.doc]
        nth = np.arange(len(self.words.doc)) - np.concatenate(([0], np.cumsum(n)))[self.words.doc]
        ends = np.flatnonzero(nth >= size - 1)
        self.patterns = [Patterns(int(m), self.words, ends[size[ends] == m]) for m in np.unique(size)]

    def search(self, text: Words):
        """Yields (first word, last word, item) of every occurrence."""
        for p in self.patterns:
            for end, at in p.search(text, self.words):
                yield end - p.length + 1, end, int(self.words.doc[at])


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in lists of bounded size, one in the driver's memory at a time; null texts hold nothing."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t"))
    for r in rows.filter("t is not null").toLocalIterator():
        if block and size + len(r.t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
    if block:
        yield block


def sent_tables(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """The tables of each block of items, each broadcast by itself; a block's size is bounded by block_bytes and one item."""
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(Tables(b, window)) for b in blocks_of(benchmark, item_col, text_col, block_bytes)]


def found_in(texts: list[bytes], sent: list) -> list[tuple[int, int, list[str | None]]]:
    """(words, words hit, ids of the items found) of each text. With several blocks, a worker holds one block's tables at a time."""
    split = [(first, Words(data, offsets)) for first, data, offsets in packed(texts)]
    hit = [np.zeros(len(w.hash), dtype=bool) for _, w in split]
    found: dict[int, set] = defaultdict(set)
    for block in sent:
        tables = block.value
        for (first, w), h in zip(split, hit, strict=True):
            for a, z, item in tables.search(w):
                h[a : z + 1] = True
                found[first + int(w.doc[a])].add(tables.ids[item])
        if len(sent) > 1:
            del tables
            block.__dict__.pop("_value", None)  # read again from the worker's file when its turn comes
            released()
    out = []
    for (first, w), h, last in zip(split, hit, [*[s[0] for s in split[1:]], len(texts)], strict=True):
        n, of = np.bincount(w.doc, minlength=last - first), np.bincount(w.doc, weights=h, minlength=last - first).astype(int)
        out += [(int(n[i]), int(of[i]), sorted(found[first + i], key=lambda x: (x is not None, x or ""))) for i in range(last - first)]
    return out


def slices(batches, blocks: int):
    """Batches in slices; with several blocks of the benchmark larger ones, so that each block is read less often."""
    return parts(batches, TOGETHER if blocks > 1 else 2 << 20)


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, n_items, items, contaminated).

    Null and empty texts have no words and are clean. Items without a text or without words match nothing; items with equal ids count once, and those
    with a null id are one item, listed as null. Repeated documents are each reported; an empty benchmark leaves all clean. Other columns of
    either table are not read. No shuffle: a document is searched where it is read. A worker holds the tables of block_bytes of the benchmark, some 7 times as much, however large that is.
    """
    sent = sent_tables(benchmark, item_col, item_text_col, window, block_bytes)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType()),
    ])

    def run(batches):
        for b in slices(batches, len(sent)):
            got = found_in(as_bytes(b.column(1)), sent)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([len(g[2]) for g in got], pa.int64()),
                pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[1] > 0 for g in got], pa.bool_()),
            ], names=schema.names)

    return src.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents, all columns as they are, that hold no window of an item. Cases as in overlaps()."""
    sent = sent_tables(benchmark, item_col, item_text_col, window, block_bytes)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, len(sent)):
            yield b.filter(pa.array([not hit for _, hit, _ in found_in(as_bytes(b.column(at)), sent)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
