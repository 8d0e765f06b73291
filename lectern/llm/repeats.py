"""Suffix-array dedup: bytes covered by long strings that occur elsewhere too.

A suffix is represented by its leading tokens, hashes of the strings it begins with. Three arrays of suffixes are sorted, each finer and smaller than the one before, always
in the same way: sampled splitters range-partition the suffixes by their leading tokens, each bucket is sorted by multikey quicksort, and neighbours are
compared, those across bucket boundaries too (sorted_runs).

1. A sparse array has one suffix for each anchor, the position whose hash is least among those of a window. Windows with equal bytes have their anchors at the
   same place, so all suffixes whose windows share an anchor stand together as a block. The first token is the anchor's own string, which all of the block's windows contain, the others
   are the block's whole contents. In a run of equal tokens all suffixes of the blocks are repeated; a block whose first token
   stands alone has no repeated suffix.
2. One of each kind of the blocks in a run with one first token and different contents, at the ends of repeated passages, is cut into smaller ones with longer first tokens, which are
   sorted in the same way.
3. The single suffixes of what is left are sorted by the tokens of their whole length.

Ties are broken by document and position, so splitters may fall among equal suffixes and a passage in a third of all documents is dealt over
many buckets. Joins that follow are on a few rows at each bucket's ends. Blocks are told apart by 192 bits of hashes and suffixes by as many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Hasher, as_bytes, mixed, scratch, stored
from lectern.llm.common import parts as slices

#: Bytes of an anchor's string, and suffixes in a small block.
ANCHOR, SMALL = 64, 32
#: Bytes at work at a time.
SEGMENT = 1 << 20
#: Rows that one sort bucket holds, about.
BUCKET = 1 << 19

_one, _two = Hasher(21), Hasher(22)
#: Tokens by which suffixes sort.
TOKENS = ["t1", "t2", "t3"]


def least_positions(keys: np.ndarray, w: int) -> np.ndarray:
    """For each s the position of the least key in [s, s + w), the first of equal ones. Keys have the position in their low 21 bits."""
    n = len(keys) - w + 1
    pad = -len(keys) % w
    k = np.concatenate((keys, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(k, axis=1).ravel()
    right = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & np.uint64((1 << 21) - 1)).astype(np.int64)


def segments(texts: list[bytes], length: int):
    """Texts of `length` bytes or more, joined, or parts of one long text that overlap: yields (bytes, ends, first offset of each, index of each)."""
    joined, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > SEGMENT:
            for at in range(0, len(t) - length + 1, SEGMENT):
                part = t[at : at + SEGMENT + length - 1]
                yield np.frombuffer(part, dtype=np.uint8), np.array([len(part)]), np.array([at]), np.array([i])
            continue
        if joined and size + len(t) > SEGMENT:
            yield _joined(texts, joined)
            joined, size = [], 0
        joined.append(i)
        size += len(t)
    if joined:
        yield _joined(texts, joined)


def _joined(texts, ids):
    return np.frombuffer(b"".join(texts[i] for i in ids), dtype=np.uint8), np.cumsum([len(texts[i]) for i in ids]), np.zeros(len(ids), dtype=np.int64), np.array(ids)


def anchor_blocks(texts: list[bytes], length: int):
    """Yields arrays (text, core, two of the whole, anchor, first start, last start), positions within the text."""
    w = length - ANCHOR + 1
    for data, ends, base, ids in segments(texts, length):
        sums, more = _one.sums(data), _two.sums(data)
        at = np.arange(len(data) - ANCHOR + 1)
        h = _one.between(sums, at, at + ANCHOR)
        low = least_positions((mixed(h) >> np.uint64(21) << np.uint64(21)) | at.astype(np.uint64), w)
        begins = np.concatenate(([0], ends[:-1]))
        # Starts whose windows lie in one text, and runs of them with one anchor.
        ok = np.zeros(len(low) + 1, dtype=np.int64)
        np.add.at(ok, begins, 1)
        np.add.at(ok, np.minimum(ends - length + 1, len(low)), -1)
        ok = np.cumsum(ok)[:-1] > 0
        starts = np.flatnonzero(ok)
        anchor = low[starts]
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        lo, hi, p = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1], anchor[new]
        place = mixed((p - lo).astype(np.uint64) * np.uint64(4096) + (hi - lo).astype(np.uint64))
        whole = [mixed(x.between(y, lo, hi + length) + place) for x, y in ((_one, sums), (_two, more))]
        text = np.searchsorted(ends, lo, side="right")
        shift = base[text] - begins[text]
        yield ids[text], h[p], whole, p + shift, lo + shift, hi + shift


def blocks(docs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, t3, doc_id, tkey, anchor, lo, hi) of each block."""

    def run(batches):
        for b in slices(batches):
            for i, core, whole, p, lo, hi in anchor_blocks(as_bytes(b.column(2)), length):
                rows = pa.array(i, pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (core, *whole)], b.column(0).take(rows), b.column(1).take(rows), *[pa.array(x, pa.int32()) for x in (p, lo, hi)]], names=[*TOKENS, "doc_id", "tkey", "anchor", "lo", "hi"])

    return docs.mapInArrow(run, f"t1 long, t2 long, t3 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tkey long, anchor int, lo int, hi int")


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the keys, first to last: a three-way partition on one key, then on the next among equal ones."""
    order = np.arange(len(keys[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, k = stack.pop()
        if hi - lo < 2 or k == len(keys):
            continue
        part = order[lo:hi]
        if hi - lo <= 4096:
            order[lo:hi] = part[np.lexsort([x[part] for x in keys[k:][::-1]])]
            continue
        x = keys[k][part]
        some = x[:: max(1, len(x) // 255)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        less, more = x < pivot, x > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate((part[less], part[same], part[more]))
        a, b = lo + int(less.sum()), hi - int(more.sum())
        stack += [(lo, a, k), (a, b, k + 1), (b, hi, k)]
    return order


def runs_of(t: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorts a bucket's tokens: (order, rows in each row's run, whether it is the first of its run, kinds with its first token, whether to look at it again).

    Rows of a run have all tokens equal; runs with one first token are its kinds. To look at again are the first and the last run of the first token that the
    bucket begins with, and of that it ends with: they may go on, or meet other kinds, in the next bucket.
    """
    order = multikey_quicksort(t)
    t = [x[order] for x in t]
    n = len(order)
    new_core = np.concatenate(([True], t[0][1:] != t[0][:-1]))
    new = new_core.copy()
    for x in t[1:]:
        new[1:] |= x[1:] != x[:-1]
    run, core = np.cumsum(new) - 1, np.cumsum(new_core) - 1
    size, kinds = np.bincount(run), np.bincount(core[new])
    first_run, last_run = run[new_core], run[np.concatenate((np.flatnonzero(new_core)[1:], [n])) - 1]
    ends = np.unique([first_run[0], last_run[0], first_run[-1], last_run[-1]])
    return order, size[run], new, kinds[core], np.isin(run, ends)


def sorted_runs(rows: DataFrame, keep: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """Sorts rows (t1, t2, t3, *keep) and returns (those whose tokens another row has, one row of each kind whose first token other kinds have), with n, how many rows have its tokens."""
    buckets = max(1, -(-rows.count() // BUCKET))
    ranged = rows.repartitionByRange(buckets, *TOKENS, *keep).withColumn("bucket", F.spark_partition_id())
    fields = [*ranged.schema.fields[:-1], *T.StructType.fromDDL("bucket int, n long, lead boolean, several boolean, edge boolean").fields]

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        order, size, lead, kinds, again = runs_of([t.column(c).to_numpy() for c in TOKENS])
        several = kinds > 1
        wanted = np.flatnonzero((size > 1) | lead & (several | again))
        out = t.select([*TOKENS, *keep, "bucket"]).take(pa.array(order[wanted]))
        for name, x in (("n", size), ("lead", lead), ("several", several), ("edge", lead & again)):
            out = out.append_column(name, pa.array(x[wanted]))
        yield from out.to_batches()

    found = stored(ranged.mapInArrow(run, T.StructType(fields)), path)
    # Four rows a bucket at most: how often these kinds occur in all buckets, and whether their first token has other kinds.
    edge = found.filter("edge")
    kinds = edge.groupBy(*TOKENS).agg(F.sum("n").alias("n"), F.min("bucket").alias("bucket"), F.max("several").alias("several"))
    cores = kinds.groupBy("t1").agg((F.max("several") | (F.count(F.lit(1)) > 1)).alias("several"))
    edge = edge.select(*TOKENS, *keep, "bucket").join(kinds.drop("several").withColumnRenamed("bucket", "least"), TOKENS).join(cores, "t1")
    mine = [*TOKENS, *keep, "n"]
    twins = found.filter("n > 1 and not edge").select(mine).unionByName(edge.filter("n > 1").select(mine))
    reps = found.filter("lead and several and not edge").select(mine).unionByName(edge.filter("several and bucket = least").select(mine))
    return twins, reps


def small_blocks(rep: DataFrame, length: int) -> DataFrame:
    """Cuts each block at every SMALL-th distance from its anchor, the same in all documents."""

    def run(batches):
        for b in slices(batches):
            ids, anchors, los, his, data = (b.column(i).to_pylist() for i in range(5))
            out: list[list] = [[] for _ in range(6)]
            for i, p, lo, hi, t in zip(ids, anchors, los, his, data, strict=True):
                data = np.frombuffer(t, dtype=np.uint8)
                sums, more = _one.sums(data), _two.sums(data)
                c = np.arange((p - hi) // SMALL, (p - lo) // SMALL + 1)
                near, far = p - c * SMALL - lo, p - c * SMALL - SMALL + 1 - lo  # the starts of a whole small block, latest and first
                a, z = np.maximum(far, 0), np.minimum(near, hi - lo)
                core = mixed(_one.between(sums, near, far + length) + mixed(c.astype(np.uint64)))
                place = mixed(((near - a) * 4096 + near - z).astype(np.uint64))
                whole = [mixed(x.between(y, a, z + length) + place) for x, y in ((_one, sums), (_two, more))]
                for o, x in zip(out, (core.view(np.int64), *[w.view(np.int64) for w in whole], np.full(len(c), i), a, z), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else [], pa.int64()) for o in out], names=[*TOKENS, "rep", "lo", "hi"])

    return rep.select("rep", "anchor", "lo", "hi", "data").mapInArrow(run, "t1 long, t2 long, t3 long, rep long, lo long, hi long")


def suffixes(rep: DataFrame, small: DataFrame, length: int) -> DataFrame:
    """(t1, t2, t3, rep, at) of every suffix of the small blocks: hashes of the first half of its length, of the other half, and another of all of it."""
    lists = small.groupBy("rep").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))  # a block's parts, a dozen at most

    def run(batches):
        half = length // 2
        for b in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for i, t, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = np.frombuffer(t, dtype=np.uint8)
                one, two = _one.sums(data), _two.sums(data)
                at = np.concatenate([np.arange(p["lo"], p["hi"] + 1) for p in parts])
                tokens = _one.between(one, at, at + half), _one.between(one, at + half, at + length), _two.between(two, at, at + length)
                for o, x in zip(out, (*[x.view(np.int64) for x in tokens], np.full(len(at), i), at), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else [], pa.int64()) for o in out], names=[*TOKENS, "rep", "at"])

    return rep.select("rep", "data").join(lists, "rep").select("rep", "data", "parts").mapInArrow(run, "t1 long, t2 long, t3 long, rep long, at long")


def removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per document; kept is what is left, as bytes.

    Texts are UTF-8 bytes. Every byte goes that lies in a string of `length` bytes which starts anywhere else too, in the same
    document or another; strings are judged on the input. Null texts are empty; empty and shorter texts lose nothing. Repeated rows are copies of
    each other and lose everything from `length` bytes on. An empty table gives an empty one. Null ids are ids. Other columns are not read.
    Texts go through the shuffle twice, blocks of suffixes as some 40 bytes for every 170.
    """
    if length < 2 * ANCHOR or (length - ANCHOR) >= 4096:
        raise ValueError(f"length must be between {2 * ANCHOR} and {ANCHOR + 4095}")
    spark = docs.sparkSession
    path = scratch(spark)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("tkey"), "text")

    b = stored(blocks(d.filter(F.octet_length("text") >= length), length), f"{path}/blocks")
    done, reps = sorted_runs(b, ["doc_id", "tkey", "anchor", "lo", "hi"], f"{path}/sorted")
    reps = stored(reps.withColumn("rep", F.xxhash64("doc_id", "tkey", "lo")), f"{path}/reps")
    mine = reps.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("rep", "anchor", "lo", "hi")).alias("parts"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for x in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for t, parts in zip(as_bytes(x.column(0)), x.column(1).to_pylist(), strict=True):
                for p in parts:
                    for o, v in zip(out, (p["rep"], p["anchor"], p["lo"], p["hi"], t[p["lo"] : p["hi"] + length]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(o, pa.int64()) for o in out[:4]], pa.array(out[4], pa.binary())], names=["rep", "anchor", "lo", "hi", "data"])

    same = _same(d, mine)
    data = same.select("text", "parts").mapInArrow(cut, "rep long, anchor long, lo long, hi long, data binary")
    data = stored(data.dropDuplicates(["rep"]), f"{path}/data")
    small = stored(small_blocks(data, length), f"{path}/small/blocks")
    done2, reps2 = sorted_runs(small, ["rep", "lo", "hi"], f"{path}/small/sorted")
    twins, _ = sorted_runs(stored(suffixes(data, reps2.select("rep", "lo", "hi"), length), f"{path}/suffixes/all"), ["rep", "at"], f"{path}/suffixes/sorted")
    inner = done2.select("rep", "lo", "hi").unionByName(twins.select("rep", F.col("at").alias("lo"), F.col("at").alias("hi")))
    # A kind of block that occurs twice is done already; the others' positions are those of their one document.
    one = reps.filter("n = 1").select("rep", "doc_id", "tkey", F.col("lo").alias("from"))
    inner = inner.join(one, "rep").select("doc_id", "tkey", (F.col("lo") + F.col("from")).alias("lo"), (F.col("hi") + F.col("from")).alias("hi"))
    spans = done.select("doc_id", "tkey", "lo", "hi").unionByName(inner)
    spans = spans.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))

    def keep(batches):
        for x in slices(batches):
            sizes, gone, n, kept = [], [], [], []
            for t, parts in zip(as_bytes(x.column(1)), x.column(2).to_pylist(), strict=True):
                cuts: list[list[int]] = []
                for lo, hi in sorted((p["lo"], p["hi"] + length) for p in parts or ()):
                    if cuts and lo <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], hi)
                    else:
                        cuts.append([lo, hi])
                at = [0, *[v for c in cuts for v in c], len(t)]
                kept.append(b"".join(t[at[i] : at[i + 1]] for i in range(0, len(at), 2)) if cuts else t)
                sizes.append(len(t))
                gone.append(len(t) - len(kept[-1]))
                n.append(len(cuts))
            yield pa.RecordBatch.from_arrays([x.column(0), *[pa.array(v, pa.int64()) for v in (sizes, gone, n)], pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _same(d, spans, "left").select("doc_id", "text", "parts").mapInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _same(d: DataFrame, parts: DataFrame, how: str = "inner") -> DataFrame:
    p = parts.select(F.col("doc_id").alias("pid"), F.col("tkey").alias("pkey"), "parts")
    return d.join(p, d["doc_id"].eqNullSafe(p["pid"]) & (d["tkey"] == p["pkey"]), how)
