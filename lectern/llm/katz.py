"""Katz backoff language model over words, of any order, trained and evaluated block by block.

Documents are dealt into blocks of bounded size. A block asks for the training counts of the n-grams that it holds: its
distinct keys, sorted, go to parts by their leading bits; a part adds up what all blocks sent and answers in the order asked, with
a flag for the one block that is to speak for a key. So an n-gram that all documents share is one row per block, and keys are
spread by hash, whatever is frequent. In the same way blocks then gather, for each context, how often it occurs, its discounted mass and the mass that
its seen words have in the next shorter model; these give backoff weights that make each context's probabilities sum to 1. A last
round scores every token, from single words up to the longest n-gram.

The sums that parts come to are the model: tables of n-gram counts and of contexts' backoff weights, partitioned by order, a row for each part. It
stays where train() writes it, and score() evaluates it on any documents.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Hasher, as_bytes, mixed, packed, scratch, stored, word_spans
from lectern.llm.common import parts as parts_of

#: Counts up to this are discounted by Good-Turing.
CUTOFF = 5
_hash = Hasher(5)
_FIRST, _LAST = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5B)
_STEP = np.uint64(0x9E3779B97F4A7C15)
ASKED = "kind int, part int, block int, keys binary, counts binary, sums binary"
TOLD = "block int, kind int, part int, keys binary, counts binary, sums binary, stats array<long>"
#: Kind of the contexts of n-grams of order k, beyond k; blocks that stand for what a part tells the driver, and the model.
CONTEXT, STATS, MODEL = 100, -1, -2


def squeezed(x: np.ndarray) -> bytes:
    """Compressed, byte planes apart: of small numbers in wide fields little is left."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def unsqueezed(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def key_bytes(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def keys_of(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(b, np.uint64), dtype=np.uint64)


class Block:
    """The tokens of some documents: hashes of the n-grams that end at each, for each order, and of their contexts."""

    def __init__(self, texts: list[bytes], train: np.ndarray, order: int):
        words, lens = [], []
        for _, data, offsets in packed(texts):
            a, b = word_spans(data)
            words.append(_hash.between(_hash.sums(data), a, b))
            lens.append(np.diff(np.searchsorted(a, offsets)))
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        n = np.concatenate(lens) if lens else np.empty(0, np.int64)
        pad = order - 1
        # Each document: pad first tokens, its words, one last token.
        size = n + pad + 1
        ends = np.cumsum(size)
        start = ends - size
        seq = np.full(int(ends[-1]) if len(ends) else 0, _FIRST, dtype=np.uint64)
        real = np.ones(len(seq), dtype=bool)
        for i in range(pad):
            real[start + i] = False
        if len(ends):
            seq[ends - 1] = _LAST
        inner = real.copy()
        if len(ends):
            inner[ends - 1] = False
        seq[inner] = flat
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.train = train[self.doc] if len(n) else np.empty(0, bool)
        self.grams, self.contexts = [], []
        h = mixed(seq)
        for k in range(1, order + 1):
            if k > 1:
                self.contexts.append(prev := np.concatenate((h[:1], h[:-1])))
                h = mixed(prev * _STEP + mixed(seq))
                self.contexts[-1] = self.contexts[-1][real]
            self.grams.append(h[real])
        self.n_docs = len(n)


def ask(kind: int, block: int, parts: int, keys: np.ndarray, counts: np.ndarray, sums: list[np.ndarray]) -> list[tuple]:
    """One row per part that some key falls into; keys are sorted, so parts are slices."""
    bits = parts.bit_length() - 1
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.searchsorted(part, np.arange(parts + 1))
    return [(kind, p, block, key_bytes(keys[a:b]), squeezed(counts[a:b].astype(np.uint32)), squeezed(np.stack([s[a:b] for s in sums], axis=1)) if sums else b"") for p in range(parts) if (a := int(cut[p])) < (b := int(cut[p + 1]))]


def arrow(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)}, schema=schema)


ASKED_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())])
TOLD_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary()), ("stats", pa.list_(pa.int64()))])


def answered(asked: DataFrame, sums: bool) -> DataFrame:
    """Adds up by key and answers each block. With sums: (occurrences, seen mass, mass in the shorter model) of contexts becomes (backoff weight, scale of seen words); else counts and who speaks for a key."""

    def add(key, t):
        kind, part = key[0].as_py(), key[1].as_py()
        blocks = t["block"].to_pylist()
        order = np.argsort(blocks, kind="stable")
        keys = [keys_of(t["keys"][int(i)].as_py()) for i in order]
        lens = np.cumsum([0, *map(len, keys)])
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unsqueezed(t["counts"][int(i)].as_py(), np.uint32) for i in order]).astype(np.int64)
        total = np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)
        out = []
        if sums:
            v = np.concatenate([unsqueezed(t["sums"][int(i)].as_py(), np.dtype((np.void, 16))).view(np.float64).reshape(-1, 2) for i in order])
            seen, lower = (np.bincount(at, weights=v[:, j], minlength=len(unique)) for j in (0, 1))
            alpha, scale = backoff(total, seen, lower)
            both = np.stack((alpha, scale), axis=1)[at]
            for i, a, b in zip(order, lens, lens[1:], strict=False):
                out.append((blocks[int(i)], kind, part, None, squeezed(total[at[a:b]]), squeezed(both[a:b]), None))
            had = total > 0
            if had.any():
                out.append((MODEL, kind, part, key_bytes(unique[had]), squeezed(total[had]), squeezed(np.stack((alpha, scale), axis=1)[had]), None))
        else:
            first = np.full(len(unique), len(at))
            has = np.flatnonzero(counts > 0)
            np.minimum.at(first, at[has], has)
            speaks = (first[at] == np.arange(len(at))).astype(np.uint8)
            for i, a, b in zip(order, lens, lens[1:], strict=False):
                out.append((blocks[int(i)], kind, part, None, squeezed(total[at[a:b]]), squeezed(speaks[a:b]), None))
            had = total > 0
            if had.any():
                out.append((MODEL, kind, part, key_bytes(unique[had]), squeezed(total[had]), None, None))
            of = np.bincount(np.minimum(total, CUTOFF + 2), minlength=CUTOFF + 3)
            out.append((STATS, kind, part, None, None, None, [int(total.sum()), int((total > 0).sum()), *map(int, of[1 : CUTOFF + 2])]))
        return arrow(out, TOLD_ARROW)

    return asked.groupBy("kind", "part").applyInArrow(add, TOLD)


def backoff(total: np.ndarray, seen: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(backoff weight, scale of seen words' probabilities) so that a context's probabilities sum to 1; where discounts leave less than one of total + 1 shares, seen words are scaled down to leave that."""
    n = np.maximum(total, 1)
    share = seen / n
    left = np.maximum(1 - share, 1 / (n + 1))
    scale = np.where(share > 0, (1 - left) / np.maximum(share, 1e-300), 1.0)
    alpha = left / np.maximum(1 - lower, 1e-12)
    return np.where(total > 0, alpha, 1.0), np.where(total > 0, scale, 1.0)


def discounts(of: list[int]) -> np.ndarray:
    """Katz's discount ratios for counts 0 to CUTOFF + 1 (the last for all larger): Good-Turing where the counts of counts allow, else half a count off."""
    n = [0, *of]
    d = np.ones(CUTOFF + 2)
    d[0] = 0
    a = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        got = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
        d[r] = got if 0 < got < 1 else (r - 0.5) / r
    return d


class Level:
    """Totals of one order: tokens, distinct n-grams, discount ratios."""

    def __init__(self, stats: list[int]):
        self.tokens, self.types = stats[0], stats[1]
        self.d = discounts(stats[2:])
        n = [0, *stats[2:]]
        kept = self.tokens - sum(n[r] * r * (1 - self.d[r]) for r in range(1, CUTOFF + 1))
        total = np.array([self.tokens])
        self.unseen, self.scale = (float(x[0]) for x in backoff(total, np.array([kept]), np.array([0.0]))) if self.tokens else (1.0, 1.0)

    def mass(self, counts: np.ndarray) -> np.ndarray:
        return counts * self.d[np.minimum(counts, CUTOFF + 1)]


def evaluated(b: Block, told: pa.Table, levels: list[Level], upto: int):
    """For each token the probability under the model of order `upto`, from single words up; yields (unique keys' order, counts, speaks) of each level as it goes: returns (p, per level (first index, inverse, counts, speaks))."""
    got: dict[int, list] = {}
    for kind, part, counts, sums in zip(*(told[c].to_pylist() for c in ("kind", "part", "counts", "sums")), strict=True):
        got.setdefault(kind, []).append((part, counts, sums))
    seen, p = [], None
    for k in range(1, len(b.grams) + 1):
        _, first, at = np.unique(b.grams[k - 1], return_index=True, return_inverse=True)
        rows = sorted(got[k], key=lambda r: r[0])
        counts = np.concatenate([unsqueezed(r[1], np.int64) for r in rows])
        speaks = np.concatenate([unsqueezed(r[2], np.uint8) for r in rows]).astype(bool)
        seen.append((first, at, counts, speaks))
        if k > upto:
            continue
        c = counts[at]
        if k == 1:
            one = levels[0]
            p = np.where(c > 0, one.scale * one.mass(c) / max(one.tokens, 1), one.unseen)
            continue
        rows = sorted(got[CONTEXT + k], key=lambda r: r[0])
        total = np.concatenate([unsqueezed(r[1], np.int64) for r in rows])
        both = np.concatenate([unsqueezed(r[2], np.dtype((np.void, 16))).view(np.float64).reshape(-1, 2) for r in rows])
        ctx = np.unique(b.contexts[k - 2], return_inverse=True)[1]
        p = np.where(c > 0, both[ctx, 1] * levels[k - 1].mass(c) / np.maximum(total[ctx], 1), both[ctx, 0] * p)
    return p, seen


class Model:
    """Tables below path, in grams/role=model and contextsK/role=model: (kind, part, keys, counts, sums), kind the order, beyond CONTEXT that of contexts; a row for each part of the keys. Totals of each order."""

    def __init__(self, path: str, levels: list[Level], parts: int):
        self.path, self.levels, self.parts = path, levels, parts


def prepared(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))


def packed_rows(d: DataFrame) -> DataFrame:
    """(block, doc_ids, trains, lens, texts): a slice's documents of each block in one row, texts compressed together, so that little moves."""
    kind = d.schema["doc_id"].dataType

    def run(batches):
        for b in parts_of(batches, 8 << 20):
            block = b.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[order], prepend=-1))
            rows, texts = b.take(pa.array(order)), as_bytes(b.column(2).take(pa.array(order)))
            ends = [*cut[1:].tolist(), len(order)]
            offsets = pa.array([*cut.tolist(), len(order)], pa.int32())
            lens = [np.array([len(t) for t in texts[i:j]], dtype=np.int32).tobytes() for i, j in zip(cut.tolist(), ends, strict=True)]
            zipped = [zstandard.ZstdCompressor(level=3).compress(b"".join(texts[i:j])) for i, j in zip(cut.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[order][cut], pa.int32()), pa.ListArray.from_arrays(offsets, rows.column(0)), pa.ListArray.from_arrays(offsets, rows.column(1)), pa.array(lens, pa.binary()), pa.array(zipped, pa.binary())], names=["block", "doc_ids", "trains", "lens", "texts"])

    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("trains", T.ArrayType(T.BooleanType())), T.StructField("lens", T.BinaryType()), T.StructField("texts", T.BinaryType())])
    return d.select("doc_id", "train", "text", "block").mapInArrow(run, schema)


class Blocks:
    """Documents dealt into blocks of about block_bytes by hash: a table of the session's catalog, bucketed by block so that each round reads it without a shuffle, some task_bytes to a bucket and a file."""

    def __init__(self, d: DataFrame, path: str, block_bytes: int, task_bytes: int):
        spark = d.sparkSession
        size = d.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
        self.n, self.name, self.kind = max(1, -(-size // block_bytes)), f"lectern_{uuid.uuid4().hex}", d.schema["doc_id"].dataType.simpleString()
        buckets = max(1, -(-size // task_bytes))
        most = "spark.sql.sources.bucketing.maxBuckets"
        if buckets > int(spark.conf.get(most)):
            spark.conf.set(most, buckets)
        d = packed_rows(d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(self.n)).cast("int")))
        # Dealt as the table is bucketed, so that a bucket is one file.
        d.repartition(buckets, "block").write.option("path", path).option("compression", "none").bucketBy(buckets, "block").saveAsTable(self.name)
        self.rows = spark.table(self.name)

    def drop(self) -> None:
        self.rows.sparkSession.sql(f"drop table if exists {self.name}")


def listed(t: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in t[column].chunks]) if t[column].num_chunks else pa.array([], t[column].type.value_type)


def loaded(t: pa.Table, order: int) -> Block:
    texts = []
    for lens, data in zip(t["lens"].to_pylist(), t["texts"].to_pylist(), strict=True):
        whole, at = zstandard.ZstdDecompressor().decompress(data) if len(data) else b"", 0
        for n in np.frombuffer(lens, dtype=np.int32).tolist():
            texts.append(whole[at : at + n])
            at += n
    return Block(texts, np.array(listed(t, "trains").to_pylist(), dtype=bool), order)


def asking(order: int, parts: int, contexts: bool):
    """A block's distinct keys with their training counts; with contexts, those of contexts too."""

    def asked(key, t):
        b, rows = loaded(t, order), []
        for k, g in enumerate(b.grams, 1):
            keys, at = np.unique(g, return_inverse=True)
            rows += ask(k, key[0].as_py(), parts, keys, np.bincount(at[b.train], minlength=len(keys)), [])
        for k, g in enumerate(b.contexts if contexts else (), 2):
            keys = np.unique(g)
            rows += ask(CONTEXT + k, key[0].as_py(), parts, keys, np.zeros(len(keys)), [])
        return arrow(rows, ASKED_ARROW)

    return asked


def tables(told: DataFrame, path: str) -> DataFrame:
    """Writes what the parts told, the model apart from the answers, by kind; reads all of it."""
    told.withColumn("role", F.when(F.col("block") == MODEL, "model").otherwise("answers")).write.option("compression", "none").partitionBy("role", "kind").parquet(path)
    return told.sparkSession.read.schema(f"{TOLD}, role string").parquet(path).drop("role")


def trained(blocks: Blocks, path: str, order: int) -> tuple[Model, DataFrame]:
    """The model, its tables below path, and what its parts told each block."""
    d, parts = blocks.rows, 1 << (blocks.n - 1).bit_length()
    told = tables(answered(d.groupBy("block").applyInArrow(asking(order, parts, False), ASKED), False), f"{path}/grams")
    stats = told.filter(F.col("block") == STATS).select("kind", F.posexplode("stats")).groupBy("kind", "pos").agg(F.sum("col").alias("n")).orderBy("kind", "pos").collect()
    levels = [Level([r.n for r in stats if r.kind == k] or [0] * (CUTOFF + 3)) for k in range(1, order + 1)]
    told = told.filter("block >= 0")

    def gather(k: int):
        def gathered(key, left, right):
            if not len(left):
                return ASKED_ARROW.empty_table()
            b = loaded(left, order)
            p, seen = evaluated(b, right, levels, k - 1)
            first, _, counts, speaks = seen[k - 1]
            ctx, at = np.unique(b.contexts[k - 2], return_inverse=True)
            mine = np.flatnonzero(speaks)
            of, n = at[first[mine]], counts[mine]
            add = [np.bincount(of, weights=w, minlength=len(ctx)) for w in (n, levels[k - 1].mass(n), p[first[mine]])]
            return arrow(ask(CONTEXT + k, key[0].as_py(), parts, ctx, add[0], add[1:]), ASKED_ARROW)

        return gathered

    for k in range(2, order + 1):
        asked = d.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(gather(k), ASKED)
        told = told.unionByName(tables(answered(asked, True), f"{path}/contexts{k}").filter("block >= 0"))
    return Model(path, levels, parts), told


def looked_up(asked: DataFrame, model: Model) -> DataFrame:
    """What the model's tables say to each block: counts of n-grams; counts, backoff weights and scales of contexts; 0, 1 and 1 for unknown ones."""
    spark, order = asked.sparkSession, len(model.levels)
    read = lambda name: spark.read.schema(f"{TOLD}, role string").parquet(f"{model.path}/{name}").filter("role = 'model'").select("kind", "part", "keys", "counts", "sums")
    tables = reduce(DataFrame.unionByName, [read("grams"), *[read(f"contexts{k}") for k in range(2, order + 1)]])

    def answer(key, left, right):
        kind, part = key[0].as_py(), key[1].as_py()
        keys, total = (keys_of(right["keys"][0].as_py()), unsqueezed(right["counts"][0].as_py(), np.int64)) if len(right) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, total = np.append(keys, np.uint64(2**64 - 1)), np.append(total, 0)  # an end that nothing need find
        both = None
        if kind > CONTEXT:
            both = np.ones((len(keys), 2))
            if len(right):
                both[:-1] = unsqueezed(right["sums"][0].as_py(), np.dtype((np.void, 16))).view(np.float64).reshape(-1, 2)
        out = []
        for block, b in zip(left["block"].to_pylist(), left["keys"].to_pylist(), strict=True):
            mine = keys_of(b)
            at = np.searchsorted(keys, mine)
            hit = keys[at] == mine
            sums = squeezed(np.where(hit[:, None], both[at], 1.0)) if both is not None else squeezed(np.zeros(len(mine), np.uint8))
            out.append((block, kind, part, None, squeezed(np.where(hit, total[at], 0)), sums, None))
        return arrow(out, TOLD_ARROW)

    return asked.groupBy("kind", "part").cogroup(tables.groupBy("kind", "part")).applyInArrow(answer, TOLD)


def summed(blocks: Blocks, told: DataFrame, levels: list[Level]) -> DataFrame:
    """Each document's scores from what its block was told."""
    order, kind = len(levels), blocks.kind

    def score(key, left, right):
        ids = {"doc_id": listed(left, "doc_ids"), "train": listed(left, "trains")}
        if not len(left):
            return pa.table(ids | {"n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        b = loaded(left, order)
        p, seen = evaluated(b, right, levels, order)
        _, at, counts, _ = seen[0]
        c, n = counts[at], b.n_docs
        base = np.log10((c + 0.5) / (levels[0].tokens + 0.5 * (levels[0].types + 1)))
        out = ids | {"n_tokens": pa.array(np.bincount(b.doc, minlength=n)), "n_known": pa.array(np.bincount(b.doc, weights=c > 0, minlength=n).astype(np.int64))}
        return pa.table(out | {"base_score": pa.array(np.bincount(b.doc, weights=base, minlength=n)), "score": pa.array(np.bincount(b.doc, weights=np.log10(p), minlength=n))})

    out = blocks.rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(levels[0].tokens).cast("long").alias("train_tokens"), "base_score", "score")


def train(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_bytes: int = 10 << 20, task_bytes: int = 32 << 20) -> Model:
    """A model of all documents, its tables below path. Cases as in scored()."""
    blocks = Blocks(prepared(docs, F.lit(True), id_col, text_col), f"{scratch(docs.sparkSession)}/blocks", block_bytes, task_bytes)
    model, _ = trained(blocks, path, order)
    blocks.drop()
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 10 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of documents that the model need not have seen. Cases as in scored()."""
    path = scratch(docs.sparkSession)
    blocks = Blocks(prepared(docs, F.lit(False), id_col, text_col), f"{path}/blocks", block_bytes, task_bytes)
    asked = blocks.rows.groupBy("block").applyInArrow(asking(len(model.levels), model.parts, True), ASKED)
    got = stored(summed(blocks, looked_up(asked, model), model.levels).drop("train"), f"{path}/scores")
    blocks.drop()
    return got


def scored(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_bytes: int = 10 << 20, task_bytes: int = 32 << 20, path: str | None = None) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Learns from the rows where `train` holds (null does not) and scores all; the model's tables stay below path where one is given. Tokens are blank-separated words, A-Z
    lower-cased, and one end per document; null and empty texts are that end alone. Words unknown in training share one class with the
    discounted mass of single words. score is the sum of log10 probabilities under the Katz model, base_score that of add-half
    single words. Without training rows every word is of the unknown class, of probability 1. Repeated rows count and are scored each. An empty table gives an empty one.
    Other columns are not read. The documents go through the shuffle once, into blocks; the scores are stored below the shared folder.
    """
    where = scratch(docs.sparkSession)
    blocks = Blocks(prepared(docs, train, id_col, text_col), f"{where}/blocks", block_bytes, task_bytes)
    model, told = trained(blocks, path or f"{where}/model", order)
    got = stored(summed(blocks, told, model.levels), f"{where}/scores")
    blocks.drop()
    return got
