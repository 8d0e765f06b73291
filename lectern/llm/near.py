"""MinHash near-duplicates, candidates checked by odd sketches, links confirmed on whole shingle sets."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Hasher, as_bytes, mixed, packed, parts, scratch, stored, word_spans

#: Bands of rows each: a pair at Jaccard 0.8 shares no band with probability 2e-5, at 0.85 with 4e-8.
BANDS, ROWS = 36, 6
#: Bits of the odd sketch of the MinHash samples, and of that of the whole set, in longs.
LONGS, WHOLE = 8, 16
#: Standard deviations by which the sketch may miss before a pair is given up.
SLACK = 5.5
#: Members of a bucket, outside its main component, that meet the others in one task.
SALT = 256
FEATURES = "doc_id long, tkey long, n_shingles long, node long, " + ", ".join(f"s{i} long" for i in range(LONGS + WHOLE)) + ", bands array<long>"

_hash = Hasher(3)
_rng = np.random.default_rng(36)
_mul = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], k: int):
    """For each text its sorted distinct 64-bit shingle hashes: k words each, or all the words of a text with fewer."""
    for first, data, offsets in packed(texts):
        sums = _hash.sums(data)
        a, b = word_spans(data)
        w = _hash.between(sums, a, b)
        cut = np.searchsorted(a, offsets)
        run = reduce(lambda x, i: mixed(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[i:]), range(1, k), w.copy()) if len(w) >= k else None
        for i in range(len(offsets) - 1):
            lo, hi = int(cut[i]), int(cut[i + 1])
            if hi - lo >= k:
                yield first + i, np.unique(run[lo : hi - k + 1])
            elif hi > lo:
                yield first + i, reduce(lambda x, j: mixed(x * np.uint64(0x9E3779B97F4A7C15) + w[j : j + 1]), range(lo + 1, hi), w[lo : lo + 1] + np.uint64(hi - lo))
            else:
                yield first + i, np.empty(0, dtype=np.uint64)


def minhashes(s: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 256):
        np.minimum(out, (s[i : i + 256, None] * _mul + _add).min(axis=0), out=out)
    return out


def fingerprint(s: np.ndarray) -> int:
    """The node of a set: equal sets are one node."""
    total = np.sum(mixed(s) * np.arange(1, 2 * len(s), 2, dtype=np.uint64), dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def parity(x: np.ndarray, longs: int) -> list[int]:
    odd = np.bincount((x % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def features(s: np.ndarray) -> tuple[int, list[int], list[int]]:
    """(node, odd sketches, band keys). The second sketch folds the whole set: sets differ in as many elements at least as their sketches in bits."""
    m = mixed(minhashes(s))
    flips = mixed(m + np.arange(1, len(m) + 1, dtype=np.uint64))
    odd = parity(flips, LONGS) + parity(s >> np.uint64(40), WHOLE)
    by = m.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + by[:, j])
    return fingerprint(s), odd, key.view(np.int64).tolist()


def most_bits(similarity: float) -> int:
    """Sketch bits by which a pair at the similarity differs at most, but for SLACK standard deviations of what is sampled."""
    k, n = BANDS * ROWS, 64 * LONGS
    differ = k * (1 - similarity) + SLACK * math.sqrt(k * similarity * (1 - similarity))
    mean = n / 2 * (1 - (1 - 2 / n) ** (2 * min(differ, k)))
    return math.ceil(mean + 2 * math.sqrt(n) / 4)


def featured(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    schema = T.StructType.fromDDL(FEATURES)
    schema = T.StructType([src.schema["doc_id"], *schema.fields[1:]])

    def run(batches):
        for b in parts(batches):
            sets = [s for _, s in shingle_sets(as_bytes(b.column(2)), k)]
            got = [features(s) if len(s) else (0, [0] * (LONGS + WHOLE), []) for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([g[0] for g in got], pa.int64()),
                *[pa.array([g[1][i] for g in got], pa.int64()) for i in range(LONGS + WHOLE)], pa.array([g[2] for g in got], pa.list_(pa.int64())),
            ], names=schema.names)

    return src.mapInArrow(run, schema)


def whole_sets(text: DataFrame, k: int) -> DataFrame:
    """(node, shingles): each text's whole set as bytes, with its node."""

    def run(batches):
        for b in parts(batches):
            sets = [s for _, s in shingle_sets(as_bytes(b.column(0)), k)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return text.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, shingles binary")


SKETCH = ["n_shingles", *[f"s{i}" for i in range(LONGS + WHOLE)]]


def near_by_sketch(num: int, den: int) -> Column:
    """Whether rows with a_ and b_ sketches may be near: by size, by the samples' sketch and, which never errs against a pair, by the sets' sketch."""
    differ = lambda i, n: reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_s{j}").bitwiseXOR(F.col(f"b_s{j}"))) for j in range(i, i + n)])
    a, b = F.col("a_n_shingles"), F.col("b_n_shingles")
    sizes = F.least(a, b) * den >= F.greatest(a, b) * num
    return sizes & (differ(0, LONGS) <= most_bits(num / den)) & (differ(LONGS, WHOLE) * (den + num) <= (a + b) * (den - num))


def named(sketches: DataFrame, x: str) -> DataFrame:
    return sketches.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in SKETCH])


def confirmed(pairs: DataFrame, nodes: DataFrame, text: DataFrame, k: int, num: int, den: int, path: str) -> DataFrame:
    """Of the (a, b), those with den * intersection >= num * union on whole sets, which are made of the texts (rep, text) again."""
    pairs = stored(pairs, f"{path}/near")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("rep").alias("r")), "node"), f"{path}/wanted")
    # One document of each node; where an id stands on several texts, those of other nodes drop out. The list grows with the input, so the join is the same at any size.
    mine = text.join(wanted.select("r").distinct().hint("merge"), F.col("rep").eqNullSafe(F.col("r")), "left_semi")
    sets = whole_sets(mine, k).join(wanted.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = stored(sets, f"{path}/sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for t in parts(batches):
            keep = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.mapInArrow(run, "a long, b long"), f"{path}/links")


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, comp), comp the least node reachable, for nodes with edges: least labels of neighbours, then of labels, until none changes."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"{path}/0")
    for i in range(1, 100):
        next_ = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("low"))
        merged = labels.join(next_, labels["node"] == next_["a"]).select("node", F.least("comp", "low").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("j"), F.col("comp").alias("jc"))
        merged = merged.join(jump, merged["comp"] == jump["j"]).select("node", F.least("comp", "jc").alias("comp"), "was")
        merged = stored(merged, f"{path}/{i}")
        labels = merged.select("node", "comp")
        if merged.filter("comp <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def grouped(docs: DataFrame, id_col: str, text_col: str, k: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, tkey, n_shingles, group): the rows of linked documents have one group, null for empty sets; tkey is the text's hash.

    Equal sets become one node first. MinHash bands propose pairs; links to one member of each bucket, another in each band, come first, so
    that large groups join up without pairs of all members. What remains are buckets whose members are in several components: there
    each member outside the bucket's largest component meets every member of another one. Each pair is first judged by odd sketches, then
    by whole sets. No pair that shares a band is left undecided unless its members are already joined.
    """
    path = scratch(docs.sparkSession)
    num, den = similarity
    feats = stored(featured(docs, id_col, text_col, k), f"{path}/features")
    sets_ = feats.filter("n_shingles > 0")
    nodes = sets_.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first(F.struct("n_shingles", "bands", *[f"s{i}" for i in range(LONGS + WHOLE)])).alias("f")).select("node", "rep", "f.*")
    nodes = stored(nodes, f"{path}/nodes")
    member = nodes.select("node", F.explode("bands").alias("band"))
    lead = member.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", "band").alias("h"), F.col("node").alias("lead"))).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "l.lead", "n")
    member = stored(member.join(lead, "band"), f"{path}/members")
    wanted = member.select("node").distinct()
    nodes = stored(nodes.join(wanted, "node", "left_semi").select("node", "rep", *SKETCH), f"{path}/sketches")
    text = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))

    stars = member.filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    near = stars.join(named(nodes, "a"), "a").join(named(nodes, "b"), "b").filter(near_by_sketch(num, den)).select("a", "b")
    links = confirmed(near, nodes, text, k, num, den, f"{path}/1")
    comps = components(links, f"{path}/1/comps")
    more = member.filter("n > 2").join(comps, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = more.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("comp", "n").alias("main"), F.count(F.lit(1)).alias("parts"), F.ceil((F.sum("n") - F.max("n")) / SALT).cast("int").alias("salts")).filter("parts > 1")
    more = stored(more.join(sizes.drop("parts"), "band").join(nodes.drop("rep"), "node"), f"{path}/rest")
    # Those outside the main component are dealt over salts, of which each has a copy of all members: however many share a band, a task meets SALT of them with the others.
    out = more.filter("comp <> main").select("band", F.pmod(F.xxhash64("node"), "salts").alias("salt"), F.col("comp").alias("a_comp"), F.col("node").alias("x"), *[F.col(c).alias(f"a_{c}") for c in SKETCH])
    rest = more.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(F.col("band").alias("b_band"), "b_salt", F.col("comp").alias("b_comp"), F.col("node").alias("y"), *[F.col(c).alias(f"b_{c}") for c in SKETCH])
    pairs = out.join(rest, (F.col("band") == F.col("b_band")) & (F.col("salt") == F.col("b_salt")) & (F.col("a_comp") != F.col("b_comp")) & near_by_sketch(num, den))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = links.unionByName(confirmed(pairs, nodes, text, k, num, den, f"{path}/2"))
    comps = components(links, f"{path}/2/comps")
    every = feats.select("doc_id", "tkey", "n_shingles", "node").join(comps, "node", "left")
    return every.select("doc_id", "tkey", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")).alias("group"))


def linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document.

    Sets of distinct k-word shingles (a shorter text is one shingle); documents whose Jaccard similarity is at least
    similarity[0] / similarity[1] are linked, component_id is the least doc_id linked to directly or not. Null and blank texts are
    empty sets, linked with nothing. Null ids take part but are never the least; repeated rows are copies, and of ties each row with the least id
    is kept. An empty table gives an empty one. Other columns are not read.
    """
    every = grouped(docs, id_col, text_col, k, similarity)
    least = every.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    every = every.join(least, "group", "left")
    every = every.withColumn("component_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return every.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents, all columns as they are, one row of each group: that with the least id, null ids last. Documents with empty sets all stay. Other cases as in linked()."""
    every = grouped(docs, id_col, text_col, k, similarity)
    key = F.xxhash64("doc_id", "tkey")
    kept = every.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey")).alias("r")).select("r.*")
    kept = kept.select(key.alias("_key"), F.lit(False).alias("_empty")).unionByName(every.filter("group is null").select(key.alias("_key"), F.lit(True).alias("_empty")).distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumn("_key", F.xxhash64(f"row.{id_col}", F.xxhash64(F.col(f"row.{text_col}").cast("string"))))
    # The join leaves rows dealt by the key, so the window needs no shuffle.
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return row.join(kept, "_key").withColumn("nth", nth).filter("nth = 1 or _empty").select("row.*")
