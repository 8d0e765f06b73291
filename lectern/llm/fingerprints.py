"""Document fingerprints by consistent weighted sampling; DataFrame functions alone."""

from __future__ import annotations

import json
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import WORD, cut_keys, scratch

BLANKS = WORD.replace("[^", "[")
#: Samples of a fingerprint.
SAMPLES = 64
#: Samples that one row's aggregation computes.
GROUP = 16


@lru_cache
def quantiles(n: int) -> list[float]:
    """The middles of n equally likely parts of the gamma distribution of shape 2, by bisection."""
    out, lo = [], 0.0
    for i in range(n):
        a, z = lo, 60.0
        for _ in range(60):
            x = (a + z) / 2
            a, z = (x, z) if 1 - math.exp(-x) * (1 + x) < (i + 0.5) / n else (a, x)
        out.append(lo := a)
    return out


def sample(term: Column, log_weight: Column, k: Column) -> Column:
    """The k-th sample of a weighted term as one number below 2**53: the high part orders samples, the low 28 bits name term and level.

    With r and c from the gamma distribution of shape 2 and b uniform, all decided by term and k, the weight falls into level
    t = floor(ln(weight) / r + b) and the sample is a = c / exp(r * (t - b + 1)). The least over all terms has the same
    term and level in two documents as often as their generalised Jaccard similarity. Comparing ln(a) gives the same order.
    r takes 512 equally likely values, c and b have 41 and 14 bits.
    """
    h = F.xxhash64(k, term)
    bits = lambda at, n: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1))
    uniform = lambda at, n: (bits(at, n) + 0.5) * F.lit(2.0**-n)
    r = F.get(F.from_json(F.lit(json.dumps(quantiles(512))), "array<double>"), bits(0, 9).cast("int"))  # one literal
    b = uniform(9, 14)
    log_c = F.log(-F.log(uniform(23, 20) * uniform(43, 21)))
    t = F.rint(log_weight / r + b - 0.5)
    order = F.rint((log_c - r * (t - b + 1) + 100) * F.lit(2.0**18))
    return order * F.lit(2.0**28) + term.bitwiseAND(F.lit((1 << 26) - 1)) + t * 100003


def fingerprints(d: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """From rows of (keys, side 0 or 1, words): one row per key with `mine` and `other`, the least samples' names over the words of
    either side weighted by their counts; keys without any word are left out, a side without words is empty.

    A term that weighs the same on both sides is sampled once for both.
    """
    w = d.select(*keys, "side", F.explode("words").alias("w")).filter("w <> ''").select(*keys, "side", F.xxhash64("w").alias("term"))
    w = w.groupBy(*keys, "term").agg(F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b"))
    one = lambda side, n: F.struct(F.lit(side).alias("side"), F.col(n).alias("n"))
    each = F.when(F.col("a") == F.col("b"), F.array(one(2, "a"))).otherwise(F.array(one(0, "a"), one(1, "b")))
    w = w.select(*keys, "term", F.explode(each).alias("s")).filter("s.n > 0").select(*keys, "term", "s.side", F.log(F.col("s.n").cast("double")).alias("weight"))
    # GROUP samples a row: longer code would not be compiled. No condition around a sample, so that its parts are computed once each.
    w = w.select("*", F.explode(F.array(*[F.lit(j) for j in range(-(-samples // GROUP))])).alias("j"))
    w = w.groupBy(*keys, "side", "j").agg(*[F.min(sample(F.col("term"), F.col("weight"), F.col("j") * GROUP + i)).alias(f"s{i}") for i in range(GROUP)])
    least = lambda other: [F.min(F.when(F.col("side") != other, F.col(f"s{i}"))).alias(f"{'ba'[other]}{i}") for i in range(GROUP)]
    w = w.groupBy(*keys, "j").agg(*least(1), *least(0))
    one = lambda x: F.when(F.col(f"{x}0").isNotNull(), F.array(*[F.col(f"{x}{i}") for i in range(GROUP)])).otherwise(F.array().cast("array<double>"))
    got = w.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("j", one("a").alias("a"), one("b").alias("b")))).alias("g"))  # samples / GROUP entries
    names = lambda x: F.transform(F.slice(F.flatten(F.transform("g", lambda g: g[x])), 1, samples), lambda v: v.cast("long").bitwiseAND(F.lit((1 << 28) - 1)))
    return got.select(*keys, names("a").alias("mine"), names("b").alias("other"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; 1 between texts without words, 0 between one and a text with words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(same / F.greatest(F.size(a), F.size(b)))


def printed(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def searched(cuts: Column, n: int, holds) -> Column:
    """How many of the n sorted cuts hold, from the first on, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(n, 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & holds(F.get(cuts, at + s - 1)), at + s).otherwise(at))


def ranged(d: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """Rows (doc_id, tkey, text) with their range, of about range_bytes of text each, and how many ranges there are.

    The cuts are one literal, 16 bytes a range. Equal rows that fill several ranges are dealt over them by their place in the input.
    """
    key = ["doc_id", "tkey"]
    cuts = cut_keys(d, key, F.octet_length("text") + 64, range_bytes, f"{scratch(d.sparkSession)}/keys")
    kinds = T.ArrayType(T.StructType([T.StructField(c, d.schema[c].dataType) for c in key]))
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in cuts], default=str)), kinds)
    mine = F.struct(*key)
    first, last = searched(listed, len(cuts), lambda c: c < mine), searched(listed, len(cuts), lambda c: c <= mine) - 1
    d = d.withColumn("first", first).withColumn("last", F.greatest(last, F.lit(0)))
    nth = F.when(F.col("last") > F.col("first"), F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("last") - F.col("first") + 1)).otherwise(F.col("last"))
    return d.withColumn("range", nth.cast("int")).drop("first", "last"), max(len(cuts), 1)


def with_next(docs: DataFrame, id_col: str, text_col: str, range_bytes: int) -> DataFrame:
    """(range, nth, ghost, doc_id, text, next): documents by ascending id (null first, then by text), each with the text of the next one, the last with the first's.

    Documents are dealt by ranges in that order; each range also gets a ghost of the document that follows it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d, n = ranged(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tkey")), range_bytes)
    first = d.groupBy("range").agg(F.min(F.struct("doc_id", "tkey")).alias("f"))
    everywhere = Window.orderBy("range")  # a row for each range
    before = F.coalesce(F.lag("range").over(everywhere), F.max("range").over(Window.partitionBy()))
    first = first.select("range", F.col("f.doc_id").alias("fid"), F.col("f.tkey").alias("fkey"), before.alias("before"))
    d = d.join(F.broadcast(first), "range")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("before").alias("range"), F.lit(True).alias("ghost"))
    leads = F.col("doc_id").eqNullSafe(F.col("fid")) & (F.col("tkey") == F.col("fkey"))
    d = d.select("doc_id", "text", "tkey", F.explode(F.when(leads, F.array(own, ghost)).otherwise(F.array(own))).alias("at"))
    # As many partitions as ranges, so that none holds more words than fit in memory; all that follows stays in them.
    # The filter is what the join in compared() would ask of one of its sides: with it both read the same exchange.
    d = d.select("at.*", "doc_id", "text", "tkey").filter("range is not null").repartition(n, "range")
    w = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "tkey")
    d = d.select("range", F.row_number().over(w).alias("nth"), "ghost", "doc_id", "text", F.lead("text").over(w).alias("next"), F.lag("ghost").over(w).alias("more"))
    return d.filter("not ghost or not coalesce(more, false)").drop("more")  # rows equal to the one that leads make ghosts too


def compared(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, range_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per document.

    Terms are blank-separated words, lower-cased, weighted by their counts. The edited text has its last quarter (rounded down)
    replaced by as many first characters of the next document as there are. Null texts are empty; their fingerprint is empty and like
    that of other texts without words. Equal texts have equal fingerprints; repeated rows follow each other. A single document
    follows itself. An empty table gives an empty one. Other columns are not read. The texts are shuffled once.
    """
    d = with_next(docs, id_col, text_col, range_bytes)
    d = d.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    part = lambda c, n: F.substring(F.col(c), F.lit(1), n)
    d = d.withColumn("edited", F.when(~F.col("ghost"), F.concat(part("text", (F.col("n_chars") - F.col("cut")).cast("int")), part("next", F.col("cut")))))
    words = lambda c: F.split(F.lower(c), BLANKS)
    sides = F.array(F.struct(F.lit(0).alias("side"), words("text").alias("words")), F.struct(F.lit(1).alias("side"), words("edited").alias("words")))
    w = d.select("range", "nth", "ghost", F.explode(sides).alias("s")).filter("not ghost or s.side = 0").select("range", "nth", "s.*")
    # Both sides are dealt by range already, so the join needs no shuffle.
    s = d.select("range", "nth", "ghost", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    s = s.join(fingerprints(w, ["range", "nth"], samples).hint("merge"), ["range", "nth"], "left")
    none = F.array().cast("array<long>")
    s = s.withColumns({"mine": F.coalesce("mine", none), "other": F.coalesce("other", none)})
    s = s.withColumn("follower", F.lead("mine").over(Window.partitionBy("range").orderBy("nth"))).filter("not ghost")
    return s.select("doc_id", "n_chars", "edited_sha256", printed(F.col("mine")).alias("fingerprint"), printed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("mine"), F.col("other")).alias("near_edited"), likeness(F.col("mine"), F.col("follower")).alias("near_next"))
