"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD

#: Rows of a source that one task ranks, about.
STRATUM = 20_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, rows, source_size, target) from (source, rows, source_size).

    Targets are least(most * source_size, level * weight), with the level at which they sum to `share` of all sizes:
    what handing the excess on by weight comes to. Sources rank by most * size / weight, so a running sum of the caps
    before and of the weights from each one gives its level; the right one is the greatest that the cap there does
    not cut. One row per source, so the windows over the whole table are small.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    t = t.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "k")
    t = t.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("from", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    t = t.withColumn("level", (total - F.col("before")) / F.col("from"))
    t = t.withColumn("found", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(Window.partitionBy()))
    target = F.least(F.col("most"), F.coalesce(F.col("found"), F.lit(float("inf"))) * F.col("weight"))
    return t.select("source", "rows", "source_size", target.alias("target"))


def copies(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, n_copies, *carry): how often the mix takes each document.

    A source's rate is target / source_size. Its documents, in strata of bounded size and by size within a stratum, each
    expect that many copies; the prefix sums of these, moved by one random offset of the source, cross as many integers
    as the mix takes copies. Sorting by size keeps the taken words near the target, and no document is taken more than
    ceil(rate) times. Null sources are one source, the last. Null texts have size 0. Empty sources (size 0) have target 0
    and are not taken. Repeated rows are sampled each by itself; equal rows are interchangeable, so reruns agree. A hot
    source is spread over as many strata as it needs; only the carried columns, ids and sizes are shuffled.
    """
    size = size if size is not None else F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *carry)
    targets = source_targets(d.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")), weights, share, most)
    name = F.coalesce(F.col("source"), F.lit("\u0000"))
    targets = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        F.ceil(F.col("rows") / F.lit(STRATUM)).alias("strata"), unit(F.lit(seed), name).alias("offset"),
    )
    d = d.join(targets, d["source"].eqNullSafe(targets["s"])).drop("s")
    d = d.withColumn("stratum", F.floor(unit(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) * F.col("strata")))
    counts = d.groupBy(F.col("source").alias("s"), F.col("stratum").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("s", "t", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    w = Window.partitionBy("source", "stratum").orderBy("size", F.md5(F.col("doc_id").cast("string")), "doc_id")
    d = d.withColumn("rank", F.row_number().over(w))
    d = d.join(counts, d["source"].eqNullSafe(counts["s"]) & (d["stratum"] == counts["t"]))
    at = F.col("before") + F.col("rank")
    n = F.floor(F.col("offset") + F.col("rate") * at) - F.floor(F.col("offset") + F.col("rate") * (at - 1))
    return d.select("doc_id", "source", "size", "source_size", "target", n.alias("n_copies"), *carry)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents, all columns as they are, each as often as the mix takes it."""
    d = copies(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), id_col="row.doc_id", source_col="row.source", text_col="row.text", carry=["row"], **how)
    return d.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n_copies").cast("int")))).select("row.*")
