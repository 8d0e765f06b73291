"""Sharding by a two-pass external shuffle, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is greatest, so that one more shard takes keys only into itself."""
    each = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)])
    return F.array_max(each)["i"]


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)


def row_hash(rows: DataFrame, columns: list[str], seed: int) -> Column:
    """A hash of all columns; maps, which have no hash, count as JSON."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(f"`{c}`")) if has_map(kinds[c]) else F.col(f"`{c}`") for c in columns])


def bytes_of(rows: DataFrame, columns: list[str]) -> Column:
    """Bytes of the strings and binaries of a row."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    wide = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in columns if isinstance(kinds[c], (T.StringType, T.BinaryType))]
    return sum(wide, F.lit(0))


def salts(spark: SparkSession, parts: int) -> list[int]:
    """An integer for each of so many partitions, which repartition() by an int column deals to it."""
    ids = spark.range(32 * parts).select(F.col("id").cast("int").alias("id"))
    found = {r.p: r.id for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect()}
    return [found.get(p, p) for p in range(parts)]


def shuffled(rows: DataFrame, *, key: str = "doc_id", size: Column | None = None, shards: int = 8, seed: int = 17, bucket_bytes: int = 16 << 20, row_bytes: int = 32, task_bytes: int = 64 << 20) -> DataFrame:
    """The rows with shard, slot and grown_shard (the shard if there were one more), each shard's rows in the order of their slots.

    First pass: seeded hashes of whole rows scatter each shard over buckets that fit in memory; a shard has as many as its own sum of sizes asks for (the
    `size` of a row, or else the bytes of its strings, null counting 0, and row_bytes). Second pass: each bucket, its rows in a fixed order first,
    gets a seeded Fisher-Yates shuffle, and slots run on from bucket to bucket without gaps. Rows move once, some task_bytes to a task.

    The key and the number of shards decide the shard; null keys go together. Rows that share a key, null or not, spread over the shard's buckets; only rows equal
    in all columns stay in one and are interchangeable. An empty table gives an empty one. A hot source or group of
    copies does not matter. Columns may be of any type; those named shard, slot or grown_shard are replaced, no other name clashes.
    """
    keep = [c for c in rows.columns if c not in ("shard", "slot", "grown_shard")]
    size = F.coalesce(size, F.lit(0)) if size is not None else bytes_of(rows, keep)
    k = F.col(f"`{key}`")
    d = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), (size + row_bytes).cast("long").alias("n"), row_hash(rows, keep, seed + 1).alias("h"),
        shard_of(k, shards, seed).alias("shard"), shard_of(k, shards + 1, seed).alias("grown_shard"),
    )
    sums = {r.shard: r.n for r in d.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    buckets = [max(1, -(-sums.get(i, 0) // bucket_bytes)) for i in range(shards)]
    of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    d = d.withColumn("bucket", F.pmod("h", of(buckets, F.col("shard"))))
    counts = d.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # a row for each bucket
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    parts = max(1, -(-sum(sums.values()) // task_bytes))
    # Dealt by bucket already, so that collecting a bucket needs no second exchange; as many buckets to each task, where a hash of them gives some tasks twice as many.
    nth = of([sum(buckets[:i]) for i in range(shards)], F.col("shard")) + F.col("bucket")
    d = d.withColumn("deal", of(salts(rows.sparkSession, parts), F.floor(nth * parts / sum(buckets))))
    whole = d.repartition(parts, "deal").groupBy("deal", "shard", "bucket").agg(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 2), "h").alias("h"), "row", "grown_shard")).alias("rows"))
    fixed = F.array_sort("rows", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))  # rows of any type, by hash alone
    # The shuffle expression draws from one stream per partition, so partitions and the order in them are fixed.
    whole = whole.select("shard", "bucket", fixed.alias("rows")).sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle("rows", seed).alias("rows"))
    out = whole.join(F.broadcast(counts), (whole["shard"] == counts["s"]) & (whole["bucket"] == counts["b"]))
    out = out.select("shard", "before", F.posexplode("rows").alias("at", "r"))
    return out.select("r.row.*", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), "r.grown_shard")


def write(rows: DataFrame, path: str, **how) -> DataFrame:
    """Writes the shuffled rows as Parquet, a folder for each shard, and reads them back; arguments and cases as in shuffled().

    A task writes its buckets one after another, rows by slot. Spark's committer names files when a job ends, so lost executors leave none half written. Fails
    where path exists.
    """
    out = shuffled(rows, **how)
    out.write.partitionBy("shard").parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path).select(*out.columns)
