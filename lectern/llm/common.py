"""What the corpus operators share: tables, scratch space and vectorised string hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for the bytes 0x20 and 0x09 to 0x0D; UTF-8 has them nowhere else.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: One word of whitespace-separated text, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir; it goes when the driver's JVM ends.

    Where that is unset, a temporary folder if driver and executors are one process, else an error: files in a machine's own folder would be missed by others.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = _local()
    path = f"{top.rstrip('/')}/lectern-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


@lru_cache
def _local() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lectern-')}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it again: lineage ends at files that outlive executors, and what made them runs once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_keys(rows: DataFrame, keys: list[str], size: Column, most: int, path: str) -> list:
    """The least keys of each range, in order: the rows, sorted by their keys (nulls first), are cut where the sizes so far pass a multiple of `most`.

    Exact, whatever the keys are: rows (keys, size) are dealt by sampled splitters and stored below path, and summed up in each part, on top of the parts
    before. A range holds `most` and one row at most; keys that more rows share begin several ranges. One row for each range comes to the driver.
    """
    r = rows.select(*keys, size.cast("long").alias("n")).repartitionByRange(*keys).withColumn("pid", F.spark_partition_id())
    r = stored(r, path)
    sums = r.groupBy("pid").agg(F.sum("n").alias("of"))
    base = sums.select(F.col("pid").alias("p"), (F.sum("of").over(Window.orderBy("pid")) - F.col("of")).alias("base"))  # one row a task
    upto = F.sum("n").over(Window.partitionBy("pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    at = r.withColumn("upto", upto).join(F.broadcast(base), F.col("pid") == F.col("p"))
    nth = F.floor((F.col("base") + F.col("upto") - F.col("n")) / F.lit(most))
    return at.groupBy(nth.alias("nth")).agg(F.min(F.struct(*keys)).alias("k")).orderBy("nth").select("k.*").collect()


def parts(batches, most: int = 2 << 20):
    """The Arrow batches in slices of about `most` bytes, so that what is made of one is small too."""
    for b in batches:
        rows = max(1, most * b.num_rows // max(b.nbytes, 1))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    released()


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """From now on the session's Arrow batches have about `most` bytes, unless they are smaller already. Of 10000 rows, Spark's own bound, they have tens of MB, and the native memory of executors grows with them and stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        spark.conf.set(key, str(most))


def released() -> None:
    """Gives freed memory back, as a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


class Hasher:
    """64-bit hashes of substrings: S[i] sums table[byte] * base**i modulo 2**64, so any [a, b) hashes to (S[b] - S[a]) / base**a."""

    def __init__(self, seed: int):
        self.seed = seed
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**64, 256, dtype=np.uint64)
        self.base = np.uint64(int(rng.integers(1, 2**60)) * 8 + 5)
        self.back = np.uint64(pow(int(self.base), -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        return Hasher, (self.seed,)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, by in (("up", self.base), ("down", self.back)):
                p = np.full(size, by, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def between(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((sums[b] - sums[a]) * self.down[a])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not blank."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], BLANK[data], [True]))))
    return edge[::2], edge[1::2]


def packed(texts: list[bytes], most: int = 1 << 20):
    """Groups texts into buffers of about `most` bytes, a blank after each: yields (first index, lower-cased bytes, offsets)."""
    first, size = 0, 0
    for i, t in enumerate([*texts, None]):
        if t is None or size and size + len(t) > most:
            if i > first:
                data = np.frombuffer(b" ".join(texts[first:i]) + b" ", dtype=np.uint8)
                lens = np.fromiter((len(x) + 1 for x in texts[first:i]), dtype=np.int64, count=i - first)
                yield first, LOWER[data], np.concatenate(([0], np.cumsum(lens)))
            first, size = i, 0
        size += len(t or b"") + 1
