"""WARC: a deterministic sharded writer, and its reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut_keys, scratch

#: The same for every run, so that equal input gives equal archives.
DATE = "2020-01-01T00:00:00Z"
#: Bytes that a reader inflates at a time.
CHUNK = 1 << 14
#: Bytes that a record counts besides its payload.
HEAD = 512
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("file", T.StringType()),
])
ROLLED = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("seq", pa.int32()), ("value", pa.binary())])


def record_id(page_id, sha1: str, again: str = "") -> str:
    """Decided by id and payload; `again` tells rows apart that are equal in both."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}{again}')}>"


def zipped(head: list[str], block: bytes) -> bytes:
    """One record as a gzip member of its own whose last byte is 0, which is what Spark's text writer puts behind each value."""
    out = gzip.compress("\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)
    # A member ends with its length's high byte, 0 below 16 MB; an empty member after a longer one ends so too.
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)


def warcinfo(name: str) -> bytes:
    block = b"software: lectern\r\nformat: WARC File Format 1.1\r\n"
    return zipped(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}')}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def member(page_id, url: str | None, payload: bytes, refers_to, again: str = "") -> bytes:
    sha1 = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    b32 = lambda d: "sha1:" + base64.b32encode(d).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha1.hexdigest(), again)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or f'urn:page:{page_id}').split())}", f"WARC-Payload-Digest: {b32(sha1.digest())}", f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, sha1.hexdigest())}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return zipped([*head, "Content-Type: application/http;msgtype=response"], block)


def file_name(shard: int, file: int) -> str:
    return f"{shard:08d}-{file:05d}.warc.gz"


def order_key(page_id, sha1: bytes) -> bytes:
    """Sorts as bytes like (page_id, nulls first, sha1)."""
    return (b"\0" * 9 if page_id is None else b"\1" + (page_id + (1 << 63)).to_bytes(8, "big")) + sha1


def shards_udf(sent):
    """(first, last) shard of (page_id, sha1) by binary search: one shard but for keys that begin several."""

    @F.pandas_udf("first int, last int")
    def shards(page_id: pd.Series, sha1: pd.Series) -> pd.DataFrame:
        cuts, has = np.array(sent.value, dtype="S29"), page_id.notna().to_numpy()
        key = np.zeros((len(has), 29), dtype=np.uint8)
        key[:, 0] = has
        key[has, 1:9] = (page_id[has].to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
        key[:, 9:] = np.frombuffer(b"".join(sha1), dtype=np.uint8).reshape(-1, 20)
        key = key.view("S29").ravel()
        last = np.searchsorted(cuts, key, "right") - 1
        return pd.DataFrame({"first": np.minimum(np.searchsorted(cuts, key, "left"), last).astype(np.int32), "last": last.astype(np.int32)})

    return shards


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_bytes: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20) -> None:
    """Writes one record per page to path/archives/SHARD-FILE.warc.gz, then path/manifest.

    Records sort by id, null ids first, then by payload digest and URL. Where the bytes of the sorted records pass a multiple of
    shard_bytes a shard begins, so a shard holds that much and one record at most, however ids lie; each shard's file rolls when the next
    member would take it beyond roll_bytes of gzip. Of equal payloads of dedup_bytes or more, the one with the greatest id is the
    response (ties all are), the others revisit it; payloads whose ids are all null are all responses. Null payloads are empty, null
    URLs get a urn; records equal in id and payload have record ids of their own. Spark's committer writes below a temporary folder, which lost
    executors leave whole or not at all; files then get their names, and the manifest comes last: it lists every file, relative to path/archives,
    with its records, bytes and digest, and a folder without one is not complete. An empty table gives no archive and an empty
    manifest. Other columns are not read. Fails where path has archives already.

    The html is shuffled once, by shard. What is equal and where shards begin is found on (id, digest, bytes) alone; the driver and each task
    hold 29 bytes a shard.
    """
    spark = pages.sparkSession
    fs, at = _fs(spark, path)
    if fs.exists(at(f"{path}/archives")) or fs.exists(at(f"{path}/manifest")):
        raise ValueError(f"{path} has archives already")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha1", F.unhex(F.sha1("payload")))
    folder = f"{scratch(spark)}/keys"
    cuts = [order_key(r.page_id, bytes(r.sha1)) for r in cut_keys(p, ["page_id", "sha1"], F.octet_length("payload") + HEAD, shard_bytes, folder)]
    sent = spark.sparkContext.broadcast(cuts)
    among = shards_udf(sent)("page_id", "sha1")
    keys = spark.read.parquet(folder).filter(F.col("n") >= dedup_bytes + HEAD).select("page_id", "sha1")
    best = keys.groupBy("sha1").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("k")).filter("k > 1 and best is not null").drop("k")
    # A repeated digest goes to each shard that holds it; a shard's list is no longer than the shard.
    best = keys.join(best, "sha1").select("sha1", "best", among.alias("s")).select("sha1", "best", F.explode(F.sequence("s.first", "s.last")).alias("in_shard")).distinct()

    def roll(key, left, right):
        digest = dict(zip(right["sha1"].to_pylist(), right["best"].to_pylist(), strict=True))
        shard, out, file, size, last = key[0].as_py(), [], -1, 0, None
        rows = sorted((order_key(p, h), u or "", i) for i, (p, h, u) in enumerate(zip(*(left[c].to_pylist() for c in ("page_id", "sha1", "url")), strict=True)))
        for mine, _, i in rows:
            page_id, url, payload, first = (left[c][i].as_py() for c in ("page_id", "url", "payload", "first"))
            to = digest.get(mine[9:]) if len(payload) >= dedup_bytes else None
            again = "" if mine != last and first == shard else f":{shard}:{len(out)}"
            last = mine
            m = member(page_id, url, payload, None if to == page_id else to, again)
            if file < 0 or size and size + len(m) > roll_bytes:
                file, size = file + 1, 0
                out.append((shard, file, len(out), warcinfo(file_name(shard, file))[:-1]))  # the writer's line separator is the last byte
            size += len(m)
            out.append((shard, file, len(out), m[:-1]))
        return pa.table(dict(zip(ROLLED.names, ([r[i] for r in out] for i in range(4)), strict=True)), schema=ROLLED)

    parts = max(1, len(cuts) // 2)
    # Equal rows that fill several shards are dealt over them by their place in the input.
    nth = F.col("s.first") + F.pmod(F.monotonically_increasing_id(), (F.col("s.last") - F.col("s.first") + 1).cast("long"))
    dealt = p.withColumn("s", among).select("page_id", "url", "payload", "sha1", "s.first", nth.cast("int").alias("shard")).repartition(parts, "shard")
    m = dealt.groupBy("shard").cogroup(best.repartition(parts, "in_shard").groupBy("in_shard")).applyInArrow(roll, "shard int, file int, seq int, value binary")
    m = m.sortWithinPartitions("shard", "file", "seq").select("shard", "file", F.col("value").cast("string").alias("value"))
    m.write.partitionBy("shard", "file").option("lineSep", "\u0000").text(f"{path}/_archives")
    _named(spark, f"{path}/_archives", f"{path}/archives")
    told = _files(spark, path).select("file", "length", F.sha1("content").alias("sha1"))
    told.write.json(f"{path}/manifest")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _named(spark: SparkSession, tmp: str, final: str) -> None:
    """Moves what Spark has committed to its final names."""
    fs, at = _fs(spark, tmp)
    fs.mkdirs(at(final))
    moves = []
    found = fs.listFiles(at(tmp), True)
    while found.hasNext():
        where = found.next().getPath()
        if where.getName().startswith("part-"):
            folders = dict(x.split("=") for x in (where.getParent().getParent().getName(), where.getParent().getName()))
            moves.append((where, at(f"{final}/{file_name(int(folders['shard']), int(folders['file']))}")))

    def move(m):
        if not fs.rename(*m):
            raise OSError(f"cannot move {m[0]}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, moves))
    fs.delete(at(tmp), True)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, content) of the archives."""
    fs, at = _fs(spark, path)
    if not fs.listStatus(at(f"{path}/archives")):
        return spark.createDataFrame([], "file string, length long, content binary")
    found = spark.read.format("binaryFile").load(f"{path}/archives")
    return found.select(F.substring_index("path", "/", -1).alias("file"), "length", "content")


def records(data: bytes):
    """Every record of an archive of gzip members: (headers, block)."""
    at = 0
    while at < len(data):
        z, whole = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            whole.append(z.decompress(data[at : at + CHUNK]))
            at += CHUNK
        at -= len(z.unused_data) + max(0, at - len(data))
        stream = io.BytesIO(b"".join(whole))
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = {}
            while (line := stream.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            yield head, stream.read(int(head["content-length"]))


def parsed(data: bytes, file: str):
    for head, block in records(data):
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, body = block.partition(b"\r\n\r\n")
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != head["warc-block-digest"] or kind == "response" and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"digest mismatch in {file}")
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        page, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
        yield page and int(page), head["warc-target-uri"], body if kind == "response" else None, size, digest, kind, to and int(to), file


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records below path, as write() left them, each digest checked against its bytes; path may have been moved.

    Revisits have no payload; their payload's length and digest are what their headers say. Fails where there is no
    manifest or the archives are not as listed there.
    """
    told = spark.read.schema("file string, length long, sha1 string").json(f"{path}/manifest")
    files = _files(spark, path)
    found = files.select("file", F.sha1("content").alias("found"))
    wrong = told.join(found, "file", "full").filter(~F.col("sha1").eqNullSafe(F.col("found"))).select("file").head(5)
    if wrong:
        raise ValueError(f"not as in the manifest: {', '.join(r.file for r in wrong)}")

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())])
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(parsed(data, file))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("file", "content").mapInArrow(run, RECORD)
