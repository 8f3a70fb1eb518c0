"""Write-ahead log: codec, Spark data source, sink, recovery.

A record is ``length, op, key length, key, value length, value, expiry, checksum``,
little-endian; the length counts all after itself.  Reading stops silently at the
first bad record of a file, so what was appended behind one is never seen.

A log is a folder of files.  They are read through Spark's own binary reader, one task a
file, and written through its text writer, so any store that Spark reaches will do.  The
text writer ends each row with a separator; rows are cut where the stream of frames holds
that very byte, so only the one at the end of a file is added, which readers take for a
torn record.  Each write is a folder of its own, numbered, and its files are in order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import MAX_KEY_BYTES, CacheConfig
from tracemill.functions.fold import sorted_fold
from tracemill.functions.rank import global_position
from tracemill.operators.cache import CacheShard
from tracemill.operators.ring import shard_of

SET, DELETE = 1, 2
#: What an absent expiry may be written as: the zero time wraps to this.
ZERO_TIME_NS = -6795364578871345152

SCHEMA = "path string, seq long, op tinyint, key string, value binary, expires_ns long"


class Record(NamedTuple):
    op: int
    key: str
    value: bytes = b""
    expires_ns: int | None = None


def encode(r: Record) -> bytes:
    key = r.key.encode()
    if len(key) > MAX_KEY_BYTES:
        raise ValueError(f"key of {len(key)} bytes; a record holds {MAX_KEY_BYTES}")
    value = r.value or b""
    expires = ZERO_TIME_NS if r.expires_ns is None else r.expires_ns
    payload = struct.pack("<BH", r.op, len(key)) + key + struct.pack("<I", len(value)) + value + struct.pack("<q", expires)
    return struct.pack("<I", len(payload) + 4) + payload + struct.pack("<I", zlib.crc32(payload))


def _decode(payload: bytes) -> Record | None:
    if len(payload) < 3:
        return None
    op, n = struct.unpack_from("<BH", payload)
    if len(payload) < 3 + n + 4:
        return None
    key = payload[3 : 3 + n]
    (m,) = struct.unpack_from("<I", payload, 3 + n)
    at = 3 + n + 4
    if len(payload) < at + m + 8:
        return None
    (expires,) = struct.unpack_from("<q", payload, at + m)
    return Record(op, key.decode(errors="replace"), payload[at : at + m], expires if expires > 0 else None)


def decode(data: bytes) -> Iterator[Record]:
    """Records up to the first that is torn or fails its checksum."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        body = data[at + 4 : at + 4 + n]
        if n < 4 or len(body) < n:
            return
        payload, (crc,) = body[:-4], struct.unpack("<I", body[-4:])
        record = _decode(payload) if zlib.crc32(payload) == crc else None
        if record is None:
            return
        yield record
        at += 4 + n


def _batches(files: Iterator[tuple[str, bytes]], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("op", pa.int8()), ("key", pa.string()), ("value", pa.binary()), ("expires_ns", pa.int64())])
    for path, data in files:
        rows = []
        for seq, r in enumerate(decode(data)):
            rows.append((path, seq, r.op, r.key, r.value, r.expires_ns))
            if len(rows) == size:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``path, seq, op, key, value, expires_ns`` of the log files at ``path`` (a file, or a
    folder with all that is in it)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decode_files(files.select("path", "content"))


def decode_files(files: DataFrame) -> DataFrame:
    """Records of files given as ``path, content``."""

    def run(batches):
        for batch in batches:
            yield from _batches((p.as_py(), c.as_py()) for p, c in zip(batch.column("path"), batch.column("content"), strict=True))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def encode_rows(records: DataFrame, order: str = "seq") -> DataFrame:
    """``seq, frame binary, outcome`` of rows ``seq, op, key, value, expires_ns``, in
    expressions.  A key too long for a record gives no frame and the outcome ``invalid_key``."""
    # each value is named once: its text would be repeated in the compiled code otherwise
    le = lambda col, n: F.unhex(F.regexp_replace(F.reverse(F.lpad(F.hex(col), 2 * n, "0")), "(.)(.)", "$2$1"))
    key = F.col("key").cast("binary")
    value = F.coalesce(F.col("value"), F.unhex(F.lit("")))
    expires = F.coalesce(F.col("expires_ns"), F.lit(ZERO_TIME_NS)).cast("long")
    ok = F.octet_length(key) <= MAX_KEY_BYTES
    payload = F.concat(le(F.col("op").cast("long"), 1), le(F.octet_length(key).cast("long"), 2), key, le(F.octet_length(value).cast("long"), 4), value, le(expires, 8))
    out = records.select(order, F.when(ok, payload).alias("_p"))
    frame = F.concat(le((F.octet_length("_p") + 4).cast("long"), 4), F.col("_p"), le(F.crc32("_p"), 4))
    return out.select(order, frame.alias("frame"), F.when(F.col("_p").isNull(), "invalid_key").otherwise("logged").alias("outcome"))


def good_prefix(records: DataFrame, bad: str = "bad") -> DataFrame:
    """Rows of each ``path`` before its first bad one, where decoding marked them."""
    first = records.filter(F.col(bad)).groupBy("path").agg(F.min("seq").alias("_first"))
    return records.join(first, "path", "left").filter(F.col("_first").isNull() | (F.col("seq") < F.col("_first"))).drop("_first")


def recover(records: DataFrame, as_of_ns: int) -> DataFrame:
    """State after a restart at ``as_of_ns``, without eviction: ``key, value, expires_ns``.

    Expired SETs are skipped before the last record of a key wins, so an expired
    overwrite brings the older value back."""
    alive = records.filter((F.col("op") == DELETE) | F.col("expires_ns").isNull() | (F.col("expires_ns") >= as_of_ns))
    last = alive.groupBy("key").agg(F.max(F.struct("seq", "op", "value", "expires_ns")).alias("l"))
    return last.filter(F.col("l.op") == SET).select("key", "l.value", "l.expires_ns")


class _Replayer:
    """Replay into a bounded shard: a repeated key is no promotion, evictions are not
    counted, and reported entries and bytes count a repeated key again."""

    def __init__(self, policy: str, capacity: int):
        self.shard = CacheShard(0, policy, capacity)

    def step(self, op, key, size):
        s = self.shard
        if op == DELETE:
            gone = s._drop(key) if key in s.items else None
            return (None, 0, 0) if gone is None else (None, -1, -gone)
        evicted = s.policy.add(key)
        gone = s._drop(evicted) if evicted is not None else 0
        s.items[key] = (size, None)
        return evicted, 1 - (evicted is not None), size - gone


def recover_bounded(records: DataFrame, config: CacheConfig, as_of_ns: int) -> DataFrame:
    """Replayed records (``seq, op, key, shard``) with ``evicted, d_entries, d_memory``."""
    alive = records.filter((F.col("op") == DELETE) | F.col("expires_ns").isNull() | (F.col("expires_ns") >= as_of_ns))
    size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 128).cast("long")
    slim = alive.select("seq", F.col("op").cast("int").alias("op"), "key", size.alias("size"), shard_of(F.col("key"), config.shard_count, config.virtual_nodes).alias("shard"))
    policy, capacity = config.policy, config.shard_capacity
    return sorted_fold(slim, ["shard"], ["seq"], ["op", "key", "size"], lambda _: _Replayer(policy, capacity), "evicted string, d_entries long, d_memory long")


_SEPARATOR = b"\x00"


def _rows_of(frames: Iterator[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of the frames, cut at separators, which the writer puts back."""
    held = bytearray()
    for frame in frames:
        held += frame
        if len(held) > size and (cut := held.rfind(_SEPARATOR)) >= 0:
            yield bytes(held[:cut])
            del held[: cut + 1]
    if held:
        yield bytes(held)


def write_log(records: DataFrame, path: str, append: bool = True) -> None:
    """Write rows ``seq, op, key, value, expires_ns`` as log files in the order of ``seq``,
    behind what the log at ``path`` holds (``append=False``: instead of it).

    Rows are dealt out by ranges of ``seq``, one file each; rows whose key is too long for
    a record are left out, as :func:`encode_rows` tells."""
    spark = records.sparkSession
    if not append:
        truncate_log(spark, path)
    frames = encode_rows(records).filter("frame is not null").repartitionByRange("seq").sortWithinPartitions("seq").select("frame")

    def run(batches):
        for row in _rows_of(x.as_py() for batch in batches for x in batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["value"])

    lines = frames.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", _SEPARATOR.decode()).text(f"{path}/{_next(spark, path):06d}")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _next(spark: SparkSession, path: str) -> int:
    """The number of the next write to a log."""
    at, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n) for n in names if n.isdigit()), default=-1) + 1


def truncate_log(spark: SparkSession, path: str) -> None:
    """Leave an empty log at ``path``."""
    at, fs = _folder(spark, path)
    fs.delete(at, True)
    fs.mkdirs(at)


def in_order(records: DataFrame) -> DataFrame:
    """Records of a log's files with ``seq`` counted through the whole log."""
    out = global_position(records, [F.col("path")], [F.col("seq")], "_at")
    return out.withColumn("seq", F.col("_at") - 1).drop("_at")
