"""Streaming wrappers: the transition classes of the batch operators, kept as state.

Rows of a micro-batch are sorted by (time, tie-breaker) per key before they are
stepped, and state is carried from batch to batch, so a stream whose batches follow
each other in time gives what the batch operators give.  The RocksDB state store is
needed (:func:`configure`).  State of :func:`stateful` lasts as long as the stream;
:func:`dedup_expiring` and :func:`retries` keep time by a watermark, and their state ends.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tracemill.config import CacheConfig, RateLimit, RetryPolicy
from tracemill.functions.hashing import uniform
from tracemill.operators.admission import TokenBucket, TtlDedup
from tracemill.operators.cache import OUTPUTS, CacheShard
from tracemill.operators.ring import shard_of


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Stepper(StatefulProcessor):
    def __init__(self, make: Callable, order: Sequence[str], inputs: Sequence[str], names: Sequence[str], added: Sequence[str]):
        self.make, self.order, self.inputs, self.names, self.added = make, list(order), list(inputs), list(names), list(added)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make(*key)
        made = [held.step(*row) for row in zip(*(_plain(df[c]) for c in self.inputs), strict=True)]
        self.state.update((pickle.dumps(held),))
        out = df[self.names].reset_index(drop=True)
        for name, values in zip(self.added, zip(*made, strict=True), strict=True):
            out[name] = list(values)
        yield out

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    return [None if pd.isna(x) else x for x in column.tolist()]


def stateful(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], make: Callable, outputs: str) -> DataFrame:
    """The streaming form of :func:`tracemill.functions.fold.sorted_fold`."""
    added = StructType.fromDDL(outputs)
    schema = StructType([*df.schema.fields, *added.fields])
    return df.groupBy(*keys).transformWithStateInPandas(_Stepper(make, order, inputs, df.columns, added.names), schema, "Append", "None")


def dedup(df: DataFrame, keys: Sequence[str], ttl_us: int) -> DataFrame:
    return stateful(df, keys, ["t", "seq"], ["t"], lambda *_: TtlDedup(ttl_us), "duplicate boolean")


def limit(df: DataFrame, keys: Sequence[str], bucket: RateLimit, name: str = "allowed") -> DataFrame:
    rate, capacity = bucket.rate, bucket.capacity
    return stateful(df, keys, ["t", "seq"], ["t"], lambda *_: TokenBucket(rate, capacity), f"{name} boolean")


def replay(ops: DataFrame, config: CacheConfig, sweep_from: int | None = None) -> DataFrame:
    """Streaming form of :func:`tracemill.operators.cache.replay`."""
    policy, capacity, shards = config.policy, config.shard_capacity, config.shard_count
    start = sweep_from if config.sweep else None
    slim = ops.select("seq", "t", "op", F.coalesce("key", F.lit("")).alias("key"), F.octet_length("value").cast("long").alias("value_bytes"), F.col("ttl_ms").cast("long").alias("ttl_ms"))
    slim = slim.withColumn("shard", shard_of(F.col("key"), shards, config.virtual_nodes))
    return stateful(slim, ["shard"], ["t", "seq"], ["op", "key", "value_bytes", "ttl_ms", "t"], lambda shard: CacheShard(shard, policy, capacity, shards, start), OUTPUTS)


class _DedupTtl(StatefulProcessor):
    """Deduplication whose state goes by itself: a timer drops a key once no call can be a
    duplicate of its accepted one any more."""

    def __init__(self, ttl_us: int, names: Sequence[str]):
        self.ttl_us, self.names = ttl_us, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("until", "until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable")
        held = TtlDedup(self.ttl_us)
        before = held.until = self.state.get()[0] if self.state.exists() else None
        out = df[self.names].reset_index(drop=True)
        out["duplicate"] = [held.step(int(t))[0] for t in df["t"]]
        if held.until != before:
            if before is not None:
                self.handle.deleteTimer(_ms(before))
            self.state.update((held.until,))
            self.handle.registerTimer(_ms(held.until))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _ms(us: int) -> int:
    """The first millisecond at which a time in microseconds is over."""
    return -(-us // 1000)


def dedup_expiring(df: DataFrame, keys: Sequence[str], ttl_us: int, delay: str = "0 seconds") -> DataFrame:
    """Streaming dedup with bounded state: ``df`` (``t`` in microseconds, ``seq``) with
    ``duplicate``.  Rows later than ``delay`` behind the newest are dropped, and a key is
    forgotten when the watermark passes the end of its window."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL("duplicate boolean").fields])
    timed = df.withColumn("_at", F.timestamp_micros("t")).withWatermark("_at", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(_DedupTtl(ttl_us, df.columns), schema, "Append", "EventTime")


class _Retrier(StatefulProcessor):
    """Holds a failed notification until its retry is due, then gives it back."""

    def __init__(self, policy: RetryPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("due", "due_ms bigint", "attempt int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        for attempt, t, share in zip(df["attempt"], df["t"], df["share"], strict=True):
            if attempt < self.policy.max_attempts:
                delay = share * self.policy.cap(int(attempt)) or self.policy.base_seconds
                due = _ms(int(t) + int(delay * 1e6))
                self.state.updateValue((due,), (int(attempt),))
                self.handle.registerTimer(due)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        attempt = self.state.getValue((due,))[0]
        self.state.removeKey((due,))
        yield pd.DataFrame({"id": [key[0]], "attempt": [attempt], "due_ms": [due]})

    def close(self) -> None:
        pass


def retries(failures: DataFrame, policy: RetryPolicy, delay: str = "0 seconds") -> DataFrame:
    """``id, attempt, due_ms`` of each failed send (``id, attempt, t`` in microseconds) that is
    to be sent again, given when the watermark reaches the time it is due.  The delay is the
    one of :func:`tracemill.operators.delivery.retry_schedule`."""
    timed = failures.select("id", F.col("attempt").cast("int").alias("attempt"), "t", uniform(F.col("id"), F.col("attempt")).alias("share"), F.timestamp_micros("t").alias("_at"))
    schema = StructType([failures.schema["id"], *StructType.fromDDL("attempt int, due_ms bigint").fields])
    return timed.withWatermark("_at", delay).groupBy("id").transformWithStateInPandas(_Retrier(policy), schema, "Append", "EventTime")


def upsert_latest(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keep the last status of each id as a table dealt into ``buckets`` by a hash of the id.

    A batch rewrites only the buckets that it touches, as new versions named by batch, so
    a repeated batch writes the same versions again; versions that the batch before had
    already replaced are deleted.  Read it with :func:`read_latest`.  Returns the started query."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("id", "step", "status", "attempts", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"))
        # at most one row a bucket
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        if not touched:
            return
        held = {b: [v for v in vs if v < batch_id] for b, vs in _versions(spark, path).items()}
        old = [f"{path}/bucket={b}/v={max(held[b])}" for b in touched if held.get(b)]
        if old:
            before = spark.read.parquet(*old).select("id", "step", "status", "attempts")
            rows = rows.unionByName(before.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")))
        last = rows.groupBy("bucket", "id").agg(F.max(F.struct("step", "attempts", "status")).alias("l"))
        out = last.select("id", "l.step", "l.status", "l.attempts", "bucket", F.lit(batch_id).alias("v"))
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(path)
        for b in touched:
            for v in sorted(held.get(b, []))[:-1]:
                _delete(spark, f"{path}/bucket={b}/v={v}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _listed(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Versions of each bucket of a status table."""
    buckets = [n for n in _listed(spark, path) if n.startswith("bucket=")]
    return {int(n[7:]): [int(v[2:]) for v in _listed(spark, f"{path}/{n}") if v.startswith("v=")] for n in buckets}


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """``id, step, status, attempts`` of a table that :func:`upsert_latest` keeps."""
    newest = [f"{path}/bucket={b}/v={max(vs)}" for b, vs in sorted(_versions(spark, path).items()) if vs]
    if not newest:
        return spark.createDataFrame([], "id string, step int, status string, attempts int")
    return spark.read.parquet(*newest).select("id", "step", "status", "attempts")
