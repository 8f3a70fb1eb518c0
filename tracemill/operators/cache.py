"""Replay of cache operations, shard by shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.config import ENTRY_OVERHEAD, CacheConfig
from tracemill.functions.fold import sorted_fold
from tracemill.operators.policies import make_policy
from tracemill.operators.ring import shard_of

SECOND = 1_000_000

OUTPUTS = "outcome string, evicted string, d_entries long, d_memory long, d_memory_true long"


class CacheShard:
    """One shard; times are microseconds and come with the operations.

    Reported counters keep two habits of a real service: an overwrite adds the new
    size without taking off the old one, and evicted and expired entries count until
    they go.  ``d_memory_true`` is the actual change.
    """

    def __init__(self, shard: int, policy: str, capacity: int, shards: int = 1, sweep_from: int | None = None):
        self.policy = make_policy(policy, capacity)
        self.shard, self.shards, self.sweep_from = shard, shards, sweep_from
        self.items: dict[str, tuple[int, int | None]] = {}
        self.due: list[tuple[int, str]] = []
        self.swept = None

    def _drop(self, key: str) -> int:
        size, _ = self.items.pop(key)
        self.policy.remove(key)
        return size

    def sweep(self, at: int) -> tuple[int, int]:
        """Removes what expired before ``at``; (entries, bytes) removed."""
        n = size = 0
        while self.due and self.due[0][0] < at:
            expires, key = heapq.heappop(self.due)
            if key in self.items and self.items[key][1] == expires:
                size += self._drop(key)
                n += 1
        return n, size

    def _sweep_due(self, at: int) -> tuple[int, int]:
        """The background sweep visits one shard a second, in turn."""
        if self.sweep_from is None:
            return 0, 0
        first = self.sweep_from + (self.shard + 1) * SECOND
        if at < first:
            return 0, 0
        last = first + (at - first) // (self.shards * SECOND) * self.shards * SECOND
        if last == self.swept:
            return 0, 0
        self.swept = last
        return self.sweep(last)

    def get(self, key: str, at: int) -> tuple[str, int]:
        """(outcome, bytes dropped)."""
        entry = self.items.get(key)
        if entry is None:
            return "miss", 0
        if entry[1] is not None and at > entry[1]:
            return "expired", self._drop(key)
        self.policy.access(key)
        return "hit", 0

    def put(self, key: str, size: int, expires: int | None) -> tuple[str | None, int, int]:
        """(evicted key, its bytes, bytes replaced)."""
        replaced = 0
        if key in self.items:
            replaced = self.items[key][0]
            self.policy.remove(key)
        evicted = self.policy.add(key)
        gone = self._drop(evicted) if evicted is not None else 0
        self.items[key] = (size, expires)
        # only the sweep empties the heap
        if expires is not None and self.sweep_from is not None:
            heapq.heappush(self.due, (expires, key))
        return evicted, gone, replaced

    def step(self, op: str, key: str, value_bytes: int, ttl_ms: int | None, at: int):
        n, size = self._sweep_due(at)
        if op == "SET":
            if not key:
                return "invalid_key", None, -n, -size, -size
            expires = at + ttl_ms * 1000 if ttl_ms is not None and ttl_ms > 0 else None
            mem = len(key.encode()) + (value_bytes or 0) + ENTRY_OVERHEAD
            had = key in self.items
            evicted, gone, replaced = self.put(key, mem, expires)
            entries = 1 - had - (evicted is not None) - n
            return "stored", evicted, entries, mem - gone - size, mem - gone - replaced - size
        if op == "GET":
            outcome, gone = self.get(key, at)
            return outcome, None, -n - (outcome == "expired"), -gone - size, -gone - size
        if op == "DELETE":
            if key not in self.items:
                return "not_found", None, -n, -size, -size
            gone = self._drop(key)
            return "deleted", None, -n - 1, -gone - size, -gone - size
        return "unknown_op", None, -n, -size, -size


def replay(ops: DataFrame, config: CacheConfig, sweep_from: int | None = None) -> DataFrame:
    """``ops`` (``seq, t, op, key, value, ttl_ms``) with ``shard`` and outcome columns.

    Shards are independent, so there is one ordered stream a shard; ``shard_count`` is
    the parallelism.  ``sweep_from`` starts the background sweep at that time.
    """
    policy, capacity, shards = config.policy, config.shard_capacity, config.shard_count
    start = sweep_from if config.sweep else None
    key = F.coalesce(F.col("key"), F.lit(""))
    slim = ops.select("seq", "t", "op", key.alias("key"), F.octet_length("value").cast("long").alias("value_bytes"), F.col("ttl_ms").cast("long").alias("ttl_ms"))
    slim = slim.withColumn("shard", shard_of(F.col("key"), shards, config.virtual_nodes))
    return sorted_fold(
        slim, ["shard"], ["t", "seq"], ["op", "key", "value_bytes", "ttl_ms", "t"],
        lambda shard: CacheShard(shard, policy, capacity, shards, start), OUTPUTS,
    )


def stats(outcomes: DataFrame) -> DataFrame:
    """One row of counters; the hit ratio is 0 without accesses."""
    s = outcomes.agg(
        F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome").isin("miss", "expired")).alias("misses"),
        F.count("evicted").alias("evictions"), F.coalesce(F.sum("d_entries"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("d_memory"), F.lit(0)).alias("memory_bytes"), F.coalesce(F.sum("d_memory_true"), F.lit(0)).alias("memory_bytes_true"),
    )
    seen = F.col("hits") + F.col("misses")
    return s.withColumn("hit_ratio", F.when(seen > 0, F.col("hits") / seen).otherwise(0.0))


def fifo_resident(ops: DataFrame, config: CacheConfig) -> DataFrame:
    """``shard, key`` held at the end of a trace of SETs without TTL under FIFO.

    Closed form: an overwrite inserts anew, so a shard holds its last-set keys."""
    last = ops.filter((F.col("op") == "SET") & (F.col("key") != "")).groupBy("key").agg(F.max(F.struct("t", "seq")).alias("last"))
    last = last.withColumn("shard", shard_of(F.col("key"), config.shard_count, config.virtual_nodes))
    rank = F.row_number().over(W.partitionBy("shard").orderBy(F.col("last").desc()))
    return last.withColumn("_r", rank).filter(F.col("_r") <= config.shard_capacity).select("shard", "key")


def point_read(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests (``key, t``) joined with a snapshot (``key, value, expires``): ``outcome``
    and ``value`` of each."""
    joined = requests.join(state.select(F.col("key").alias("_k"), "value", "expires"), F.col("key") == F.col("_k"), "left")
    gone = F.col("expires").isNotNull() & (F.col("t") > F.col("expires"))
    outcome = F.when(F.col("_k").isNull(), "miss").when(gone, "expired").otherwise("hit")
    return joined.withColumn("outcome", outcome).withColumn("value", F.when(F.col("outcome") == "hit", F.col("value"))).drop("_k")
