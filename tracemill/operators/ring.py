"""Consistent-hash ring: points, lookup, balance."""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.arrays import constant, count_below
from tracemill.functions.hashing import ring_hash


def ring_point(data: bytes) -> int:
    return zlib.crc32(zlib.crc32(data).to_bytes(4, "little") + data)


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Sorted (point, shard); of colliding points the one made last stays."""
    made: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            made[ring_point(f"shard-{s}-vn-{v}".encode())] = s
    return sorted(made.items())


def ring_table(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """The ring as ``point, shard``, built by Spark."""
    grid = spark.range(shards).withColumnRenamed("id", "shard").select("shard", F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("v"))
    name = F.concat(F.lit("shard-"), F.col("shard"), F.lit("-vn-"), F.col("v"))
    grid = grid.select(ring_hash(name).alias("point"), F.struct("shard", "v").alias("made"), "shard")
    return grid.groupBy("point").agg(F.max_by("shard", "made").cast("int").alias("shard"))


def shard_of(key: Column, shards: int, virtual_nodes: int) -> Column:
    """Shard of a key: that of the first point at or after its hash, else of the first.

    A binary search in the ring, whose size is a setting; no join, no Python."""
    points = ring_points(shards, virtual_nodes)
    if not points:
        return F.lit(0)
    below = count_below([p for p, _ in points], ring_hash(key), inclusive=False)
    return F.get(constant([s for _, s in points], "int"), below % len(points))


def lookup(key: bytes, points: list[tuple[int, int]]) -> int:
    """The same lookup outside Spark."""
    if not points:
        return 0
    i = bisect.bisect_left(points, (ring_point(key), -1))
    return points[i % len(points)][1]


def balance(keys: DataFrame, key: str, shards: int, virtual_nodes: int) -> DataFrame:
    """``shard, n_keys``."""
    return keys.groupBy(shard_of(F.col(key), shards, virtual_nodes).alias("shard")).agg(F.count("*").alias("n_keys"))
