import pytest

from tracemill.config import CacheConfig, ProviderConfig
from tracemill.operators import cache
from tracemill.operators.cache import SECOND, CacheShard
from tracemill.operators.ring import lookup, ring_point, ring_points

OPS = "seq long, t long, op string, key string, value string, ttl_ms long"


def outcomes(spark, rows, config, start=None):
    df = cache.replay(spark.createDataFrame(rows, OPS), config, start)
    return {r.seq: r for r in df.collect()}


ONE = CacheConfig(max_entries=2, shard_count=1, virtual_nodes=4, sweep=False)


def test_ttl_boundary_overwrite_and_keys(spark):
    s = 1_000_000
    rows = [
        (1, 0, "SET", "a", "v", 5000), (2, 5 * s, "GET", "a", None, None), (3, 5 * s + 1, "GET", "a", None, None), (4, 6 * s, "GET", "a", None, None),
        (5, 7 * s, "SET", "", "v", None), (6, 8 * s, "SET", "b", "x", 1), (7, 9 * s, "DELETE", "b", None, None), (8, 9 * s, "DELETE", "b", None, None),
        (9, 10 * s, "SET", None, "v", None), (10, 11 * s, "SET", "c", None, -1), (11, 99 * s, "GET", "c", None, None), (12, 99 * s, "PING", "c", None, None),
    ]
    got = {k: r.outcome for k, r in outcomes(spark, rows, ONE).items()}
    assert got == {
        1: "stored", 2: "hit", 3: "expired", 4: "miss", 5: "invalid_key", 6: "stored", 7: "deleted",  # deleting looks at no expiry
        8: "not_found", 9: "invalid_key", 10: "stored", 11: "hit", 12: "unknown_op",
    }


def test_overwrite_never_evicts_and_resets(spark):
    rows = [(i, i, op, k, "v", None) for i, (op, k) in enumerate([("SET", "a"), ("SET", "b"), ("SET", "a"), ("SET", "c"), ("GET", "a"), ("GET", "b")])]
    got = outcomes(spark, rows, ONE)
    assert got[2].evicted is None and got[3].evicted == "b" and got[4].outcome == "hit" and got[5].outcome == "miss"
    # the overwrite adds its size to the reported bytes without taking off the old
    assert got[2].d_memory == 1 + 1 + 128 and got[2].d_memory_true == 0 and got[2].d_entries == 0


def test_expired_entries_hold_room_until_swept(spark):
    rows = [(1, 0, "SET", "a", "v", 1), (2, 1, "SET", "b", "v", None), (3, 10 * SECOND, "SET", "c", "v", None)]
    assert outcomes(spark, rows, ONE)[3].evicted == "a"
    swept = outcomes(spark, rows, CacheConfig(max_entries=2, shard_count=1, virtual_nodes=4), 0)
    assert swept[3].evicted is None and swept[3].d_entries == 0  # one in, one swept


def test_sweep_visits_one_shard_a_second():
    shard = CacheShard(2, "lru", 10, shards=4, sweep_from=0)
    assert shard.step("SET", "a", 1, 1, 0)[0] == "stored"
    assert shard._sweep_due(2 * SECOND) == (0, 0)
    assert shard._sweep_due(3 * SECOND)[0] == 1


def test_lfu_overwrite_resets_use(spark):
    config = CacheConfig(max_entries=2, shard_count=1, virtual_nodes=4, eviction_policy="lfu", sweep=False)
    ops = [("SET", "a"), ("GET", "a"), ("GET", "a"), ("SET", "b"), ("GET", "b"), ("SET", "a"), ("SET", "c")]
    got = outcomes(spark, [(i, i, op, k, "v", None) for i, (op, k) in enumerate(ops)], config)
    assert got[6].evicted == "a"


def test_stats_of_no_accesses(spark):
    row = cache.stats(cache.replay(spark.createDataFrame([], OPS), ONE)).first()
    assert (row.hits, row.misses, row.entries, row.hit_ratio) == (0, 0, 0, 0.0)


@pytest.mark.parametrize(
    ("key", "h", "s16", "s4", "s64"),
    [("test-key-123", 3295441989, 5, 1, 56), ("key-0", 575874866, 4, 2, 44), ("key-1", 3130424474, 15, 2, 63), ("hello", 3668683397, 11, 1, 11), ("a", 1222585490, 14, 2, 16), ("", 558161692, 11, 2, 11)],
)
def test_ring_vectors(key, h, s16, s4, s64):
    assert ring_point(key.encode()) == h
    for want, shape in ((s16, (16, 128)), (s4, (4, 32)), (s64, (64, 128))):
        assert lookup(key.encode(), ring_points(*shape)) == want


def test_ring_balance(spark):
    from pyspark.sql import functions as F

    from tracemill.operators import ring

    keys = spark.range(100_000).select(F.concat(F.lit("key-"), "id").alias("key"))
    got = {r.shard: r.n_keys for r in ring.balance(keys, "key", 16, 128).collect()}
    assert [got[i] for i in range(16)] == [7118, 7020, 6670, 7883, 7096, 7303, 5451, 4545, 5495, 5623, 5250, 6781, 4787, 6064, 6121, 6793]


def test_evictions_over_shards(spark):
    rows = [(i, i, "SET", f"key-{i}", "v", None) for i in range(100)]
    row = cache.stats(cache.replay(spark.createDataFrame(rows, OPS), CacheConfig(8, shard_count=4, virtual_nodes=32, sweep=False))).first()
    assert (row.evictions, row.entries) == (92, 8)


def test_config():
    with pytest.raises(ValueError):
        CacheConfig(shard_count=0)
    c = CacheConfig.from_env({"CACHE_MAX_ENTRIES": "7", "CACHE_SHARD_COUNT": "x", "CACHE_WAL_ENABLED": "false"})
    assert (c.max_entries, c.shard_count, c.wal_enabled, c.shard_capacity) == (7, 64, False, 1)
    assert CacheConfig(eviction_policy="none").policy == "lru"
    p = ProviderConfig.from_env({"SMTP_HOST": "mail", "SMS_FROM": "", "SMTP_PORT": "1"})
    assert (p.smtp_host, p.sms_from, p.smtp_port, p.push_server_key) == ("mail", "+10000000000", 587, "")
