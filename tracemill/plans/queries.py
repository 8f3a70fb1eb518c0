"""Registered queries over the test tables, and the DuckDB SQL that each must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import CHANNELS, CacheConfig, DeliveryConfig, PoolConfig, RateLimit, RetryPolicy
from tracemill.functions import codec
from tracemill.functions.hashing import dedup_key, request_id, ring_hash, uniform
from tracemill.functions.tables import shared_dir
from tracemill.operators import admission, cache, delivery, dispatch, ring
from tracemill.plans.submit import submit, validated
from tracemill.sources import requests, traces, wal
from tracemill.streaming import sinks

Query = Callable[[SparkSession, str], DataFrame]

HOUR = 3_600_000_000
#: 2024-01-01, 2024-01-15 and 2024-01-20, in microseconds.
START, MID, LATE = 1_704_067_200_000_000, 1_705_276_800_000_000, 1_705_708_800_000_000
SMALL = {p: CacheConfig(max_entries=40, shard_count=4, virtual_nodes=32, eviction_policy=p, sweep=False) for p in ("lru", "lfu", "fifo")}
USER_LIMIT, CHANNEL_LIMIT = RateLimit(0.00002, 2.0), RateLimit(0.0006, 5.0)
DELIVERY = DeliveryConfig(dedup_seconds=21_600.0, user_limit=USER_LIMIT, channel_limit=CHANNEL_LIMIT, bands=(300, 800, 700, 400))
RETRY = RetryPolicy()
POOLS = {c: PoolConfig(32, 128, 4) for c in CHANNELS}

# ---------------------------------------------------------------- pieces of SQL


def _bytes(s: str) -> str:
    return f"list_transform(range(1, 1 + octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), (2 * i - 1)::BIGINT, 2))::BIGINT)"


def _crc(b: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _ring_cte(name: str, source: str, key: str) -> str:
    """CTEs that end in ``name``: the source's columns and ``h``, the ring hash of ``key``."""
    return f"""{name}_b AS (SELECT *, {_bytes(key)} AS bs FROM {source}),
{name}_c AS (SELECT *, {_crc('bs')} AS c1 FROM {name}_b),
{name} AS (SELECT * EXCLUDE (bs, c1), {_crc("list_concat([c1 & 255, (c1 >> 8) & 255, (c1 >> 16) & 255, c1 >> 24], bs)")} AS h FROM {name}_c)"""


def _assign_cte(name: str, keys: str, shards: int, vnodes: int) -> str:
    """CTEs that end in ``name (key, shard)`` for the relation ``keys (key)``."""
    return f"""{name}_v AS (SELECT s::INT AS shard, 'shard-' || s || '-vn-' || v AS key FROM range({shards}) a(s), range({vnodes}) b(v)),
{_ring_cte(name + '_p', name + '_v', 'key')}, {_ring_cte(name + '_k', keys, 'key')},
{name}_at AS (SELECT k.key, coalesce((SELECT min(p.h) FROM {name}_p p WHERE p.h >= k.h), (SELECT min(h) FROM {name}_p)) AS h FROM {name}_k k),
{name} AS (SELECT a.key, p.shard FROM {name}_at a JOIN {name}_p p ON a.h = p.h)"""


EV = "ev AS (SELECT event_id AS seq, epoch_us(ts) AS t, user_id, event_type, value, props FROM events)"
OPS = f"""{EV}, ops AS (SELECT seq, t, CASE WHEN event_type IN ('signup', 'purchase') THEN 'SET' WHEN event_type = 'error' THEN 'DELETE' ELSE 'GET' END AS op,
  'user-' || user_id AS key, props AS value, floor(value * 3600000)::BIGINT AS ttl_ms FROM ev)"""
SUB = f"""{EV}, sub AS (SELECT seq, t, CASE WHEN seq % 97 = 0 THEN '' ELSE 'user-' || user_id END AS user_id,
  CASE WHEN seq % 89 = 0 THEN 'fax' ELSE CASE event_type WHEN 'signup' THEN 'email' WHEN 'purchase' THEN 'sms' WHEN 'view' THEN 'push' WHEN 'click' THEN 'webhook' ELSE 'inapp' END END AS channel,
  CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 31 = 0 THEN 9 ELSE seq % 4 END::INT AS priority, event_type AS subject,
  CASE WHEN seq % 79 = 0 THEN '' ELSE props END AS body, CASE WHEN seq % 83 = 0 THEN '' ELSE 'to-' || user_id END AS "to" FROM ev)"""
VALID = f"""{SUB}, val AS (SELECT *, CASE WHEN user_id = '' THEN 'user_id is required'
  WHEN channel NOT IN ('email', 'sms', 'push', 'webhook', 'inapp') THEN 'invalid channel "' || channel || '"'
  WHEN "to" = '' AND channel <> 'inapp' THEN 'payload.to is required for channel ' || channel
  WHEN body = '' THEN 'payload.body is required' END AS invalid_reason,
  CASE WHEN coalesce(priority, 0) IN (0, 1, 2) THEN coalesce(priority, 0) ELSE 3 END::INT AS band, sha256(user_id || channel || "to" || body || subject) AS key,
  'notif_' || substr(sha256(seq::VARCHAR), 1, 32) AS id FROM sub)"""


def _bucket_cte(name: str, source: str, key: str, rate: float, cap: float) -> str:
    """``name (seq, ok)``: a token bucket for each ``key`` of ``source (seq, t)``."""
    allow = f"least({cap}::DOUBLE, r.tok + ((s.t - r.t) / 1e6) * {rate}::DOUBLE)"
    return f"""{name}_s AS MATERIALIZED (SELECT seq, t, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY t, seq) AS rn FROM {source}),
{name}_r AS (SELECT seq, t, k, rn, CASE WHEN {cap} >= 1 THEN {cap}::DOUBLE - 1 ELSE {cap}::DOUBLE END AS tok, {cap} >= 1 AS ok FROM {name}_s WHERE rn = 1
  UNION ALL SELECT s.seq, s.t, s.k, s.rn, CASE WHEN {allow} >= 1 THEN {allow} - 1 ELSE {allow} END, {allow} >= 1 FROM {name}_r r JOIN {name}_s s ON s.k = r.k AND s.rn = r.rn + 1),
{name} AS MATERIALIZED (SELECT seq, ok FROM {name}_r)"""


def _dedup_cte(name: str, source: str, key: str, ttl: int) -> str:
    """``name (seq, dup)``."""
    return f"""{name}_s AS MATERIALIZED (SELECT seq, t, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY t, seq) AS rn FROM {source}),
{name}_r AS (SELECT seq, k, rn, t + {ttl} AS until, false AS dup FROM {name}_s WHERE rn = 1
  UNION ALL SELECT s.seq, s.k, s.rn, CASE WHEN s.t < r.until THEN r.until ELSE s.t + {ttl} END, s.t < r.until FROM {name}_r r JOIN {name}_s s ON s.k = r.k AND s.rn = r.rn + 1),
{name} AS MATERIALIZED (SELECT seq, dup FROM {name}_r)"""


def _replay_cte(c: CacheConfig, sweep_from: int | None = None) -> str:
    """``rep (seq, shard, outcome, evicted, d_entries, d_memory, d_memory_true)`` of a cache.

    Before an operation goes what expired by the last visit of the sweep to its shard."""
    policy, cap = c.policy, c.shard_capacity
    first, every = f"({sweep_from} + (shard + 1) * {cache.SECOND})", c.shard_count * cache.SECOND
    visit = "NULL::BIGINT" if sweep_from is None else f"CASE WHEN t >= {first} THEN {first} + (t - {first}) // {every} * {every} END"
    freq0 = 1 if policy == "lfu" else 0
    freq = "e.freq + 1" if policy == "lfu" else "e.freq"
    touch = "e.touch" if policy == "fifo" else "rn"
    entry = "STRUCT(freq BIGINT, touch BIGINT, key VARCHAR, exp BIGINT, size BIGINT)"
    return f"""{OPS}, keys AS (SELECT DISTINCT key FROM ops), {_assign_cte('asg', 'keys', c.shard_count, c.virtual_nodes)},
srt AS MATERIALIZED (SELECT o.*, a.shard, octet_length(encode(o.key)) + octet_length(encode(o.value)) + 128 AS mem, {visit} AS visit,
  row_number() OVER (PARTITION BY shard ORDER BY t, seq) AS rn FROM ops o JOIN asg a ON o.key = a.key),
rec AS (SELECT shard, 0::BIGINT AS rn, []::{entry}[] AS st, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, NULL::VARCHAR AS evicted, 0::BIGINT AS d_entries, 0::BIGINT AS d_memory, 0::BIGINT AS d_memory_true
    FROM (SELECT DISTINCT shard FROM srt)
  UNION ALL
  SELECT shard, rn,
    CASE op WHEN 'SET' THEN list_append(CASE WHEN evict THEN rest_sorted[2:] ELSE rest END, {{'freq': {freq0}::BIGINT, 'touch': rn, 'key': key, 'exp': CASE WHEN ttl_ms > 0 THEN t + ttl_ms * 1000 END, 'size': mem}}::{entry})
      WHEN 'GET' THEN CASE WHEN e IS NULL OR gone THEN rest ELSE list_append(rest, {{'freq': {freq}, 'touch': {touch}, 'key': e.key, 'exp': e.exp, 'size': e.size}}::{entry}) END
      ELSE rest END,
    seq, CASE op WHEN 'SET' THEN 'stored' WHEN 'GET' THEN CASE WHEN e IS NULL THEN 'miss' WHEN gone THEN 'expired' ELSE 'hit' END ELSE CASE WHEN e IS NULL THEN 'not_found' ELSE 'deleted' END END,
    CASE WHEN evict THEN rest_sorted[1].key END,
    CASE op WHEN 'SET' THEN (e IS NULL)::BIGINT - evict::BIGINT WHEN 'GET' THEN -(e IS NOT NULL AND gone)::BIGINT ELSE -(e IS NOT NULL)::BIGINT END - n_swept,
    CASE op WHEN 'SET' THEN mem - CASE WHEN evict THEN rest_sorted[1].size ELSE 0 END WHEN 'GET' THEN CASE WHEN gone THEN -e.size ELSE 0 END ELSE -coalesce(e.size, 0) END - b_swept,
    CASE op WHEN 'SET' THEN mem - coalesce(e.size, 0) - CASE WHEN evict THEN rest_sorted[1].size ELSE 0 END WHEN 'GET' THEN CASE WHEN gone THEN -e.size ELSE 0 END ELSE -coalesce(e.size, 0) END - b_swept
  FROM (SELECT *, coalesce(e.exp < t, false) AS gone, list_sort(rest) AS rest_sorted, op = 'SET' AND e IS NULL AND len(rest) >= {cap} AS evict FROM (
    SELECT k.*, list_filter(k.kept, lambda x: x.key = k.key)[1] AS e, list_filter(k.kept, lambda x: x.key <> k.key) AS rest,
      len(k.swept) AS n_swept, coalesce(list_sum(list_transform(k.swept, lambda x: x.size)), 0)::BIGINT AS b_swept
    FROM (SELECT s.*, list_filter(r.st, lambda x: coalesce(x.exp >= s.visit, true)) AS kept, list_filter(r.st, lambda x: coalesce(x.exp < s.visit, false)) AS swept
      FROM rec r JOIN srt s ON s.shard = r.shard AND s.rn = r.rn + 1) k))),
rep AS (SELECT * EXCLUDE (st, rn) FROM rec WHERE rn > 0)"""


# ---------------------------------------------------------------- queries

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


@_query(f"WITH {OPS}, k AS (SELECT DISTINCT key FROM ops), {_ring_cte('r', 'k', 'key')} SELECT key, h AS ring_hash FROM r")
def ring_hashes(spark, sf_dir):
    return traces.cache_ops(spark, sf_dir).select("key").distinct().select("key", ring_hash(F.col("key")).alias("ring_hash"))


@_query(f"WITH {OPS}, k AS (SELECT DISTINCT key FROM ops), {_assign_cte('a', 'k', 64, 128)} SELECT key, shard FROM a")
def ring_assign(spark, sf_dir):
    return traces.cache_ops(spark, sf_dir).select("key").distinct().select("key", ring.shard_of(F.col("key"), 64, 128).alias("shard"))


@_query(f"WITH k AS (SELECT c_name AS key FROM customer), {_assign_cte('a', 'k', 16, 128)} SELECT shard, count(*) AS n_keys FROM a GROUP BY shard")
def ring_balance(spark, sf_dir):
    return ring.balance(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_name", 16, 128)


@_query(f"WITH v AS (SELECT s::INT AS shard, 'shard-' || s || '-vn-' || v AS key FROM range(16) a(s), range(32) b(v)), {_ring_cte('p', 'v', 'key')} SELECT h AS point, shard FROM p")
def ring_build(spark, sf_dir):
    return ring.ring_table(spark, 16, 32)


@_query(f"WITH {OPS} SELECT seq, key, octet_length(encode(key)) + octet_length(encode(value)) + 128 AS memory_bytes FROM ops WHERE op = 'SET'")
def cache_memsize(spark, sf_dir):
    ops = traces.cache_ops(spark, sf_dir).filter("op = 'SET'")
    return ops.select("seq", "key", codec.memory_size(F.col("key"), F.col("value")).alias("memory_bytes"))


@_query(f"""WITH {OPS}, x AS (SELECT seq, CASE WHEN ttl_ms > 0 THEN t + ttl_ms * 1000 END AS expires FROM ops WHERE op = 'SET')
SELECT seq, expires, expires IS NOT NULL AND {MID} > expires AS expired FROM x""")
def cache_ttl_filter(spark, sf_dir):
    ops = traces.cache_ops(spark, sf_dir).filter("op = 'SET'").withColumn("expires", codec.expiry(F.col("t"), F.col("ttl_ms"), 1000))
    return ops.select("seq", "expires", codec.expired(F.lit(MID), F.col("expires")).alias("expired"))


@_query(f"""WITH {EV}, x AS (SELECT seq, CASE seq % 4 WHEN 0 THEN props WHEN 1 THEN to_base64(encode(props)) WHEN 2 THEN 'test' ELSE 'eA' END AS raw FROM ev)
SELECT seq, hex(CASE WHEN regexp_full_match(raw, '([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?') THEN from_base64(raw) ELSE encode(raw) END) AS value FROM x""")
def value_decode(spark, sf_dir):
    n = F.col("seq") % 4
    raw = F.when(n == 0, F.col("props")).when(n == 1, F.base64(F.col("props").cast("binary"))).when(n == 2, "test").otherwise("eA")
    return traces.events(spark, sf_dir).select("seq", F.hex(codec.decode_value(raw)).alias("value"))


@_query(f"""WITH {OPS}, k AS (SELECT DISTINCT key FROM ops), {_assign_cte('a', 'k', 16, 32)},
x AS (SELECT key, max((t, seq)) AS l FROM ops WHERE op = 'SET' GROUP BY key),
y AS (SELECT shard, x.key, row_number() OVER (PARTITION BY shard ORDER BY l DESC) AS r FROM x JOIN a ON x.key = a.key) SELECT shard, key FROM y WHERE r <= 4""")
def cache_fifo_resident(spark, sf_dir):
    return cache.fifo_resident(traces.cache_ops(spark, sf_dir), CacheConfig(max_entries=64, shard_count=16, virtual_nodes=32, eviction_policy="fifo"))


def _replayed(spark, sf_dir, policy):
    return cache.replay(traces.cache_ops(spark, sf_dir), SMALL[policy]).select("seq", "shard", "outcome", "evicted")


@_query(f"WITH RECURSIVE {_replay_cte(SMALL['lru'])} SELECT seq, shard, outcome, evicted FROM rep")
def cache_replay_lru(spark, sf_dir):
    return _replayed(spark, sf_dir, "lru")


@_query(f"WITH RECURSIVE {_replay_cte(SMALL['lfu'])} SELECT seq, shard, outcome, evicted FROM rep")
def cache_replay_lfu(spark, sf_dir):
    return _replayed(spark, sf_dir, "lfu")


@_query(f"WITH RECURSIVE {_replay_cte(SMALL['fifo'])} SELECT seq, shard, outcome, evicted FROM rep")
def cache_replay_fifo(spark, sf_dir):
    return _replayed(spark, sf_dir, "fifo")


@_query(f"""WITH RECURSIVE {_replay_cte(SMALL['lru'])}, s AS (SELECT count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome IN ('miss', 'expired')) AS misses, count(evicted) AS evictions,
  sum(d_entries)::BIGINT AS entries, sum(d_memory)::BIGINT AS memory_bytes, sum(d_memory_true)::BIGINT AS memory_bytes_true FROM rep)
SELECT *, CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 0.0 END AS hit_ratio FROM s""")
def cache_stats(spark, sf_dir):
    return cache.stats(cache.replay(traces.cache_ops(spark, sf_dir), SMALL["lru"]))


@_query(f"WITH RECURSIVE {_replay_cte(CacheConfig(), START)} SELECT seq, shard, outcome, evicted, d_entries, d_memory FROM rep")
def cache_replay_sweep(spark, sf_dir):
    """Default settings with the background sweep running."""
    ops = traces.cache_ops(spark, sf_dir)
    return cache.replay(ops, CacheConfig(), START).select("seq", "shard", "outcome", "evicted", "d_entries", "d_memory")


@_query(f"""WITH {OPS}, st AS (SELECT key, arg_max(value, (t, seq)) AS value, max((t, seq)) AS l, arg_max(CASE WHEN ttl_ms > 0 THEN t + ttl_ms * 1000 ELSE -1 END, (t, seq)) AS x FROM ops WHERE op = 'SET' GROUP BY key)
SELECT o.seq, o.key, CASE WHEN st.key IS NULL THEN 'miss' WHEN x <> -1 AND o.t > x THEN 'expired' ELSE 'hit' END AS outcome,
  CASE WHEN st.key IS NOT NULL AND NOT (x <> -1 AND o.t > x) THEN st.value END AS value FROM ops o LEFT JOIN st ON o.key = st.key WHERE o.op = 'GET'""")
def cache_point_read(spark, sf_dir):
    ops = traces.cache_ops(spark, sf_dir)
    last = ops.filter("op = 'SET'").groupBy("key").agg(F.max(F.struct("t", "seq", "value", "ttl_ms")).alias("l"))
    state = last.select("key", "l.value", codec.expiry(F.col("l.t"), F.col("l.ttl_ms"), 1000).alias("expires"))
    return cache.point_read(ops.filter("op = 'GET'").select("seq", "t", "key"), state).select("seq", "key", "outcome", "value")


def _wal_records(spark, sf_dir):
    ops = traces.cache_ops(spark, sf_dir).filter("op in ('SET', 'DELETE')")
    is_set = F.col("op") == "SET"
    return ops.select(
        "seq", F.when(is_set, wal.SET).otherwise(wal.DELETE).cast("tinyint").alias("op"), "key", F.when(is_set, F.col("value").cast("binary")).otherwise(F.lit(b"")).alias("value"),
        F.when(is_set, codec.expiry(F.col("t") * 1000, F.col("ttl_ms"))).alias("expires_ns"),
    )


@_query(f"""WITH {OPS}, w AS (SELECT seq, op, key, value, CASE WHEN op = 'SET' AND ttl_ms > 0 THEN (t * 1000 + ttl_ms * 1000000) END AS x FROM ops WHERE op <> 'GET'),
l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, arg_max(coalesce(x, -1), seq) AS x FROM w WHERE op = 'DELETE' OR x IS NULL OR x >= {LATE * 1000} GROUP BY key)
SELECT key, value, CASE WHEN x <> -1 THEN x END AS expires_ns FROM l WHERE op = 'SET'""")
def wal_recover(spark, sf_dir):
    out = wal.recover(_wal_records(spark, sf_dir), LATE * 1000)
    return out.select("key", F.col("value").cast("string").alias("value"), "expires_ns")


@_query(f"""WITH {OPS} SELECT seq, CASE op WHEN 'SET' THEN 1 ELSE 2 END::TINYINT AS op, key, CASE op WHEN 'SET' THEN value ELSE '' END AS value,
  CASE WHEN op = 'SET' AND ttl_ms > 0 THEN t * 1000 + ttl_ms * 1000000 END AS expires_ns FROM ops WHERE op <> 'GET'""")
def wal_round_trip(spark, sf_dir):
    """Records encoded by expressions into one log image a partition and decoded again."""
    frames = wal.encode_rows(_wal_records(spark, sf_dir)).withColumn("path", F.concat(F.lit("log-"), F.floor(F.col("seq") / 500)))
    files = frames.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "frame"))).alias("f"))
    files = files.select("path", F.expr("unhex(array_join(transform(f, x -> hex(x.frame)), ''))").alias("content"), F.col("f.seq").alias("seqs"))
    got = wal.decode_files(files.select("path", "content"))
    numbered = files.select(F.col("path").alias("_p"), F.posexplode("seqs").alias("_i", "real_seq"))
    out = got.join(numbered, (F.col("path") == F.col("_p")) & (F.col("seq") == F.col("_i")))
    return out.select(F.col("real_seq").alias("seq"), "op", "key", F.col("value").cast("string").alias("value"), "expires_ns")


@_query(f"""WITH {OPS}, w AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos FROM ops WHERE op <> 'GET') SELECT pos AS seq, CASE op WHEN 'SET' THEN 1 ELSE 2 END::TINYINT AS op, key,
  CASE op WHEN 'SET' THEN value ELSE '' END AS value, CASE WHEN op = 'SET' AND ttl_ms > 0 THEN t * 1000 + ttl_ms * 1000000 END AS expires_ns FROM w""")
def wal_write_read(spark, sf_dir):
    """A log written in two appends after a truncation, and read back through its whole length."""
    path = f"{shared_dir(spark).rstrip('/')}/tracemill/log-{uuid.uuid4().hex}"
    records = _wal_records(spark, sf_dir)
    half = records.agg(F.max("seq")).first()[0] or 0
    wal.write_log(records.filter("seq % 3 = 0"), path)
    wal.write_log(records.filter(F.col("seq") <= half // 2), path, append=False)
    wal.write_log(records.filter(F.col("seq") > half // 2), path)
    return wal.in_order(wal.read_log(spark, path)).select("seq", "op", "key", F.col("value").cast("string").alias("value"), "expires_ns")


@_query(f"""WITH {OPS}, w AS (SELECT *, seq // 500 AS f FROM ops WHERE op <> 'GET'), bad AS (SELECT f, min(seq) AS first FROM w WHERE seq % 173 = 0 GROUP BY f)
SELECT w.f::VARCHAR AS path, count(*) AS n, max(seq) AS last FROM w LEFT JOIN bad ON w.f = bad.f WHERE first IS NULL OR seq < first GROUP BY w.f""")
def wal_corrupt(spark, sf_dir):
    """Logs in which some records are damaged: reading each stops at the first."""
    frame = F.col("frame")
    damaged = F.concat(F.expr("substring(frame, 1, octet_length(frame) - 1)"), F.unhex(F.when(F.expr("right(hex(frame), 2)") == "00", "01").otherwise("00")))
    frames = wal.encode_rows(_wal_records(spark, sf_dir)).withColumn("path", F.floor(F.col("seq") / 500).cast("string"))
    frames = frames.withColumn("frame", F.when(F.col("seq") % 173 == 0, damaged).otherwise(frame))
    files = frames.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "frame"))).alias("f"))
    files = files.select("path", F.expr("unhex(array_join(transform(f, x -> hex(x.frame)), ''))").alias("content"), F.col("f.seq").alias("seqs"))
    got = wal.decode_files(files.select("path", "content"))
    got = got.join(files.select("path", F.posexplode("seqs").alias("seq", "real")), ["path", "seq"])
    return got.groupBy("path").agg(F.count("*").alias("n"), F.max("real").alias("last"))


@_query(f"""WITH RECURSIVE {OPS}, keys AS (SELECT DISTINCT key FROM ops), {_assign_cte('asg', 'keys', SMALL['lru'].shard_count, SMALL['lru'].virtual_nodes)},
w AS (SELECT o.*, a.shard, octet_length(encode(o.key)) + CASE op WHEN 'SET' THEN octet_length(encode(o.value)) ELSE 0 END + 128 AS size FROM ops o JOIN asg a ON o.key = a.key
  WHERE op = 'DELETE' OR (op = 'SET' AND (ttl_ms <= 0 OR t + ttl_ms * 1000 >= {LATE}))),
srt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM w),
rec AS (SELECT shard, 0::BIGINT AS rn, []::STRUCT(key VARCHAR, size BIGINT)[] AS st, NULL::VARCHAR AS evicted, 0::BIGINT AS d_entries, 0::BIGINT AS d_memory FROM (SELECT DISTINCT shard FROM srt)
  UNION ALL
  SELECT shard, rn,
    CASE WHEN op = 'DELETE' THEN list_filter(st, lambda x: x.key <> q.key) WHEN e IS NOT NULL THEN list_transform(st, lambda x: CASE WHEN x.key = q.key THEN {{'key': q.key, 'size': q.size::BIGINT}} ELSE x END)
      ELSE list_append(CASE WHEN evict THEN st[2:] ELSE st END, {{'key': q.key, 'size': q.size::BIGINT}}) END,
    CASE WHEN evict THEN st[1].key END, CASE op WHEN 'DELETE' THEN -(e IS NOT NULL)::BIGINT ELSE 1 - evict::BIGINT END,
    CASE op WHEN 'DELETE' THEN -coalesce(e.size, 0) ELSE size - CASE WHEN evict THEN st[1].size ELSE 0 END END
  FROM (SELECT *, op = 'SET' AND e IS NULL AND len(st) >= {SMALL['lru'].shard_capacity} AS evict
    FROM (SELECT s.*, r.st, list_filter(r.st, lambda x: x.key = s.key)[1] AS e FROM rec r JOIN srt s ON s.shard = r.shard AND s.rn = r.rn + 1)) q)
SELECT shard, count(evicted) AS evictions, sum(d_entries)::BIGINT AS entries, sum(d_memory)::BIGINT AS memory_bytes FROM rec WHERE rn > 0 GROUP BY shard""")
def wal_recover_bounded(spark, sf_dir):
    out = wal.recover_bounded(_wal_records(spark, sf_dir), SMALL["lru"], LATE * 1000)
    return out.groupBy("shard").agg(F.count("evicted").alias("evictions"), F.sum("d_entries").alias("entries"), F.sum("d_memory").alias("memory_bytes"))


@_query(f"""WITH {EV} SELECT seq, CASE WHEN seq % 7 = 0 THEN 'invalid JSON body' END AS error, CASE WHEN seq % 7 <> 0 THEN props END AS value,
  CASE WHEN seq % 7 <> 0 THEN CASE WHEN seq % 5 = 0 THEN 0 ELSE seq * 10 END END AS ttl_ms FROM ev""")
def put_requests(spark, sf_dir):
    e = traces.events(spark, sf_dir).withColumn("key", F.concat(F.lit("user-"), F.col("user_id")))
    value = F.base64(F.col("props").cast("binary")).alias("value")
    body = F.when(F.col("seq") % 5 == 0, F.to_json(F.struct(value))).otherwise(F.to_json(F.struct(value, (F.col("seq") * 10).alias("ttl_ms"))))
    body = F.when(F.col("seq") % 7 == 0, "{not json").otherwise(body)
    got = requests.put_requests(e.select("seq", "key", body.alias("body")))
    return got.select("seq", "error", F.col("value").cast("string").alias("value"), "ttl_ms")


@_query(f"""WITH {SUB} SELECT seq, user_id, channel, coalesce(priority, 0) AS priority, subject, body AS body_text, "to" FROM sub""")
def submit_requests(spark, sf_dir):
    s = traces.submissions(spark, sf_dir)
    body = F.to_json(F.struct("user_id", "channel", "priority", F.struct("subject", "body", "to").alias("payload")))
    got = requests.submissions(s.select("seq", body.alias("body")))
    return got.select("seq", "user_id", "channel", "priority", "subject", "body_text", "to")


@_query(f"""WITH {OPS}, st AS (SELECT DISTINCT key FROM ops WHERE op = 'SET') SELECT o.seq, CASE WHEN st.key IS NULL THEN 404 ELSE 200 END AS status,
  CASE WHEN st.key IS NULL THEN '{{"error":"key not found"}}' ELSE '{{"key":"' || o.key || '","value":"' || to_base64(encode(o.value)) || '"}}' END AS response FROM ops o LEFT JOIN st ON st.key = o.key WHERE o.op = 'GET'""")
def get_responses(spark, sf_dir):
    ops = traces.cache_ops(spark, sf_dir)
    held = ops.filter("op = 'SET'").select(F.col("key").alias("_k")).distinct()
    reads = ops.filter("op = 'GET'").join(held, F.col("key") == F.col("_k"), "left").withColumn("outcome", F.when(F.col("_k").isNull(), "miss").otherwise("hit"))
    return requests.get_responses(reads).select("seq", "status", "response")


_GO = [
    '{"value":5}', "null", '{"Value":"aGk="}', '{"value":"a","VALUE":"b"} trailing', '{"value":null,"ttl_ms":null,"x":[1]}', '{"ttl_ms":1.5}', '{"ttl_ms":"5"}', "[]", '"x"', "", '{"value":"a"',
    ' {"ttl_ms":-3,"value":"caf\\u00e9"}', '{"ttl_ms":9223372036854775808}', '{"value":true}',
]


@_query("""SELECT * FROM (VALUES (0, NULL, NULL, true), (1, '', 0, false), (2, 'hi', 0, false), (3, 'b', 0, false), (4, '', 0, false), (5, NULL, NULL, true), (6, NULL, NULL, true), (7, NULL, NULL, true),
  (8, NULL, NULL, true), (9, NULL, NULL, true), (10, NULL, NULL, true), (11, 'café', -3, false), (12, NULL, NULL, true), (13, NULL, NULL, true)) v(n, value, ttl_ms, bad)""")
def json_bodies(spark, sf_dir):
    """Bodies that a typed decoder takes or refuses by rules of its own."""
    got = requests.put_requests(spark.createDataFrame(list(enumerate(_GO)), "n int, body string"))
    return got.select("n", F.col("value").cast("string").alias("value"), "ttl_ms", F.col("error").isNotNull().alias("bad"))


@_query(f"""WITH {OPS} SELECT seq, CASE WHEN op = 'SET' THEN CASE WHEN seq % 11 = 0 THEN 400 ELSE 201 END ELSE CASE WHEN seq % 3 = 0 THEN 200 ELSE 404 END END AS status,
  CASE WHEN op = 'SET' THEN CASE WHEN seq % 11 = 0 THEN '{{"error":"invalid key"}}' ELSE '{{"key":"' || key || '","stored":true}}' END ELSE CASE WHEN seq % 3 = 0 THEN '{{"deleted":true}}' ELSE '{{"error":"key not found"}}' END END AS response
  FROM ops WHERE op <> 'GET'""")
def write_responses(spark, sf_dir):
    ops = traces.cache_ops(spark, sf_dir)
    puts = requests.put_responses(ops.filter("op = 'SET'").withColumn("error", F.when(F.col("seq") % 11 == 0, "invalid_key")))
    gone = requests.delete_responses(ops.filter("op = 'DELETE'").withColumn("outcome", F.when(F.col("seq") % 3 == 0, "deleted").otherwise("not_found")))
    return puts.select("seq", "status", "response").unionByName(gone.select("seq", "status", "response"))


@_query(f"""WITH RECURSIVE {_replay_cte(SMALL['lru'])}, s AS (SELECT count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome IN ('miss', 'expired')) AS misses, count(evicted) AS evictions,
  sum(d_entries)::BIGINT AS entries, sum(d_memory)::BIGINT AS memory_bytes FROM rep)
SELECT 'cache' AS service, '{{"status":"ok","entries":' || entries || '}}' AS response FROM s
UNION ALL SELECT 'queue', '{{"status":"ok","queue_depth":' || (SELECT sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END)::BIGINT FROM events) || '}}'""")
def health_responses(spark, sf_dir):
    s = cache.stats(cache.replay(traces.cache_ops(spark, sf_dir), SMALL["lru"]))
    moves = validated(traces.submissions(spark, sf_dir)).withColumn("op", F.when(F.col("seq") % 3 == 0, "DEQ").otherwise("ENQ"))
    one = requests.health_response(s).select(F.lit("cache").alias("service"), "response")
    return one.unionByName(requests.queue_health_response(delivery.queue_depth(moves)).select(F.lit("queue").alias("service"), "response"))


@_query(f"""WITH {VALID} SELECT seq, CASE WHEN seq % 41 = 0 THEN 400 WHEN channel <> 'fax' THEN 200 ELSE 404 END AS status,
  CASE WHEN seq % 41 = 0 THEN '{{"error":"missing notification id"}}' WHEN channel <> 'fax' THEN '{{"id":"' || id || '","user_id":"' || user_id || '","channel":"' || channel || '","priority":' || coalesce(priority, 0) || '}}'
  ELSE '{{"error":"not found"}}' END AS response FROM val""")
def read_by_id(spark, sf_dir):
    s = traces.submissions(spark, sf_dir).withColumn("id", request_id(F.col("seq")))
    stored = s.filter("channel <> 'fax'").select("id", "user_id", "channel", F.coalesce("priority", F.lit(0)).alias("priority"))
    asked = s.select("seq", F.when(F.col("seq") % 41 == 0, "").otherwise(F.col("id")).alias("id"))
    return requests.read_notifications(asked, stored).select("seq", "status", "response")


_DISPATCH_BANDS, _DISPATCH_POOLS = (3, 4, 5, 3), {c: 2 for c in CHANNELS}
_BAND_SIZE = "CASE s.band WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 3 END"


def _dispatch_ops(spark, sf_dir):
    v = validated(traces.submissions(spark, sf_dir)).join(traces.events(spark, sf_dir).select("seq", F.col("user_id").alias("u")), "seq")
    kind = F.floor(F.col("seq") / 7) % 5
    op = F.when(F.col("seq") % 701 == 700, "CLOSE").when(kind.isin(0, 1), "ENQ").when(kind.isin(2, 4), "DEQ").otherwise("TAKE")
    return v.select((F.col("u") % 16).alias("queue"), "t", "seq", op.alias("op"), request_id(F.col("seq")).alias("id"), "band", "channel")


@_query(f"""WITH RECURSIVE {VALID}, dop AS (SELECT e.user_id % 16 AS queue, v.t, v.seq, CASE WHEN v.seq % 701 = 700 THEN 'CLOSE' WHEN v.seq // 7 % 5 IN (0, 1) THEN 'ENQ' WHEN v.seq // 7 % 5 IN (2, 4) THEN 'DEQ' ELSE 'TAKE' END AS op,
  v.id, v.band, v.channel FROM val v JOIN events e ON e.event_id = v.seq),
srt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY t, seq) AS rn FROM dop),
rec AS (SELECT queue, 0::BIGINT AS rn, []::STRUCT(band INT, n BIGINT, id VARCHAR, channel VARCHAR)[] AS q, []::STRUCT(n BIGINT, id VARCHAR, channel VARCHAR)[] AS j, false AS closed,
    NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, NULL::VARCHAR AS moved, 0::BIGINT AS depth FROM (SELECT DISTINCT queue FROM srt)
  UNION ALL
  SELECT queue, rn, q2, CASE WHEN outcome = 'submitted' THEN list_append(j, {{'n': rn, 'id': front.id, 'channel': front.channel}}) WHEN outcome = 'taken' THEN list_filter(j, lambda x: x.n <> job.n) ELSE j END,
    closed OR op = 'CLOSE', seq, outcome, CASE WHEN op = 'DEQ' THEN front.id WHEN outcome = 'taken' THEN job.id END, len(q2)::BIGINT
  FROM (SELECT *, CASE outcome WHEN 'queued' THEN list_append(q, {{'band': band, 'n': rn, 'id': id, 'channel': channel}}) WHEN 'requeued' THEN list_append(list_filter(q, lambda x: x.n <> front.n), {{'band': front.band, 'n': rn, 'id': front.id, 'channel': front.channel}})
      WHEN 'submitted' THEN list_filter(q, lambda x: x.n <> front.n) WHEN 'no_pool' THEN list_filter(q, lambda x: x.n <> front.n) WHEN 'dropped' THEN list_filter(q, lambda x: x.n <> front.n) ELSE q END AS q2
    FROM (SELECT *, CASE op WHEN 'CLOSE' THEN 'closed' WHEN 'TAKE' THEN CASE WHEN job IS NULL THEN 'idle' ELSE 'taken' END
        WHEN 'ENQ' THEN CASE WHEN closed THEN 'shutting_down' WHEN held >= size THEN 'queue_full' ELSE 'queued' END
        ELSE CASE WHEN front IS NULL THEN 'empty' WHEN front.channel = 'fax' THEN 'no_pool' WHEN len(list_filter(j, lambda x: x.channel = front.channel)) < 2 THEN 'submitted' WHEN closed THEN 'dropped' ELSE 'requeued' END END AS outcome
      FROM (SELECT s.*, r.q, r.j, r.closed, list_sort(r.q)[1] AS front, list_filter(r.j, lambda x: x.channel = s.channel)[1] AS job, len(list_filter(r.q, lambda x: x.band = s.band)) AS held, {_BAND_SIZE} AS size
        FROM rec r JOIN srt s ON s.queue = r.queue AND s.rn = r.rn + 1))))
SELECT seq, queue, outcome, moved, depth FROM rec WHERE rn > 0""")
def dispatch_replay(spark, sf_dir):
    out = dispatch.replay(_dispatch_ops(spark, sf_dir), _DISPATCH_BANDS, _DISPATCH_POOLS)
    return out.select("seq", "queue", "outcome", "moved", "depth")


@_query(f"""WITH {VALID}, x AS (SELECT *, seq % 6 AS tried, CASE WHEN channel = 'inapp' AND user_id = '' THEN 'user_id required' WHEN channel IN ('email', 'sms', 'push') AND "to" = '' THEN 'recipient required'
  WHEN channel = 'webhook' AND octet_length(encode("to")) % 2 = 0 THEN 'webhook returned status 502' END AS error FROM val WHERE channel <> 'fax')
SELECT id, channel, CASE WHEN error IS NULL THEN 'delivered' ELSE 'retrying' END AS status, tried + (error IS NOT NULL)::INT AS attempts, coalesce(error, '') AS last_error, error IS NOT NULL AND tried + 1 < 5 AS retry FROM x""")
def deliver_batch(spark, sf_dir):
    s = traces.submissions(spark, sf_dir).withColumns({"id": request_id(F.col("seq")), "attempts": (F.col("seq") % 6).cast("int")})
    hook = sinks.WebhookProvider(lambda url, body: F.when(F.octet_length(url) % 2 == 0, 502).otherwise(200))
    return sinks.deliver(s, [hook, *map(sinks.LogProvider, ("email", "sms", "push", "inapp"))], RETRY)


@_query(f"WITH {VALID} SELECT seq, invalid_reason, band FROM val")
def submit_validate(spark, sf_dir):
    return validated(traces.submissions(spark, sf_dir)).select("seq", "invalid_reason", "band")


@_query(f"WITH {VALID} SELECT seq, invalid_reason AS error FROM val WHERE invalid_reason IS NOT NULL")
def error_messages(spark, sf_dir):
    v = validated(traces.submissions(spark, sf_dir)).filter("invalid_reason is not null")
    return v.select("seq", codec.error_text(F.concat(F.lit("invalid input: "), F.col("invalid_reason"))).alias("error"))


@_query(f"WITH {VALID} SELECT seq, key AS dedup_key, id FROM val")
def dedup_keys(spark, sf_dir):
    s = traces.submissions(spark, sf_dir)
    return s.select("seq", dedup_key(F.col("user_id"), F.col("channel"), F.col("to"), F.col("body"), F.col("subject")).alias("dedup_key"), request_id(F.col("seq")).alias("id"))


@_query(f"WITH RECURSIVE {EV}, {_dedup_cte('d', 'ev', chr(39) + 'k' + chr(39) + ' || user_id || event_type', 6 * HOUR)} SELECT seq, dup AS duplicate FROM d")
def dedup_ttl(spark, sf_dir):
    e = traces.events(spark, sf_dir).select("seq", "t", "user_id", "event_type")
    return admission.dedup(e, ["user_id", "event_type"], 6 * HOUR).select("seq", "duplicate")


@_query(f"WITH RECURSIVE {EV}, {_bucket_cte('b', 'ev', 'user_id', USER_LIMIT.rate, USER_LIMIT.capacity)} SELECT seq, ok AS allowed FROM b")
def rate_limit_user(spark, sf_dir):
    e = traces.events(spark, sf_dir).select("seq", "t", "user_id")
    return admission.limit(e, ["user_id"], USER_LIMIT).select("seq", "allowed")


@_query(f"""WITH RECURSIVE {EV}, {_bucket_cte('b', 'ev', 'user_id', USER_LIMIT.rate, USER_LIMIT.capacity)}, pass AS MATERIALIZED (SELECT ev.* FROM ev JOIN b ON ev.seq = b.seq WHERE ok),
{_bucket_cte('c', 'pass', 'event_type', CHANNEL_LIMIT.rate, CHANNEL_LIMIT.capacity)} SELECT b.seq, b.ok AS user_ok, c.ok AS channel_ok FROM b LEFT JOIN c ON b.seq = c.seq""")
def rate_limit_chained(spark, sf_dir):
    e = traces.events(spark, sf_dir).select("seq", "t", "user_id", "event_type")
    return admission.limit_chained(e, "user_id", "event_type", USER_LIMIT, CHANNEL_LIMIT).select("seq", "user_ok", "channel_ok")


@_query(f"WITH {VALID} SELECT seq, band, row_number() OVER (ORDER BY band, t, seq) AS position FROM val")
def queue_order(spark, sf_dir):
    v = validated(traces.submissions(spark, sf_dir)).select("seq", "t", "band")
    return delivery.queue_order(v).select("seq", "band", "position")


@_query(f"""WITH {VALID}, r AS (SELECT seq, band, row_number() OVER (PARTITION BY band ORDER BY t, seq) AS n FROM val)
SELECT seq, band, n <= [{', '.join(map(str, DELIVERY.bands))}][band + 1] AS queue_ok FROM r""")
def queue_admission(spark, sf_dir):
    v = validated(traces.submissions(spark, sf_dir)).select("seq", "t", "band")
    return delivery.queue_admission(v, DELIVERY.bands).select("seq", "band", "queue_ok")


@_query(f"WITH {VALID} SELECT band, sum(CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END)::BIGINT AS depth FROM val GROUP BY band")
def queue_depth(spark, sf_dir):
    v = validated(traces.submissions(spark, sf_dir))
    return delivery.queue_depth(v.withColumn("op", F.when(F.col("seq") % 3 == 0, "DEQ").otherwise("ENQ")))


@_query(f"WITH {VALID} SELECT channel AS pool, count(*) AS n FROM val WHERE channel <> 'fax' GROUP BY channel")
def route_dispatch(spark, sf_dir):
    routed, _ = delivery.route(traces.submissions(spark, sf_dir), CHANNELS)
    return routed.groupBy("pool").agg(F.count("*").alias("n"))


@_query(f"WITH {VALID} SELECT seq, channel FROM val WHERE channel = 'fax'")
def route_unroutable(spark, sf_dir):
    _, lost = delivery.route(traces.submissions(spark, sf_dir), CHANNELS)
    return lost.select("seq", "channel")


@_query(f"""WITH {VALID}, x AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 400 + seq % 100 ELSE 200 END AS http FROM val)
SELECT seq, CASE WHEN channel = 'inapp' AND user_id = '' THEN 'user_id required' WHEN channel IN ('email', 'sms', 'push') AND "to" = '' THEN 'recipient required'
  WHEN channel = 'webhook' AND http >= 400 THEN 'webhook returned status ' || http END AS error FROM x""")
def send_errors(spark, sf_dir):
    s = traces.submissions(spark, sf_dir)
    http = F.when(F.col("seq") % 5 == 0, 400 + F.col("seq") % 100).otherwise(200)
    return s.select("seq", delivery.send_error(F.col("channel"), F.col("user_id"), F.col("to"), http).alias("error"))


@_query(f"""WITH {VALID} SELECT seq, '{{"notification_id":"' || id || '","user_id":"' || user_id || '","payload":{{"subject":"' || subject || '","body":' || to_json(body)::VARCHAR || ',"to":"' || "to" || '"}}}}' AS body
FROM val WHERE channel = 'webhook'""")
def webhook_bodies(spark, sf_dir):
    s = traces.submissions(spark, sf_dir).filter("channel = 'webhook'")
    body = delivery.webhook_body(request_id(F.col("seq")), F.col("user_id"), F.col("subject"), F.col("body"), F.col("to"))
    return s.select("seq", body.alias("body"))


def _failing(spark, sf_dir):
    """Each event as a notification that fails 0 to 6 times, hashed from its id."""
    e = traces.events(spark, sf_dir)
    return e.select(F.col("seq").alias("id"), "t", F.floor(uniform(F.lit("fail"), F.col("seq")) * 7).cast("int").alias("failures"))


FAIL = f"{EV}, fl AS (SELECT seq AS id, t, floor(('0x' || substr(sha256('fail:' || seq), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 7)::INT AS failures FROM ev)"
SCHED = f"""{FAIL}, sc AS (SELECT id, t, k::INT AS attempt, least(1.0::DOUBLE * pow(2.0::DOUBLE, k), 60.0::DOUBLE) AS cap, ('0x' || substr(sha256(id || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM fl, range(1, 6) r(k) WHERE k <= failures)"""


@_query(f"""WITH {SCHED} SELECT id, attempt, CASE WHEN attempt < 5 THEN cap END AS cap_s, CASE WHEN attempt < 5 THEN CASE WHEN u * cap > 0 THEN u * cap ELSE 1.0 END END AS delay_s,
  CASE WHEN attempt < 5 THEN 'retrying' ELSE 'failed' END AS status FROM sc""")
def retry_schedule(spark, sf_dir):
    return delivery.retry_schedule(_failing(spark, sf_dir), RETRY)


@_query(f"""WITH {SCHED} SELECT count(*) FILTER (attempt < 5 AND t + floor(CASE WHEN u * cap > 0 THEN u * cap ELSE 1.0 END * 1e6)::BIGINT > {MID}) AS pending FROM sc""")
def pending_retries(spark, sf_dir):
    f = _failing(spark, sf_dir)
    due = delivery.retry_schedule(f, RETRY).join(f.select("id", "t"), "id").withColumn("due_us", F.col("t") + F.floor(F.col("delay_s") * 1e6))
    return delivery.pending_retries(due, MID)


@_query(f"""WITH {FAIL} SELECT id, CASE WHEN failures >= 5 THEN 'retrying' ELSE 'delivered' END AS status, least(failures, 5) AS attempts,
  CASE WHEN failures >= 5 THEN 'failed' ELSE 'delivered' END AS effective_status FROM fl""")
def lifecycle_latest(spark, sf_dir):
    return delivery.latest(delivery.transitions(_failing(spark, sf_dir), RETRY), RETRY)


@_query(f"""WITH {FAIL}, x AS (SELECT id, 'pending' AS status FROM fl UNION ALL SELECT id, 'queued' FROM fl UNION ALL SELECT id, 'retrying' FROM fl, range(1, 6) r(k) WHERE k <= failures
  UNION ALL SELECT id, CASE WHEN failures >= 5 THEN 'failed' ELSE 'delivered' END FROM fl) SELECT status, count(*) AS n FROM x GROUP BY status""")
def lifecycle_transitions(spark, sf_dir):
    return delivery.transitions(_failing(spark, sf_dir), RETRY).groupBy("status").agg(F.count("*").alias("n"))


@_query(f"""WITH {EV}, n AS (SELECT seq, user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY t, seq) AS r FROM ev)
SELECT seq, CASE WHEN r = 1 AND id % 10 <> 0 THEN 'saved' ELSE 'already_exists' END AS outcome FROM n""")
def save_if_absent(spark, sf_dir):
    e = traces.events(spark, sf_dir).select(F.col("user_id").alias("id"), "t", "seq")
    return delivery.save_if_absent(e, e.filter("id % 10 = 0")).select("seq", "outcome")


@_query(f"""WITH {VALID}, d AS (SELECT channel, t // {HOUR} AS tick, count(*) AS depth FROM val WHERE channel <> 'fax' GROUP BY ALL)
SELECT channel, tick, depth, least(128, 32 + 16 * sum((depth > 2)::INT) OVER (PARTITION BY channel ORDER BY tick ROWS UNBOUNDED PRECEDING))::BIGINT AS workers FROM d""")
def autoscale_workers(spark, sf_dir):
    s = traces.submissions(spark, sf_dir).filter("channel <> 'fax'")
    depths = s.groupBy("channel", F.floor(F.col("t") / HOUR).alias("tick")).agg(F.count("*").alias("depth"))
    return delivery.autoscale(depths, POOLS).select("channel", "tick", "depth", "workers")


_STATUS = "CASE outcome WHEN 'queued' THEN 202 WHEN 'rate_limited' THEN 429 WHEN 'queue_full' THEN 503 WHEN 'duplicate' THEN 409 WHEN 'invalid' THEN 400 ELSE 500 END"


@_query(f"""WITH RECURSIVE {VALID}, ok AS MATERIALIZED (SELECT * FROM val WHERE invalid_reason IS NULL),
{_bucket_cte('b', 'ok', 'user_id', USER_LIMIT.rate, USER_LIMIT.capacity)}, pass AS MATERIALIZED (SELECT ok.* FROM ok JOIN b ON ok.seq = b.seq WHERE b.ok),
{_bucket_cte('c', 'pass', 'channel', CHANNEL_LIMIT.rate, CHANNEL_LIMIT.capacity)}, adm AS MATERIALIZED (SELECT pass.* FROM pass JOIN c ON pass.seq = c.seq WHERE c.ok),
{_dedup_cte('d', 'adm', 'key', 6 * HOUR)}, fresh AS (SELECT adm.seq, row_number() OVER (PARTITION BY band ORDER BY t, adm.seq) <= [{', '.join(map(str, DELIVERY.bands))}][band + 1] AS q
  FROM adm JOIN d ON adm.seq = d.seq WHERE NOT dup),
o AS (SELECT val.seq, val.id, val.channel, val.band, CASE WHEN invalid_reason IS NOT NULL THEN 'invalid' WHEN NOT b.ok OR NOT c.ok THEN 'rate_limited' WHEN d.dup THEN 'duplicate'
  WHEN fresh.q THEN 'queued' ELSE 'queue_full' END AS outcome
  FROM val LEFT JOIN b ON val.seq = b.seq LEFT JOIN c ON val.seq = c.seq LEFT JOIN d ON val.seq = d.seq LEFT JOIN fresh ON val.seq = fresh.seq)
SELECT seq, id, channel, band, outcome, CASE outcome WHEN 'queued' THEN 'queued' WHEN 'queue_full' THEN 'pending' END AS stored, {_STATUS} AS http_status,
  CASE outcome WHEN 'rate_limited' THEN 1 WHEN 'queue_full' THEN 5 END AS retry_after FROM o""")
def submit_pipeline(spark, sf_dir):
    return submit(traces.submissions(spark, sf_dir), DELIVERY).drop("t")


@_query("SELECT * FROM (VALUES ('not_found', 404), ('invalid_key', 400), ('invalid_ttl', 400), ('wal', 500), (NULL, 200)) v(error, status)")
def cache_statuses(spark, sf_dir):
    rows = spark.createDataFrame([("not_found",), ("invalid_key",), ("invalid_ttl",), ("wal",), (None,)], "error string")
    return rows.select("error", codec.cache_status(F.col("error")).alias("status"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
