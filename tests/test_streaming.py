from tracemill.config import CacheConfig, RateLimit, RetryPolicy
from tracemill.operators import admission, cache, delivery
from tracemill.sources import requests, traces
from tracemill.streaming import stateful

SF = "/root/testdata/sf0.001"


def drain(spark, frame, name, tmp_path):
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def in_batches(spark, df, tmp_path, name):
    """The rows as a stream of four batches that follow each other in time."""
    path = str(tmp_path / f"{name}-in")
    rows = df.orderBy("t", "seq").collect()
    n = -(-len(rows) // 4)
    for i in range(4):
        spark.createDataFrame(rows[i * n : (i + 1) * n], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_equal_batches(spark, tmp_path):
    stateful.configure(spark)
    e = traces.events(spark, SF).select("seq", "t", "user_id", "event_type").filter("seq < 400")
    s = in_batches(spark, e, tmp_path, "ev")
    ttl = 6 * 3_600_000_000
    assert drain(spark, stateful.dedup(s, ["user_id", "event_type"], ttl), "dedup", tmp_path) == sorted(map(tuple, admission.dedup(e, ["user_id", "event_type"], ttl).collect()), key=str)
    limit = RateLimit(0.00002, 2.0)
    assert drain(spark, stateful.limit(s, ["user_id"], limit), "bucket", tmp_path) == sorted(map(tuple, admission.limit(e, ["user_id"], limit).collect()), key=str)
    ops = traces.cache_ops(spark, SF).filter("seq < 400")
    config = CacheConfig(max_entries=8, shard_count=2, virtual_nodes=8, eviction_policy="lfu")
    got = drain(spark, stateful.replay(in_batches(spark, ops, tmp_path, "ops"), config, 0), "cache", tmp_path)
    assert got == sorted(map(tuple, cache.replay(ops, config, 0).collect()), key=str)


def test_latest_status_table(spark, tmp_path):
    schema = "id long, step int, status string, attempts int"
    path = str(tmp_path / "changes")
    for rows in ([(1, 0, "pending", 0), (2, 0, "pending", 0)], [(1, 1, "queued", 0)], [(1, 4, "delivered", 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = stateful.upsert_latest(changes, str(tmp_path / "table"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {r.id: r.status for r in stateful.read_latest(spark, str(tmp_path / "table")).collect()}
    assert got == {1: "delivered", 2: "pending"}
    # what a batch does not touch is not written again, and old versions go
    versions = stateful._versions(spark, str(tmp_path / "table"))
    assert sorted(map(len, versions.values())) == [1, 2] and stateful.read_latest(spark, str(tmp_path / "none")).count() == 0


def test_dedup_state_ends(spark, tmp_path):
    stateful.configure(spark)
    second = 1_000_000
    rows = [(i, (1000 + i) * second, f"k{i // 2}") for i in range(40)]
    s = in_batches(spark, spark.createDataFrame(rows, "seq long, t long, key string"), tmp_path, "ttl")
    q = stateful.dedup_expiring(s, ["key"], 5 * second).writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "ttl")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.seq, r.duplicate) for r in spark.table("ttl").collect()} == {(i, i % 2 == 1) for i, _, _ in rows}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    # twenty keys came, but those whose window is over are gone
    assert held[-1] <= 3 * 8


def test_retries_come_back_when_due(spark, tmp_path):
    stateful.configure(spark)
    second = 1_000_000
    policy = RetryPolicy(max_attempts=3, base_seconds=1.0, max_seconds=4.0)
    rows = [(i, 1 + i % 3, (1000 + i) * second) for i in range(20)] + [(100 + i, 3, (1060 + i) * second) for i in range(20)]
    s = in_batches(spark, spark.createDataFrame([(i, t, i, a) for i, a, t in rows], "seq long, t long, id long, attempt int"), tmp_path, "retry")
    got = drain(spark, stateful.retries(s.select("id", "attempt", "t"), policy), "retry", tmp_path)
    schedule = {(r.id, r.attempt): r.delay_s for r in delivery.retry_schedule(spark.createDataFrame([(i, 3) for i, _, _ in rows], "id long, failures int"), policy).collect()}
    want = [(i, a, -(-(t + int(schedule[i, a] * 1e6)) // 1000)) for i, a, t in rows if a < 3]
    assert got == sorted(want, key=str)


def test_bodies_come_as_a_stream(spark, tmp_path):
    bodies = ['{"value":"aGk=","ttl_ms":5}', '{"value":5}', "null", '{"Value":"x"}', "{", None, '{"user_id":"u","channel":"sms","payload":{"to":"1","meta":{"a":null}}}']
    df = spark.createDataFrame([(i, i, f"k{i}", b) for i, b in enumerate(bodies)], "seq long, t long, key string, body string")
    puts = lambda rows: requests.put_requests(rows).select("seq", "key", "value", "ttl_ms", "error")
    subs = lambda rows: requests.submissions(rows).selectExpr("seq", "user_id", "channel", "to", "to_json(meta) as meta", "error")
    for name, read in (("puts", puts), ("subs", subs)):
        got = drain(spark, read(in_batches(spark, df, tmp_path, name)), name, tmp_path)
        assert got == sorted(map(tuple, read(df).collect()), key=str) and len(got) == len(bodies)
