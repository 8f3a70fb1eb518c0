import pytest
from pyspark.sql import functions as F

from tracemill.config import CacheConfig
from tracemill.sources import wal
from tracemill.sources.wal import Record, decode, encode

ROWS = "seq long, op tinyint, key string, value binary, expires_ns long"


def test_bytes():
    assert encode(Record(1, "k", b"v", 0)).hex() == "150000000101006b01000000760000000000000000717ceb7d"
    assert encode(Record(1, "k", b"v")).hex() == "150000000101006b010000007600001a3deb03b2a19f060df2"
    assert list(decode(encode(Record(1, "k", b"v", 0)))) == [Record(1, "k", b"v", None)]
    with pytest.raises(ValueError):
        encode(Record(1, "k" * 65_536))


def test_round_trip_and_damage():
    records = [Record(1, "key1", b"x" * (1 << 20), 5), Record(1, "kéy2", b""), Record(2, "key1")]
    log = b"".join(map(encode, records))
    assert list(decode(log)) == records
    assert list(decode(b"")) == []
    one = bytearray(encode(records[1]))
    one[-1] ^= 1
    assert list(decode(bytes(one))) == []
    # nothing behind a bad record is read, nor a torn tail
    assert list(decode(encode(records[2]) + bytes(one) + log)) == [records[2]]
    assert list(decode(log[:-3])) == records[:2]
    assert list(decode(b"\xff\xff\xff\xff" + log)) == []


def test_files_and_frames(spark, tmp_path):
    rows = [(0, 1, "a", bytearray(b"v1"), 9), (1, 1, "b", bytearray(b""), None), (2, 2, "a", bytearray(b""), None)]
    (tmp_path / "x.wal").write_bytes(b"".join(encode(Record(r[1], r[2], bytes(r[3]), r[4])) for r in rows))
    got = wal.read_log(spark, str(tmp_path / "x.wal")).orderBy("seq").drop("path").collect()
    assert [tuple(r) for r in got] == rows
    df = spark.createDataFrame(rows, ROWS)
    assert [bytes(r.frame) for r in wal.encode_rows(df).orderBy("seq").collect()] == [encode(Record(r[1], r[2], bytes(r[3]), r[4])) for r in rows]


def test_log_is_written_appended_and_truncated(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, 1 + i % 2, f"key{i}", bytearray(b"\x00" * (i % 3) + bytes([i % 256])), None if i % 4 else i) for i in range(1, 900)]
    big = [(900, 1, "big", bytearray(b"v" * (3 << 20)), 7), (901, 1, "k" * 65_536, bytearray(b"v"), 7), (902, 2, "end", bytearray(b""), None)]
    df = spark.createDataFrame(rows + big, ROWS).repartition(5)
    assert sorted(r.seq for r in wal.encode_rows(df).filter("outcome = 'invalid_key'").collect()) == [901]
    wal.write_log(df.filter("seq < 500"), path)
    wal.write_log(df.filter("seq >= 500"), path)
    back = wal.in_order(wal.read_log(spark, path)).orderBy("seq").collect()
    assert [(r.seq, r.op, r.key, r.value, r.expires_ns) for r in back] == [(i, *r[1:]) for i, r in enumerate(rows + [big[0], big[2]])]
    wal.write_log(df.filter("seq < 3"), path, append=False)
    assert wal.read_log(spark, path).count() == 2
    wal.truncate_log(spark, path)
    assert wal.read_log(spark, path).count() == 0


def test_good_prefix(spark):
    df = spark.createDataFrame([("p", 0, False), ("p", 1, True), ("p", 2, False), ("q", 0, False)], "path string, seq long, bad boolean")
    assert sorted((r.path, r.seq) for r in wal.good_prefix(df).collect()) == [("p", 0), ("q", 0)]


def test_expired_overwrite_brings_back_the_older_value(spark):
    rows = [(0, 1, "k", bytearray(b"v1"), None), (1, 1, "k", bytearray(b"v2"), 10), (2, 1, "d", bytearray(b"x"), None), (3, 2, "d", bytearray(b""), None), (4, 1, "e", bytearray(b"x"), 11)]
    df = spark.createDataFrame(rows, ROWS)
    assert {r.key: bytes(r.value) for r in wal.recover(df, 11).collect()} == {"k": b"v1", "e": b"x"}
    assert {r.key: bytes(r.value) for r in wal.recover(df, 10).collect()} == {"k": b"v2", "e": b"x"}


def test_bounded_replay_counts_repeats_again(spark):
    rows = [(0, 1, "k", bytearray(b"v"), None), (1, 1, "k", bytearray(b"v"), None), (2, 1, "l", bytearray(b"v"), None), (3, 1, "m", bytearray(b"v"), None)]
    out = wal.recover_bounded(spark.createDataFrame(rows, ROWS), CacheConfig(2, shard_count=1, virtual_nodes=2), 0)
    got = out.agg(F.sum("d_entries").alias("n"), F.collect_list("evicted").alias("e")).first()
    assert got.n == 3 and got.e == ["k"]  # two are held
