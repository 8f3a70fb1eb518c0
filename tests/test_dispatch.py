import random

from tracemill.config import RetryPolicy
from tracemill.operators.cache import CacheShard
from tracemill.operators.dispatch import Dispatcher
from tracemill.sources.requests import PUT_FIELDS, SUBMIT_FIELDS, read_body
from tracemill.streaming import sinks


def test_order_of_bands():
    d = Dispatcher((9, 9, 9, 9), {"email": 9})
    for name, band in (("low", 3), ("normal", 2), ("high", 1), ("critical", 0), ("late", 0)):
        assert d.step("ENQ", name, band, "email")[0] == "queued"
    assert [d.step("DEQ", None, None, None)[1] for _ in range(6)] == ["critical", "late", "high", "normal", "low", None]
    assert [d.step("TAKE", None, None, "email")[1] for _ in range(2)] == ["critical", "late"]


def test_full_and_closed_queues():
    d = Dispatcher((1, 1, 1, 1), {"email": 1})
    assert [d.step("ENQ", n, 0, "email")[0] for n in "ab"] == ["queued", "queue_full"]
    assert d.step("DEQ", None, None, None) == ("submitted", "a", 0)
    assert d.step("ENQ", "b", 0, "email")[0] == "queued"
    # the job queue is full: back to its band, and lost once intake is closed
    assert d.step("DEQ", None, None, None) == ("requeued", "b", 1)
    assert d.step("CLOSE", None, None, None)[0] == "closed" and d.step("ENQ", "c", 1, "email")[0] == "shutting_down"
    assert d.step("DEQ", None, None, None) == ("dropped", "b", 0) and d.step("DEQ", None, None, None)[0] == "empty"
    assert d.step("TAKE", None, None, "email") == ("taken", "a", 0) and d.step("TAKE", None, None, "fax")[0] == "idle"


def test_requeued_goes_behind_its_band():
    d = Dispatcher((3, 3, 3, 3), {"email": 0, "sms": 5})
    for name, channel in (("a", "email"), ("b", "sms"), ("c", "fax")):
        d.step("ENQ", name, 2, channel)
    assert [d.step("DEQ", None, None, None)[:2] for _ in range(4)] == [("requeued", "a"), ("submitted", "b"), ("no_pool", "c"), ("requeued", "a")]


def test_bodies():
    assert read_body('{"user_id":"u","PAYLOAD":{"to":"x","meta":{"a":"b","n":null}},"payload":{"body":"y"},"priority":2}', SUBMIT_FIELDS) == {
        "user_id": "u", "channel": "", "priority": 2, "payload": {"subject": "", "body": "y", "to": "x", "meta": {"a": "b", "n": ""}},
    }
    assert read_body('{"payload":[]}', SUBMIT_FIELDS) is None and read_body('{"payload":{"meta":{"a":1}}}', SUBMIT_FIELDS) is None
    assert read_body('{"value":"\\ud800x"}', PUT_FIELDS)["value"] == "\ufffdx" and read_body("[" * 100_000, PUT_FIELDS) is None
    assert read_body('{"value":NaN}', PUT_FIELDS) is None and read_body(None, PUT_FIELDS) is None


def test_heap_of_expiries_is_bounded_without_sweep():
    s = CacheShard(0, "lru", 4)
    rng = random.Random(1)
    for i in range(10_000):
        s.step("SET", f"k{rng.randint(0, 9)}", 1, 1000, i)
    assert len(s.items) <= 4 and not s.due


def test_sent_batches_as_a_stream(spark, tmp_path):
    rows = [("a", "email", "u", "s", "b", "", 0), ("b", "sms", "u", "s", "b", "1", 0), ("c", "inapp", "", "s", "b", "", 4), ("d", "webhook", "u", "s", "b", "x", 1)]
    schema = "id string, channel string, user_id string, subject string, body string, to string, attempts int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    given = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = sinks.start(given, [sinks.WebhookProvider(), *map(sinks.LogProvider, ("email", "sms", "inapp"))], RetryPolicy(), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {r.id: (r.status, r.attempts, r.last_error, r.retry) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("retrying", 1, "recipient required", True), "b": ("delivered", 0, "", False), "c": ("retrying", 5, "user_id required", False), "d": ("delivered", 1, "", False)}
