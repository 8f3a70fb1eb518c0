from pyspark.sql import functions as F

from tracemill.config import CHANNELS, DeliveryConfig, PoolConfig, RateLimit, RetryPolicy
from tracemill.functions import codec
from tracemill.functions.hashing import dedup_key
from tracemill.operators import admission, delivery
from tracemill.operators.admission import TokenBucket, TtlDedup
from tracemill.plans.submit import submit

S = 1_000_000


def test_token_bucket():
    b = TokenBucket(1.0, 2.0)
    assert [b.step(0)[0] for _ in range(3)] == [True, True, False]
    assert b.step(S // 2)[0] is False  # a denied call refills too
    assert b.step(S)[0] is True
    assert [b.step(100 * S)[0] for _ in range(3)] == [True, True, False]  # never above capacity


def test_dedup_window_hangs_on_the_accepted_call():
    d = TtlDedup(10)
    assert [d.step(t)[0] for t in (0, 9, 10, 19, 20)] == [False, True, False, True, False]


def test_chained_limits(spark):
    rows = [(i, 0, "u", "c") for i in range(3)] + [(3, 0, "v", "c"), (4, 0, "w", "c")]
    df = spark.createDataFrame(rows, "seq long, t long, u string, c string")
    out = {r.seq: (r.user_ok, r.channel_ok) for r in admission.limit_chained(df, "u", "c", RateLimit(0, 2), RateLimit(0, 3)).collect()}
    assert out == {0: (True, True), 1: (True, True), 2: (False, None), 3: (True, True), 4: (True, False)}


def test_dedup_key_vector(spark):
    df = spark.createDataFrame([("u1", "email", "a@b.com", "hello", ""), ("ab", "c", "", "", ""), ("a", "bc", "", "", "")], "a string, b string, c string, d string, e string")
    cols = [F.col(c) for c in "abcde"]
    keys = [r[0] for r in df.select(dedup_key(*cols)).collect()]
    assert keys[0] == "2b5ac772e7a70171337a6e213a11daedc97111bde54999c2aca4d2018176e8bf" and keys[1] == keys[2]
    apart = [r[0] for r in df.select(dedup_key(*cols, delimiter="|")).collect()]
    assert apart[1] != apart[2]


SUB = "seq long, t long, user_id string, channel string, priority int, subject string, body string, to string"


def outcomes(spark, rows, **options):
    got = submit(spark.createDataFrame(rows, SUB), DeliveryConfig(**options)).collect()
    return {r.seq: r for r in got}


def test_submit_rules(spark):
    rows = [
        (0, 0, "", "fax", 0, "", "", ""), (1, 0, "u", "fax", 0, "", "b", "t"), (2, 0, "u", "email", 0, "", "b", ""), (3, 0, "u", "inapp", 0, "", "b", ""),
        (4, 0, "u", "email", 0, "", "", "t"), (5, 0, "u", "email", None, "s", "b", "t"), (6, 1, "u", "email", 7, "s", "b", "t"), (7, 301 * S, "u", "email", 7, "s", "b", "t"), (8, 0, None, None, None, None, None, None),
    ]
    got = outcomes(spark, rows)
    assert {k: r.outcome for k, r in got.items()} == {0: "invalid", 1: "invalid", 2: "invalid", 3: "queued", 4: "invalid", 5: "queued", 6: "duplicate", 7: "queued", 8: "invalid"}
    assert got[5].band == 0 and got[7].band == 3 and got[6].http_status == 409 and got[5].http_status == 202


def test_full_queue_then_duplicate(spark):
    rows = [(0, 0, "u", "email", 0, "", "a", "t"), (1, 1, "u", "email", 0, "", "b", "t"), (2, 2, "u", "email", 0, "", "b", "t")]
    got = outcomes(spark, rows, bands=(1, 1, 1, 1))
    assert [got[i].outcome for i in range(3)] == ["queued", "queue_full", "duplicate"]
    assert got[1].stored == "pending" and got[1].retry_after == 5 and got[1].http_status == 503


def test_duplicates_spend_tokens(spark):
    rows = [(i, i, "u", "email", 0, "", "same" if i < 2 else "new", "t") for i in range(3)]
    got = outcomes(spark, rows, user_limit=RateLimit(0, 2))
    assert [got[i].outcome for i in range(3)] == ["queued", "duplicate", "rate_limited"]


def test_empty_submissions(spark):
    assert outcomes(spark, []) == {}


def test_queue_order_and_depth(spark):
    df = spark.createDataFrame([(0, 5, 3), (1, 1, 0), (2, 0, 0), (3, 9, 1)], "seq long, t long, band int")
    assert [r.seq for r in delivery.queue_order(df, cell_us=2).orderBy("position").collect()] == [2, 1, 3, 0]
    moves = spark.createDataFrame([(0, "ENQ"), (0, "ENQ"), (0, "DEQ"), (1, "ENQ"), (1, "CLOSE")], "band int, op string")
    assert {r.band: r.depth for r in delivery.queue_depth(moves).collect()} == {0: 1, 1: 1}


def test_retries_and_status(spark):
    policy = RetryPolicy()
    assert [policy.cap(i) for i in (1, 2, 3, 4, 9)] == [2, 4, 8, 16, 60]
    df = spark.createDataFrame([(1, 0), (2, 2), (3, 5), (4, 9)], "id long, failures int")
    plan = delivery.retry_schedule(df, policy).collect()
    assert sorted((r.id, r.attempt) for r in plan) == [(2, 1), (2, 2), *[(3, i) for i in range(1, 6)], *[(4, i) for i in range(1, 6)]]
    assert all(0 < r.delay_s <= r.cap_s for r in plan if r.status == "retrying")
    last = {r.id: (r.status, r.attempts, r.effective_status) for r in delivery.latest(delivery.transitions(df, policy), policy).collect()}
    # an exhausted notification is written failed, then retrying
    assert last == {1: ("delivered", 0, "delivered"), 2: ("delivered", 2, "delivered"), 3: ("retrying", 5, "failed"), 4: ("retrying", 5, "failed")}


def test_autoscale_against_a_loop(spark):
    pools = {"email": PoolConfig(2, 40, 5)}
    depths = [0, 3, 2, 9, 9, 0, 9]
    got = delivery.autoscale(spark.createDataFrame([("email", i, d) for i, d in enumerate(depths)], "channel string, tick long, depth long"), pools).orderBy("tick").collect()
    workers, want = 2, []
    for d in depths:
        if d > 5 // 2 and workers < 40:
            workers += min(40 - workers, 16)
        want.append(workers)
    assert [r.workers for r in got] == want


def test_store_route_send(spark):
    new = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 3)], "id string, t long, seq long")
    got = {r.seq: r.outcome for r in delivery.save_if_absent(new, spark.createDataFrame([("b",)], "id string")).collect()}
    assert got == {1: "saved", 2: "already_exists", 3: "already_exists"}
    routed, lost = delivery.route(spark.createDataFrame([("email",), ("fax",), (None,)], "channel string"), CHANNELS)
    assert routed.count() == 1 and lost.count() == 2
    errors = spark.createDataFrame([("inapp", "", "", 200), ("sms", "u", "", 200), ("webhook", "u", "t", 400), ("webhook", "u", "", 399), ("email", "u", "t", 500)], "c string, u string, t string, h int")
    assert [r[0] for r in errors.select(delivery.send_error(F.col("c"), F.col("u"), F.col("t"), F.col("h"))).collect()] == ["user_id required", "recipient required", "webhook returned status 400", None, None]


def test_codec(spark):
    df = spark.createDataFrame([("aGVsbG8=",), ("eA",), ("test",), ("a\r\nGVsbG8=",), ("",), ("a b=",)], "v string")
    assert [bytes(r[0]) for r in df.select(codec.decode_value(F.col("v"))).collect()] == [b"hello", b"eA", b"\xb5\xeb-", b"hello", b"", b"a b="]
    df = spark.createDataFrame([("invalid input: a: b",), ("plain",), ("x: ",)], "m string")
    assert [r[0] for r in df.select(codec.error_text(F.col("m"))).collect()] == ["a: b", "plain", ""]
