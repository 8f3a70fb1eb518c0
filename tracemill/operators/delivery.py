"""Queueing, routing, sending, retrying and status tracking of notifications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.config import PoolConfig, RetryPolicy
from tracemill.functions.hashing import uniform
from tracemill.functions.rank import global_position


def queue_order(backlog: DataFrame, cell_us: int = 3_600_000_000) -> DataFrame:
    """``backlog`` (``band, t, seq``) with ``position``: strictly by band, first come
    first served inside one.  Rows are ranked an hour (``cell_us``) at a time."""
    return global_position(backlog, [F.col("band"), F.floor(F.col("t") / cell_us)], [F.col("t"), F.col("seq")])


def queue_admission(arrivals: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``arrivals`` (``band, t, seq``) with ``queue_ok`` for a queue that nobody empties.

    A band admits its first ``size`` arrivals; only those are sorted, to find the last."""
    last = None
    for band, size in enumerate(sizes):
        head = arrivals.filter(F.col("band") == band).select(F.struct("t", "seq").alias("at")).orderBy("at").limit(size)
        cut = head.agg(F.max("at").alias("_cut")).select(F.lit(band).alias("_band"), "_cut")
        last = cut if last is None else last.unionAll(cut)
    out = arrivals.join(F.broadcast(last), F.col("band") == F.col("_band"), "left")  # one row a band
    ok = F.coalesce(F.struct("t", "seq") <= F.col("_cut"), F.lit(False))
    return out.withColumn("queue_ok", ok).drop("_band", "_cut")


def queue_depth(moves: DataFrame) -> DataFrame:
    """``band, depth`` from moves (``band, op`` ENQ or DEQ)."""
    step = F.when(F.col("op") == "ENQ", 1).when(F.col("op") == "DEQ", -1).otherwise(0)
    return moves.groupBy("band").agg(F.sum(step).cast("long").alias("depth"))


def route(queued: DataFrame, channels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(routed, unroutable) notifications by whether a pool serves their channel."""
    pools = queued.sparkSession.createDataFrame([(c,) for c in channels], "_pool string")
    on = F.col("channel") == F.col("_pool")
    routed = queued.join(F.broadcast(pools), on).withColumnRenamed("_pool", "pool")  # one row a channel
    return routed, queued.join(F.broadcast(pools), on, "left_anti")


def send_error(channel: Column, user: Column, to: Column, http_status: Column) -> Column:
    """Why a send fails, or null: each sink's own rule."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when((channel == "inapp") & empty(user), "user_id required").when(channel.isin("email", "sms", "push") & empty(to), "recipient required")
        .when((channel == "webhook") & (http_status >= 400), F.concat(F.lit("webhook returned status "), http_status.cast("string")))
    )


def webhook_body(notification_id: Column, user: Column, subject: Column, body: Column, to: Column) -> Column:
    """JSON that a webhook posts."""
    payload = F.struct(subject.alias("subject"), body.alias("body"), to.alias("to"))
    return F.to_json(F.struct(notification_id.alias("notification_id"), user.alias("user_id"), payload.alias("payload")))


def retry_schedule(failing: DataFrame, policy: RetryPolicy, failures: str = "failures") -> DataFrame:
    """One row a failed attempt of ``failing`` (``id``, number of ``failures``).

    ``delay_s`` is a uniform share of the attempt's cap, hashed from id and attempt;
    a share of 0 becomes the base delay; the last attempt has no delay and is final."""
    n = F.least(F.col(failures), F.lit(policy.max_attempts)).cast("int")
    rows = failing.filter(n >= 1).select("id", F.explode(F.sequence(F.lit(1), n)).alias("attempt"))
    cap = F.least(F.lit(policy.base_seconds) * F.pow(F.lit(policy.multiplier), F.col("attempt")), F.lit(policy.max_seconds))
    final = F.col("attempt") >= policy.max_attempts
    u = uniform(F.col("id"), F.col("attempt"))
    delay = F.when(u * cap > 0, u * cap).otherwise(F.lit(policy.base_seconds))
    return rows.withColumns({"cap_s": F.when(~final, cap), "delay_s": F.when(~final, delay), "status": F.when(final, "failed").otherwise("retrying")})


def transitions(sent: DataFrame, policy: RetryPolicy, failures: str = "failures") -> DataFrame:
    """Status rows (``id, step, status, attempts``) of notifications that fail
    ``failures`` times before a send succeeds.

    An exhausted notification is written ``failed`` and then ``retrying``."""
    n = F.least(F.col(failures), F.lit(policy.max_attempts)).cast("int")
    state = lambda step, status, attempts: F.struct(F.lit(step).alias("step") if isinstance(step, int) else step.alias("step"), F.lit(status).alias("status"), attempts.cast("int").alias("attempts"))
    begun = F.array(state(0, "pending", F.lit(0)), state(1, "queued", F.lit(0)))
    failed = F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: state(k * 2 + 1, "retrying", k))).otherwise(F.array().cast("array<struct<step:int,status:string,attempts:int>>"))
    spent = F.when(n >= policy.max_attempts, F.array(state(n * 2, "failed", n))).otherwise(F.array(state(n * 2 + 2, "delivered", n)))
    rows = sent.select("id", F.explode(F.concat(begun, failed, spent)).alias("s"))
    return rows.select("id", "s.step", "s.status", "s.attempts")


def latest(changes: DataFrame, policy: RetryPolicy) -> DataFrame:
    """Last status of each id (last writer wins), and what it amounts to."""
    last = changes.groupBy("id").agg(F.max(F.struct("step", "attempts", "status")).alias("l"))
    out = last.select("id", "l.status", "l.attempts")
    spent = (F.col("status") == "retrying") & (F.col("attempts") >= policy.max_attempts)
    return out.withColumn("effective_status", F.when(spent, "failed").otherwise(F.col("status")))


def pending_retries(schedule: DataFrame, now_us: int) -> DataFrame:
    """Number of retries due after ``now_us`` (``due_us``)."""
    return schedule.agg(F.count_if(F.col("due_us") > now_us).alias("pending"))


def save_if_absent(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` (``id, t, seq``) with ``outcome``: the first of an id that is not stored yet
    is saved, every other already exists."""
    seen = stored.select(F.col("id").alias("_id")).distinct()
    first = new.groupBy("id").agg(F.min(F.struct("t", "seq")).alias("_first"))
    out = new.join(first, "id").join(seen, F.col("id") == F.col("_id"), "left")
    ok = F.col("_id").isNull() & (F.struct("t", "seq") == F.col("_first"))
    return out.withColumn("outcome", F.when(ok, "saved").otherwise("already_exists")).drop("_id", "_first")


def autoscale(depths: DataFrame, pools: Mapping[str, PoolConfig], step: int = 16) -> DataFrame:
    """Workers of each pool after each tick (``channel, tick, depth``): more than half
    a full queue adds up to ``step``, and pools never shrink."""
    spark = depths.sparkSession
    table = spark.createDataFrame([(c, p.min_workers, p.max_workers, p.queue_size) for c, p in pools.items()], "_c string, _min int, _max int, _size int")
    d = depths.join(F.broadcast(table), F.col("channel") == F.col("_c"))  # one row a channel
    # integer half, as the service computes it
    flag = (F.col("depth") > F.floor(F.col("_size") / 2)).cast("long")
    w = W.partitionBy("channel").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("workers", F.least(F.col("_max"), F.col("_min") + step * F.sum(flag).over(w)).cast("long")).drop("_c", "_min", "_max", "_size")
