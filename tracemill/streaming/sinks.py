"""Delivery sinks: providers that send the notifications of a batch, and the stream that
drives them.  Nothing leaves the cluster unless a provider is given a way to send."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import RetryPolicy
from tracemill.operators.delivery import send_error, webhook_body


class Provider(Protocol):
    """Serves one channel: ``send`` adds ``error`` (null: delivered) to its notifications
    (``id, user_id, subject, body, to, attempts``)."""

    channel: str

    def send(self, notifications: DataFrame) -> DataFrame: ...


class LogProvider:
    """E-mail, SMS, push and in-app: only the recipient is checked."""

    def __init__(self, channel: str):
        self.channel = channel

    def send(self, notifications: DataFrame) -> DataFrame:
        return notifications.withColumn("error", send_error(F.lit(self.channel), F.col("user_id"), F.col("to"), F.lit(None).cast("int")))


class WebhookProvider:
    """Posts JSON bodies.  ``post(url, body)`` gives the HTTP status as a column: an Arrow
    UDF, say; by default nothing is posted and every status is 200."""

    channel = "webhook"

    def __init__(self, post: Callable[[Column, Column], Column] | None = None):
        self.post = post or (lambda url, body: F.lit(200))

    def send(self, notifications: DataFrame) -> DataFrame:
        body = webhook_body(F.col("id"), F.col("user_id"), F.col("subject"), F.col("body"), F.col("to"))
        sent = notifications.withColumn("_status", self.post(F.col("to"), body).cast("int"))
        return sent.withColumn("error", send_error(F.lit("webhook"), F.col("user_id"), F.col("to"), F.col("_status"))).drop("_status")


def deliver(batch: DataFrame, providers: Sequence[Provider], policy: RetryPolicy) -> DataFrame:
    """``id, channel, status, attempts, last_error, retry`` after one send of each
    notification whose channel has a provider.

    A failed one counts an attempt and ends ``retrying``; ``retry`` tells whether it will be
    sent again."""
    out = None
    for p in providers:
        sent = p.send(batch.filter(F.col("channel") == p.channel))
        failed = F.col("error").isNotNull()
        attempts = F.col("attempts") + failed.cast("int")
        one = sent.select("id", "channel", F.when(failed, "retrying").otherwise("delivered").alias("status"), attempts.alias("attempts"),
                          F.coalesce("error", F.lit("")).alias("last_error"), (failed & (attempts < policy.max_attempts)).alias("retry"))
        out = one if out is None else out.unionAll(one)
    return out


def start(notifications: DataFrame, providers: Sequence[Provider], policy: RetryPolicy, path: str, checkpoint: str):
    """Send each micro-batch and write its outcomes under ``path``, a folder a batch, so a
    repeated batch replaces its own.  Returns the started query."""

    def send(batch: DataFrame, batch_id: int) -> None:
        deliver(batch, providers, policy).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return notifications.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
