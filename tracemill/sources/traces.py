"""Operation traces derived from the ``events`` table.

``ts`` is the clock, in microseconds, and ``event_id`` breaks ties.  Which event
becomes which operation is this engine's choice, so that every rule is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the column has no zone; its wall clock is read as UTC whatever the session's zone is
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return df.withColumn("t", micros.cast("long")).withColumnRenamed("event_id", "seq")


def cache_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, t, op, key, value, ttl_ms``: signups and purchases set, views and clicks
    get, errors delete; the value is a TTL in hours."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), "SET").when(kind == "error", "DELETE").otherwise("GET")
    return events(spark, sf_dir).select(
        "seq", "t", op.alias("op"), F.concat(F.lit("user-"), F.col("user_id")).alias("key"), F.col("props").alias("value"), F.floor(F.col("value") * 3_600_000).cast("long").alias("ttl_ms")
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, t, user_id, channel, priority, subject, body, to``, some of them invalid."""
    e = events(spark, sf_dir)
    every = lambda n, value, other: F.when(F.col("seq") % n == 0, value).otherwise(other)
    kind = F.col("event_type")
    channel = F.when(kind == "signup", "email").when(kind == "purchase", "sms").when(kind == "view", "push").when(kind == "click", "webhook").otherwise("inapp")
    priority = F.when(F.col("seq") % 13 == 0, F.lit(None).cast("int")).when(F.col("seq") % 31 == 0, 9).otherwise((F.col("seq") % 4).cast("int"))
    return e.select(
        "seq", "t", every(97, "", F.concat(F.lit("user-"), F.col("user_id"))).alias("user_id"), every(89, "fax", channel).alias("channel"), priority.alias("priority"),
        kind.alias("subject"), every(79, "", F.col("props")).alias("body"), every(83, "", F.concat(F.lit("to-"), F.col("user_id"))).alias("to"),
    )
