"""The submission pipeline: validate, limit, deduplicate, store, enqueue.

Each stage reads only what the one before let through and nothing flows back, so the
chain of keyed operators is exact.  Rate limits come before deduplication, so
duplicates spend tokens; a request is remembered as seen before it is enqueued, so
after a full queue the same request is a duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.config import CHANNELS, DeliveryConfig
from tracemill.functions.codec import band, retry_after, submit_status
from tracemill.functions.hashing import dedup_key, request_id
from tracemill.functions.tables import materialize
from tracemill.operators.admission import dedup, invalid_reason, limit_chained
from tracemill.operators.delivery import queue_admission


def validated(requests: DataFrame) -> DataFrame:
    """``requests`` with ``invalid_reason`` and ``band``."""
    reason = invalid_reason(F.col("user_id"), F.col("channel"), F.col("to"), F.col("body"), CHANNELS)
    return requests.withColumns({"invalid_reason": reason, "band": band(F.col("priority"))})


def submit(requests: DataFrame, config: DeliveryConfig) -> DataFrame:
    """``seq, t, id, channel, band, outcome, stored, http_status, retry_after`` of each
    request; ``stored`` is the status its record ends with (null: none was made)."""
    v = validated(requests).withColumns({
        "id": request_id(F.col("seq")), "key": dedup_key(F.col("user_id"), F.col("channel"), F.col("to"), F.col("body"), F.col("subject")),
        "valid": F.col("invalid_reason").isNull(),
    }).select("seq", "t", "id", "user_id", "channel", "band", "key", "valid")
    limited = limit_chained(v, "user_id", "channel", config.user_limit, config.channel_limit, active="valid")
    seen = dedup(limited, ["key"], int(config.dedup_seconds * 1e6), active="channel_ok")
    # one evaluation of the chain; queueing reads it several times
    seen = materialize(seen.select("seq", "t", "id", "channel", "band", "valid", "user_ok", "channel_ok", "duplicate"), "admitted")
    early = F.when(~F.col("valid"), "invalid").when(~F.col("user_ok") | ~F.coalesce("channel_ok", F.lit(False)), "rate_limited").when(F.col("duplicate"), "duplicate")
    cols = ["seq", "t", "id", "channel", "band", "outcome"]
    seen = seen.withColumn("outcome", early)
    placed = queue_admission(seen.filter("outcome is null").drop("outcome"), config.bands)
    placed = placed.withColumn("outcome", F.when(F.col("queue_ok"), "queued").otherwise("queue_full"))
    out = seen.filter("outcome is not null").select(*cols).unionByName(placed.select(*cols))
    o = F.col("outcome")
    return out.withColumns({
        "stored": F.when(o == "queued", "queued").when(o == "queue_full", "pending"), "http_status": submit_status(o), "retry_after": retry_after(o),
    })
