"""Field rules of cache entries, requests and responses, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.config import ENTRY_OVERHEAD

#: Padded base64 of whole groups, line ends apart.
_BASE64 = r"\A([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def memory_size(key: Column, value: Column) -> Column:
    """Bytes that an entry is charged."""
    return (F.octet_length(key) + F.octet_length(value) + ENTRY_OVERHEAD).cast("long")


def expiry(at: Column, ttl_ms: Column, per_ms: int = 1_000_000) -> Column:
    """Absolute expiry, in units of which ``per_ms`` are a millisecond; null without TTL."""
    return F.when(ttl_ms > 0, at + ttl_ms * per_ms)


def expired(now: Column, expires: Column) -> Column:
    """An entry is alive at its very expiry and gone after it."""
    return expires.isNotNull() & (now > expires)


def decode_value(text: Column) -> Column:
    """Bytes of a request value: base64 where it is that, the text itself otherwise."""
    flat = F.translate(text, "\r\n", "")
    return F.when(flat.rlike(_BASE64), F.unbase64(flat)).otherwise(text.cast("binary"))


def cache_status(error: Column) -> Column:
    """HTTP status of a cache error (null: none)."""
    return F.when(error.isNull(), 200).when(error == "not_found", 404).when(error.isin("invalid_key", "invalid_ttl"), 400).otherwise(500)


def submit_status(outcome: Column) -> Column:
    """HTTP status of a submission's outcome."""
    return (
        F.when(outcome == "queued", 202).when(outcome == "not_found", 404).when(outcome == "rate_limited", 429).when(outcome == "queue_full", 503)
        .when(outcome == "duplicate", 409).when(outcome == "invalid", 400).otherwise(500)
    )


def retry_after(outcome: Column) -> Column:
    """Seconds of the Retry-After header, where there is one."""
    return F.when(outcome == "rate_limited", 1).when(outcome == "queue_full", 5)


def error_text(message: Column) -> Column:
    """A message without what comes before its first ``": "``."""
    return F.regexp_replace(message, r"(?s)\A.*?: ", "")


def band(priority: Column) -> Column:
    """Queue band of a priority: a missing one is critical, an unknown one low."""
    p = F.coalesce(priority, F.lit(0))
    return F.when(p.isin(0, 1, 2), p).otherwise(3).cast("int")
