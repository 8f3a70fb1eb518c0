"""Deduplication and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import RateLimit
from tracemill.functions.fold import sorted_fold


class TtlDedup:
    """A call is a duplicate while an accepted one is less than ``ttl`` old.

    The window hangs on the accepted call: duplicates do not lengthen it."""

    def __init__(self, ttl: int):
        self.ttl = ttl
        self.until: int | None = None

    def step(self, at: int):
        if self.until is not None and at < self.until:
            return (True,)
        self.until = at + self.ttl
        return (False,)


class TokenBucket:
    """Starts full; each call refills by the time since the last one, denied or not."""

    def __init__(self, rate: float, capacity: float):
        self.rate, self.capacity = rate, capacity
        self.tokens = capacity
        self.last: int | None = None

    def step(self, at: int):
        if self.last is not None:
            self.tokens = min(self.capacity, self.tokens + ((at - self.last) / 1e6) * self.rate)
        self.last = at
        if self.tokens >= 1:
            self.tokens -= 1
            return (True,)
        return (False,)


def dedup(df: DataFrame, keys: list[str], ttl_us: int, t: str = "t", order: str = "seq", active: str | None = None) -> DataFrame:
    """``df`` with ``duplicate``; time in microseconds, ties by ``order``.  Only rows
    whose column ``active`` is true are calls (default: all)."""
    return sorted_fold(df, keys, [t, order], [t], lambda *_: TtlDedup(ttl_us), "duplicate boolean", active)


def limit(df: DataFrame, keys: list[str], bucket: RateLimit, name: str = "allowed", t: str = "t", order: str = "seq", active: str | None = None) -> DataFrame:
    """``df`` with the verdict of one token bucket a key.  Only rows whose column
    ``active`` is true are calls (default: all)."""
    rate, capacity = bucket.rate, bucket.capacity
    return sorted_fold(df, keys, [t, order], [t], lambda *_: TokenBucket(rate, capacity), f"{name} boolean", active)


def limit_chained(df: DataFrame, user: str, channel: str, user_limit: RateLimit, channel_limit: RateLimit, active: str | None = None) -> DataFrame:
    """``df`` with ``user_ok`` and ``channel_ok`` (null where the user's bucket denied).

    The channel's bucket sees only what the user's let through, and a user's token is
    spent even where the channel then denies."""
    first = limit(df, [user], user_limit, "user_ok", active=active)
    return limit(first, [channel], channel_limit, "channel_ok", active="user_ok")


def invalid_reason(user: Column, channel: Column, to: Column, body: Column, channels: tuple[str, ...]) -> Column:
    """The first rule that a request breaks, or null."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(empty(user), "user_id is required").when(~F.coalesce(channel.isin(*channels), F.lit(False)), F.concat(F.lit('invalid channel "'), F.coalesce(channel, F.lit("")), F.lit('"')))
        .when(empty(to) & (channel != "inapp"), F.concat(F.lit("payload.to is required for channel "), channel)).when(empty(body), "payload.body is required")
    )
