"""Settings of the engine, with their defaults and checks."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Fixed values.
PRIORITIES = ("critical", "high", "normal", "low")
CHANNELS = ("email", "sms", "push", "webhook", "inapp")
STATUSES = ("pending", "queued", "dispatched", "delivered", "failed", "retrying")
POLICIES = ("lru", "lfu", "fifo")
#: Bytes that an entry takes besides its key and value.
ENTRY_OVERHEAD = 128
MAX_KEY_BYTES = 65_535


@dataclass(frozen=True)
class CacheConfig:
    max_entries: int = 100_000
    max_memory_bytes: int = 256 << 20  # declared, not enforced
    eviction_policy: str = "lru"
    shard_count: int = 64
    virtual_nodes: int = 128
    wal_enabled: bool = True
    wal_path: str = "cache.wal"
    sweep: bool = True

    def __post_init__(self):
        if self.shard_count < 1 or self.virtual_nodes < 1:
            raise ValueError("shard_count and virtual_nodes must be positive")

    @property
    def policy(self) -> str:
        """An unknown policy means LRU."""
        return self.eviction_policy if self.eviction_policy in POLICIES else "lru"

    @property
    def shard_capacity(self) -> int:
        """Capacity is a cap per shard, so uneven keys evict early."""
        return max(1, self.max_entries // self.shard_count)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "CACHE_") -> CacheConfig:
        """Settings from ``CACHE_MAX_ENTRIES`` and so on; what is no number keeps its default."""
        env = os.environ if env is None else env
        found = {}
        for name, kind in (("max_entries", int), ("max_memory_bytes", int), ("eviction_policy", str), ("shard_count", int), ("virtual_nodes", int), ("wal_path", str)):
            raw = env.get(prefix + name.upper())
            if raw:
                try:
                    found[name] = kind(raw)
                except ValueError:
                    pass
        if (raw := env.get(prefix + "WAL_ENABLED")) is not None:
            found["wal_enabled"] = raw.lower() in ("1", "t", "true")
        return cls(**found)


@dataclass(frozen=True)
class RateLimit:
    """Tokens a second, and the most a bucket holds."""

    rate: float = 100.0
    capacity: float = 200.0


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 5
    base_seconds: float = 1.0
    max_seconds: float = 60.0
    multiplier: float = 2.0

    def cap(self, attempt: int) -> float:
        """Largest delay in seconds after the given failed attempt."""
        return min(self.base_seconds * self.multiplier**attempt, self.max_seconds)


@dataclass(frozen=True)
class PoolConfig:
    min_workers: int
    max_workers: int
    queue_size: int = 1000


@dataclass(frozen=True)
class ProviderConfig:
    """What providers are reached by.  The log-only ones carry theirs without using it."""

    listen_addr: str = ":8080"
    smtp_host: str = "localhost"
    smtp_port: int = 587
    smtp_from: str = "noreply@example.com"
    sms_api_key: str = ""
    sms_from: str = "+10000000000"
    push_server_key: str = ""
    push_project_id: str = ""
    webhook_timeout_s: float = 10.0

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ProviderConfig:
        """Settings from ``SMTP_HOST`` and so on; an empty one keeps its default.  Port and
        timeout are not read from the environment."""
        env = os.environ if env is None else env
        names = ("listen_addr", "smtp_host", "smtp_from", "sms_api_key", "sms_from", "push_server_key", "push_project_id")
        return cls(**{name: env[name.upper()] for name in names if env.get(name.upper())})


@dataclass(frozen=True)
class DeliveryConfig:
    dedup_seconds: float = 300.0
    user_limit: RateLimit = RateLimit()
    channel_limit: RateLimit = RateLimit()
    #: Sizes of the bands critical, high, normal, low.
    bands: tuple[int, int, int, int] = (10_000, 50_000, 100_000, 50_000)
    retry: RetryPolicy = RetryPolicy()
    pools: Mapping[str, PoolConfig] = field(default_factory=lambda: {
        "email": PoolConfig(64, 512), "sms": PoolConfig(32, 256), "push": PoolConfig(128, 1024),
        "webhook": PoolConfig(32, 256), "inapp": PoolConfig(64, 512),
    })
