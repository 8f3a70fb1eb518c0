"""Hashes and identifiers, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc32_bytes(col: Column) -> Column:
    """CRC-32 (IEEE) of a string or binary column."""
    return F.crc32(col.cast("binary"))


def little_endian_32(col: Column) -> Column:
    """Four bytes of an unsigned 32-bit number, lowest first."""
    h = F.lpad(F.hex(col), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def ring_hash(key: Column) -> Column:
    """Place of a key on the ring: the checksum of its checksum and itself."""
    data = key.cast("binary")
    return F.crc32(F.concat(little_endian_32(F.crc32(data)), data))


def dedup_key(user: Column, channel: Column, to: Column, body: Column, subject: Column, delimiter: str = "") -> Column:
    """SHA-256 of a request's fields without separators, so neighbouring fields can
    collide; a ``delimiter`` tells them apart."""
    fields = [F.coalesce(c, F.lit("")) for c in (user, channel, to, body, subject)]
    return F.sha2(F.concat_ws(delimiter, *fields), 256)


def request_id(seed: Column) -> Column:
    """Stable identifier of a request: ``notif_`` and 16 bytes in hex."""
    return F.concat(F.lit("notif_"), F.substring(F.sha2(seed.cast("string"), 256), 1, 32))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts, the same in every run."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
