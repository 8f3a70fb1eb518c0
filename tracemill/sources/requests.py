"""JSON requests and responses.

Bodies are read by the rules of a typed decoder, which schema inference does not have, so
they pass through an Arrow function; everything else is expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.codec import cache_status, decode_value

_LONE = re.compile("[\ud800-\udfff]")
_SPACE = re.compile(r"[ \t\n\r]*")
_PAYLOAD = {"subject": str, "body": str, "to": str, "meta": Mapping}
PUT_FIELDS = {"value": str, "ttl_ms": int}
SUBMIT_FIELDS = {"user_id": str, "channel": str, "priority": int, "payload": _PAYLOAD}
_ZERO = {str: "", int: 0, Mapping: None}


def _refuse(text: str):
    raise ValueError(text)


class _Pairs(list):
    """The pairs of an object, which tell it from an array."""


_DECODER = json.JSONDecoder(object_pairs_hook=_Pairs, parse_constant=_refuse)


def _filled(pairs: list, fields: Mapping) -> dict:
    """Values of ``fields`` from the pairs of an object: names match in any case, of several
    the last counts, null leaves a field as it is, other names are ignored."""
    out = {name: _filled([], kind) if isinstance(kind, dict) else _ZERO[kind] for name, kind in fields.items()}
    for key, value in pairs:
        name = key if key in fields else key.lower()
        kind = fields.get(name)
        if kind is None or value is None:
            continue
        if kind is str and isinstance(value, str):
            out[name] = _LONE.sub("\ufffd", value)
        elif kind is int and type(value) is int and -(1 << 63) <= value < 1 << 63:
            out[name] = value
        elif kind is Mapping and isinstance(value, _Pairs) and all(v is None or isinstance(v, str) for _, v in value):
            out[name] = (out[name] or {}) | {_LONE.sub("\ufffd", k): _LONE.sub("\ufffd", v or "") for k, v in value}
        elif isinstance(kind, dict) and isinstance(value, _Pairs):
            # an object given twice fills the same fields
            had, new = out[name], _filled(value, kind)
            given = {k if k in kind else k.lower() for k, v in value if v is not None}
            out[name] = {k: new[k] if k in given else had[k] for k in kind}
        else:
            raise ValueError(f"{name}: wrong type")
    return out


def read_body(text: str | None, fields: Mapping) -> dict | None:
    """The fields of a request body, or None if it is none.

    Only the first JSON value of a body is read; ``null`` is a request without fields; a field
    of another type, a whole number beyond 64 bits and a fraction for a whole number are errors."""
    try:
        text = text or ""
        at = _SPACE.match(text).end()
        value, _ = _DECODER.raw_decode(text, at)
        if value is None:
            return _filled([], fields)
        if text[at] != "{":
            raise ValueError("no object")
        return _filled(value, fields)
    except (ValueError, RecursionError):
        return None


def put_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` (``key`` and a JSON ``body``) with ``value`` bytes, ``ttl_ms`` and ``error``
    (``invalid JSON body`` or null).  Missing fields are empty and 0."""

    @F.udf("struct<value: string, ttl_ms: long>", useArrow=True)
    def read(text):
        return read_body(text, PUT_FIELDS)

    out = df.withColumn("_r", read(F.col(body)))
    bad = F.col("_r").isNull()
    return out.withColumns({"error": F.when(bad, "invalid JSON body"), "value": F.when(~bad, decode_value(F.col("_r.value"))), "ttl_ms": F.col("_r.ttl_ms")}).drop("_r")


def submissions(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with the fields of a submission and ``error``.  Missing fields are empty; a
    missing priority is 0, which is critical."""

    @F.udf("struct<user_id: string, channel: string, priority: long, payload: struct<subject: string, body: string, to: string, meta: map<string, string>>>", useArrow=True)
    def read(text):
        return read_body(text, SUBMIT_FIELDS)

    out = df.withColumn("_r", read(F.col(body)))
    return out.withColumns({
        "error": F.when(F.col("_r").isNull(), "invalid JSON body"), "user_id": F.col("_r.user_id"), "channel": F.col("_r.channel"), "priority": F.col("_r.priority"),
        "subject": F.col("_r.payload.subject"), "body_text": F.col("_r.payload.body"), "to": F.col("_r.payload.to"), "meta": F.col("_r.payload.meta"),
    }).drop("_r")


def _error(message: Column) -> Column:
    return F.to_json(F.struct(message.alias("error")))


def put_responses(writes: DataFrame) -> DataFrame:
    """``writes`` (``key, error``: why a SET was refused, or null) with ``status`` and ``response``."""
    ok = F.to_json(F.struct("key", F.lit(True).alias("stored")))
    message = F.when(F.col("error") == "invalid_key", "invalid key").when(F.col("error") == "invalid_ttl", "invalid TTL").otherwise(F.col("error"))
    bad = F.col("error").isNotNull()
    known = F.when(F.col("error") == "invalid JSON body", 400).otherwise(cache_status(F.col("error")))
    return writes.withColumns({"status": F.when(bad, known).otherwise(201), "response": F.when(bad, _error(message)).otherwise(ok)})


def delete_responses(deletes: DataFrame) -> DataFrame:
    """``deletes`` (``key, outcome``) with ``status`` and ``response``."""
    ok = F.col("outcome") == "deleted"
    return deletes.withColumns({"status": F.when(ok, 200).otherwise(404), "response": F.when(ok, F.to_json(F.struct(F.lit(True).alias("deleted")))).otherwise(_error(F.lit("key not found")))})


def health_response(stats: DataFrame) -> DataFrame:
    """One row ``response`` from the one of :func:`tracemill.operators.cache.stats`."""
    return stats.select(F.to_json(F.struct(F.lit("ok").alias("status"), "entries")).alias("response"))


def stats_response(stats: DataFrame, uptime_s: float) -> DataFrame:
    """One row ``response``: the counters, with the uptime given."""
    fields = ["hits", "misses", "evictions", "entries", "memory_bytes", "hit_ratio"]
    return stats.select(F.to_json(F.struct(*fields, F.lit(float(uptime_s)).alias("uptime_seconds"))).alias("response"))


def queue_health_response(depths: DataFrame) -> DataFrame:
    """One row ``response`` from ``band, depth``."""
    return depths.agg(F.coalesce(F.sum("depth"), F.lit(0)).alias("queue_depth")).select(F.to_json(F.struct(F.lit("ok").alias("status"), "queue_depth")).alias("response"))


def read_notifications(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """``ids`` (``id``) with ``status`` and ``response`` from the notifications ``stored``
    (``id`` and other columns): the record, or that it is missing."""
    fields = [c for c in stored.columns if c != "id"]
    held = stored.select(F.col("id").alias("_id"), F.to_json(F.struct(F.col("id"), *fields)).alias("_json"))
    out = ids.join(held, F.col("id") == F.col("_id"), "left")
    empty, found = F.coalesce(F.col("id").cast("string"), F.lit("")) == "", F.col("_id").isNotNull()
    status = F.when(empty, 400).when(found, 200).otherwise(404)
    response = F.when(empty, _error(F.lit("missing notification id"))).when(found, F.col("_json")).otherwise(_error(F.lit("not found")))
    return out.withColumns({"status": status, "response": response}).drop("_id", "_json")


def get_responses(reads: DataFrame) -> DataFrame:
    """``reads`` (``key, outcome, value``) with ``status`` and ``response``."""
    hit = F.col("outcome") == "hit"
    found = F.to_json(F.struct("key", F.base64(F.col("value").cast("binary")).alias("value")))
    missing = F.to_json(F.struct(F.lit("key not found").alias("error")))
    return reads.withColumns({"status": F.when(hit, 200).otherwise(404), "response": F.when(hit, found).otherwise(missing)})
