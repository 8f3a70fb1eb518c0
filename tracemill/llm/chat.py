"""Chat formatting: tool calls linked with their results.

Calls and results are hash-joined by (conversation, identifier).  Calls are put in
a topological order of their dependencies, their arguments are validated against
the schema of their tool, and each linked call is serialised as canonical JSON: keys
sorted by UTF-16 code unit, no blanks, characters unescaped (but for lone surrogates),
floating numbers in their shortest form, whole ones as integers.

The order of a conversation is that of ``(ready, wait, seq)``: ``ready`` is the
largest ``seq`` among a call and all that it depends on, ``wait`` the most steps from
the one that has it.  Where dependencies point backwards, as logs usually have it,
this is ``seq`` itself.  Only conversations in which a call waits for a later one take
rounds of joins: each round takes away what waits for nothing more, and lets what waits
for a call with one dependency wait for that one instead, so a chain takes rounds in
proportion to the logarithm of its length.  No conversation is ever gathered in one task.

Defined results: of several calls (results) with one identifier the smallest ``seq``,
then content, stands; a call without result is unlinked and its result null;
results without call are dropped; unknown dependencies are ignored; calls on a
dependency cycle, or behind one, have ``ordered`` false, ``ready`` their ``seq`` and
``wait`` 0; null identifiers never link; texts of any length are kept whole; empty tables
give empty results, or calls without one; other columns are not read.  Arguments that
are no JSON object are invalid, and are kept as text where they are no JSON: so are
``NaN``, infinite numbers and values nested more than ``MAX_NESTING`` deep.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize, schema_with

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}


#: Arrays and objects within one another in a JSON value that is read.
MAX_NESTING = 100
_SURROGATE = re.compile("[\ud800-\udfff]")


def _string(s: str) -> str:
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def _number(x: float) -> str:
    """The shortest digits that give ``x`` back, written as ECMAScript writes them."""
    if x == 0:
        return "0"
    if abs(x) < 1e21 and x == int(x):
        return str(int(x))
    digits, _, power = repr(x).partition("e")
    if not power:
        return digits
    n = int(power)
    if -7 < n < 0:  # 1.5e-05 is written out
        sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return f"{sign}0.{'0' * (-n - 1)}{digits.replace('.', '')}"
    return f"{digits}e{n:+d}"


def canonical(value) -> str:
    """Canonical JSON of a value; a number that is not finite is refused."""
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_string(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not finite")
        return _number(value)
    return json.dumps(value)


def _finite(text: str) -> float:
    x = float(text)
    if math.isinf(x):
        raise ValueError("not finite")
    return x


def _refuse(text: str):
    raise ValueError(text)


def read_json(text: str):
    """The value of a JSON text; ``ValueError`` if it is none, or too deep."""
    depth = most = 0
    for m in _NESTING.finditer(text):
        depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        most = max(most, depth)
    if most > MAX_NESTING:
        raise ValueError("too deep")
    return json.loads(text, parse_float=_finite, parse_constant=_refuse)


#: Brackets outside strings: a string is one match, and counts nothing.
_NESTING = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}]', re.DOTALL)


def check(value, schema: Mapping, path: str = "$") -> str | None:
    """The first violation of a JSON schema (type, enum, required, properties,
    additionalProperties, items, lengths and bounds), or None."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES[k](value) for k in kinds):
            return f"{path}: not {' or '.join(kinds)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{path}: not among the values"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if found := check(value[name], known[name], f"{path}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{name}: unknown"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{path}: number of items"
        for i, item in enumerate(value if "items" in schema else ()):
            if found := check(item, schema["items"], f"{path}[{i}]"):
                return found
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{path}: length"
    if _TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
            return f"{path}: out of bounds"
    return None


def _ordered(calls: DataFrame) -> DataFrame:
    """``calls`` with ``ready``, ``wait`` and ``ordered``."""
    known = calls.select("conv_id", F.col("call_id").alias("dep"), F.col("seq").alias("_dep_seq"))
    needs = calls.select("conv_id", "call_id", "seq", F.explode(F.array_distinct("depends_on")).alias("dep"))
    needs = materialize(needs.join(known, ["conv_id", "dep"]).select("conv_id", "call_id", "dep", (F.col("_dep_seq") >= F.col("seq")).alias("late")), "needs")
    late = needs.filter("late").select("conv_id").distinct()
    own = F.struct(F.col("seq").alias("ready"), F.lit(0).cast("long").alias("wait"))
    if late.isEmpty():
        return calls.withColumns({"ready": F.col("seq"), "wait": F.lit(0).cast("long"), "ordered": F.lit(True)})
    # ``at`` is the place of a call by what is settled; an edge adds ``k`` steps to the place of ``dep``
    edges = needs.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "dep", F.lit(1).cast("long").alias("k"))
    nodes = calls.join(late, "conv_id", "left_semi").select("conv_id", "call_id", own.alias("at"))
    nodes = materialize(_state(nodes, edges), "order")
    waiting = nodes.filter("n > 0").count()
    while waiting:
        of = nodes.select("conv_id", F.col("call_id").alias("dep"), F.col("at").alias("_at"), F.col("n").alias("_n"), "only", "step")
        # each edge ends, goes on to the one thing its end waits for, or stays
        seen = edges.join(of, ["conv_id", "dep"])
        moved = F.col("_n") == 1
        gives = F.when(F.col("_n") < 2, F.struct(F.col("_at.ready").alias("ready"), (F.col("_at.wait") + F.col("k")).alias("wait")))
        seen = materialize(seen.select("conv_id", "call_id", gives.alias("gives"), F.when(moved, F.col("only")).when(F.col("_n") > 1, F.col("dep")).alias("dep"),
            F.when(moved, F.least(F.col("k") + F.col("step"), F.lit(1 << 40))).otherwise(F.col("k")).alias("k")), "seen")
        most = seen.groupBy("conv_id", "call_id").agg(F.max("gives").alias("_most"))
        edges = seen.filter("dep is not null").groupBy("conv_id", "call_id", "dep").agg(F.max("k").alias("k"))
        at = nodes.join(most, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("at", "_most").alias("at"))
        nodes = materialize(_state(at, edges), "order")
        before, waiting = waiting, nodes.filter("n > 0").count()
        if waiting == before:  # what is left waits for itself
            break
    free = F.coalesce(F.col("n"), F.lit(0)) == 0
    place = F.when(F.col("at").isNotNull() & free, F.col("at")).otherwise(own)
    out = calls.join(nodes.select("conv_id", "call_id", "at", "n"), ["conv_id", "call_id"], "left")
    return out.select(*calls.columns, place["ready"].alias("ready"), place["wait"].alias("wait"), free.alias("ordered"))


def _state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with the number ``n`` of calls each waits for, and ``only, step``: the one, if it is one."""
    left = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("dep").alias("only"), F.min("k").alias("step"))
    return nodes.join(left, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "at", F.coalesce("n", F.lit(0)).alias("n"), "only", "step")


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """Linked calls.

    ``calls``: ``conv_id, call_id, seq, name, arguments`` (JSON text) and ``depends_on``
    (identifiers).  ``results``: ``conv_id, call_id, seq, content``.  Returns
    ``conv_id, call_id, seq, ready, wait, ordered, linked, valid, error, record``.
    """
    fields = ["seq", "name", "arguments", "depends_on"]
    one = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(*fields)).alias("_c"))
    one = one.select("conv_id", "call_id", *[F.col(f"_c.{f}").alias(f) for f in fields])
    answer = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("seq", "content")).alias("_r"))
    # one row a call on either side; hashed by key, so each task holds its share of the results
    one = materialize(one, "calls")
    joined = _ordered(one).join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    given = joined.select("conv_id", "call_id", "seq", "ready", "wait", "ordered", F.col("_r").isNotNull().alias("linked"), "name", "arguments", F.col("_r.content").alias("content"))
    kept = given.columns[:7]

    def run(batches):
        for batch in batches:
            valid, error, record = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "content")), strict=True)
            for call_id, name, text, content in rows:
                try:
                    value = read_json(text) if text is not None else None
                    wrong = check(value, {"type": "object"}) or ("unknown tool" if name not in schemas else check(value, schemas[name]))
                except ValueError:
                    value, wrong = text, "not JSON"
                valid.append(wrong is None)
                error.append(wrong)
                record.append(canonical({"id": call_id, "name": name, "arguments": value, "result": content}))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(valid, pa.bool_()), pa.array(error, pa.string()), pa.array(record, pa.string())], [*kept, "valid", "error", "record"]
            )

    return given.mapInArrow(run, schema_with(given, kept, "valid boolean, error string, record string"))


#: Schema of the call that the registered query makes of each user turn.
REPLY = {
    "type": "object", "required": ["text", "words"], "additionalProperties": False,
    "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 40}},
}


def as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user turn asks for a reply, and the
    assistant turn right after it is the result.  A call of an odd number of words waits for
    that of the next user turn, if there is one two turns on; others for that of the one before."""
    def name(turn):
        return F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))

    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    # one row a turn: which text stands decides what the call waits for
    asked = turns.filter("role = 'user'").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    turn = F.col("turn")
    needs = name(F.when(words % 2 == 1, turn + 2).otherwise(turn - 2))
    arguments = F.to_json(F.struct("text", words.alias("words")))
    calls = asked.select("conv_id", name(turn).alias("call_id"), turn.alias("seq"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(needs).alias("depends_on"))
    results = turns.filter("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("seq"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def report(turns: DataFrame) -> DataFrame:
    """``conv_id, call_id, turn, ready, wait, ordered, linked, valid, record`` of each user
    turn; the order of a conversation is that of ``ready, wait, turn``."""
    calls, results = as_calls(turns)
    out = link(calls, results, {"reply": REPLY})
    return out.select("conv_id", "call_id", F.col("seq").alias("turn"), "ready", "wait", "ordered", "linked", "valid", "record")


#: A call waits for one other, so what it waits for in the end is found along a path:
#: ``up`` goes on to later turns until one waits for none or for an earlier one; a turn of even
#: words after one of odd words that waits for it is a cycle.
SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, min(coalesce(text, '')) AS text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
a AS (SELECT conv_id, turn, min(coalesce(text, '')) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL),
c AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM u),
d AS (SELECT c.conv_id, c.turn, n.turn AS dep FROM c JOIN c AS n ON c.conv_id = n.conv_id AND n.turn = c.turn + CASE WHEN c.words % 2 = 1 THEN 2 ELSE -2 END),
walk AS (SELECT conv_id, turn, turn AS pos, 0 AS steps, false AS looped FROM c
  UNION ALL
  SELECT w.conv_id, w.turn, d.dep, w.steps + 1, EXISTS (SELECT 1 FROM d AS e WHERE e.conv_id = d.conv_id AND e.turn = d.dep AND e.dep = d.turn)
  FROM walk AS w JOIN d ON w.conv_id = d.conv_id AND w.pos = d.turn WHERE NOT w.looped),
p AS (SELECT conv_id, turn, max(pos) AS ready, max_by(steps, pos) AS wait, NOT bool_or(looped) AS ordered FROM walk GROUP BY ALL),
j AS (SELECT c.*, content FROM c LEFT JOIN a ON c.conv_id = a.conv_id AND c.turn + 1 = a.turn)
SELECT j.conv_id, call_id, j.turn, CASE WHEN ordered THEN ready ELSE j.turn END AS ready, CASE WHEN ordered THEN wait ELSE 0 END AS wait, ordered,
  content IS NOT NULL AS linked, length(text) > 0 AND words BETWEEN 1 AND 40 AS valid,
  '{"arguments":{"text":' || to_json(text)::VARCHAR || ',"words":' || words || '},"id":"' || call_id || '","name":"reply","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS record
FROM j JOIN p ON j.conv_id = p.conv_id AND j.turn = p.turn"""
