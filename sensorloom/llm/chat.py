"""Operator 1: tool calls and their results, linked, checked, ordered and written as canonical JSON.

Calls and results are two tables that share a conversation and an identifier; a hash join on both links them, so
a conversation of any length is spread over all tasks. Arguments are checked against the tool's schema inside
the row. The order is topological: a call comes after all calls it depends on, and its level is one more than
the highest of theirs. Levels are found round by round by joins, one round per level of the deepest chain;
calls on a cycle, or behind one, are told apart by the rounds coming to a halt.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import arrow_rows, stored

_TYPES = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "array": lambda x: isinstance(x, list),
    "object": lambda x: isinstance(x, dict),
}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON-schema subset a value breaks: type, enum, bounds, lengths, items, properties, required."""
    wanted = schema.get("type")
    kinds = [wanted] if isinstance(wanted, str) else wanted or []
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if _TYPES["number"](value):
        out += [f"{at}: below {schema['minimum']}"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{at}: above {schema['maximum']}"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, str):
        out += [f"{at}: shorter than {schema['minLength']}"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: longer than {schema['maxLength']}"] if len(value) > schema.get("maxLength", math.inf) else []
    if isinstance(value, list) and "items" in schema:
        out += [p for i, x in enumerate(value) for p in problems(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in known:
                out += problems(x, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, whole floats as integers, and no escapes but the needed ones."""

    def plain(x):
        if isinstance(x, float):
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _constant(name: str):
    raise ValueError(name)


def read_arguments(text: str | None, schema: dict | None) -> tuple[str | None, list[str]]:
    """Canonical arguments and the problems found; arguments that are no JSON object are null."""
    if schema is None:
        found = ["unknown tool"]
    else:
        found = []
    try:
        value = json.loads(text or "{}", object_pairs_hook=_unique, parse_constant=_constant)
        return canonical(value), found + (problems(value, schema) if schema is not None else [])
    except (ValueError, RecursionError) as e:
        return None, [*found, f"no JSON: {type(e).__name__}"]


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """Topological levels: ``calls`` (conv_id, call_id), ``needs`` (conv_id, call_id, needs_id).

    Adds ``level``: 0 without needs, else one more than the highest needed. A need that is no call counts as
    met. Null where a cycle keeps a call from ever being ready. Each round joins only what is still open.
    """
    key = ["conv_id", "call_id"]
    done = None
    known = calls.select(*key).distinct()
    left = stored(needs.join(known.withColumnRenamed("call_id", "needs_id"), ["conv_id", "needs_id"], "left_semi").join(known, key, "left_semi").select(*key, "needs_id").distinct())
    ready = stored(known.join(left.select(*key).distinct(), key, "left_anti"))
    todo, level = stored(left.select(*key).distinct()), 0
    while True:
        part = ready.withColumn("level", F.lit(level))
        done = part if done is None else done.unionByName(part)
        if todo.isEmpty() or ready.isEmpty():
            break
        left = stored(left.join(ready.select("conv_id", F.col("call_id").alias("needs_id")), ["conv_id", "needs_id"], "left_anti").select(*key, "needs_id"))
        waiting = left.select(*key).distinct()
        ready = stored(todo.join(waiting, key, "left_anti"))
        todo = stored(todo.join(ready, key, "left_anti"))
        level += 1
    return done.unionByName(todo.withColumn("level", F.lit(None).cast("int")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link tool calls to results; one row per distinct call, one per result that no call has.

    ``calls``: conv_id, call_id, turn, tool, arguments (JSON text), needs (array of call ids); ``results``:
    conv_id, call_id, turn, content. Of rows with one identifier the first by turn, then by content counts;
    the number of them is ``n_calls`` and ``n_results``. Rows without conv_id or call_id are left out, they
    cannot be linked. Other columns are ignored.

    Returns conv_id, call_id, tool, turn, level (see :func:`levels`), status (ok, invalid, unanswered, early: the
    result comes before the call, cycle, orphan: a result without a call), problems, n_calls, n_results, and
    ``record``, the canonical JSON of the linked pair. Sorting by conv_id, level, turn, call_id is a
    topological order.
    """
    key = ["conv_id", "call_id"]
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(whole).groupBy(*key).agg(
        F.min(F.struct("turn", "tool", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))).alias("call"), F.count("*").alias("n_calls"))
    two = results.where(whole).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    one = stored(one.select(*key, "call.*", "n_calls"))
    level = levels(one, one.select(*key, F.explode("needs").alias("needs_id")).where("needs_id IS NOT NULL"))
    linked = one.join(level, key, "left").withColumn("called", F.lit(True)).join(two, key, "full")
    names = ["conv_id", "call_id", "tool", "turn", "level", "status", "problems", "n_calls", "n_results", "record"]
    conv = calls.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, call_id string, tool string, turn long, level int, status string, problems array<string>, n_calls long, n_results long, record string"

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            got, found, arguments = r["result"], [], None
            if r["called"]:
                arguments, found = read_arguments(r["arguments"], schemas.get(r["tool"]))
            early = got is not None and got["turn"] is not None and r["turn"] is not None and got["turn"] < r["turn"]
            status = ("orphan" if not r["called"] else "invalid" if found else "cycle" if r["level"] is None else "unanswered" if got is None
                      else "early" if early else "ok")
            record = {"id": r["call_id"]}
            if r["called"]:
                record["call"] = {"name": r["tool"], "arguments": json.loads(arguments) if arguments is not None else r["arguments"], "needs": sorted(x for x in r["needs"] if x is not None)}
            if got is not None:
                record["result"] = got["content"]
            out.append((r["conv_id"], r["call_id"], r["tool"], r["turn"] if r["called"] else got["turn"], r["level"], status, found, r["n_calls"] or 0, r["n_results"] or 0, canonical(record)))
        kinds = (batch.schema.field("conv_id").type, pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return arrow_rows(linked, schema, write)


#: Tools of the calls that :func:`calls_of_turns` derives.
TOOLS = {
    "ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
            "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "lookup": {"type": "object", "required": ["line", "words"], "additionalProperties": False,
               "properties": {"line": {"type": "string", "minLength": 1, "maxLength": 2000}, "words": {"type": "integer", "minimum": 1, "maximum": 40}}},
}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations: a user turn asks and the next turn of the conversation answers.

    Every line of the user's text is a ``lookup`` that the ``ask`` of the turn needs; line i is answered by line i
    of the reply, so lines past its end stay unanswered.
    """
    body = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    text = F.coalesce("text", F.lit(""))
    user = body.where("role = 'user'").select("conv_id", "turn", text.alias("text"), F.split(text, "\n").alias("lines"))
    answer = body.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("asked"), "turn", text.alias("text"))
    ask = F.concat(F.lit("ask-"), "turn")
    words = lambda line: F.size(F.filter(F.split(line, " "), lambda w: w != ""))
    root = user.select(
        "conv_id", ask.alias("call_id"), "turn", F.lit("ask").alias("tool"), F.to_json(F.struct("turn", "text")).alias("arguments"),
        F.transform("lines", lambda line, i: F.concat(F.lit("line-"), "turn", F.lit("-"), i)).alias("needs"))
    leaf = user.select("conv_id", "turn", F.posexplode("lines").alias("i", "line")).select(
        "conv_id", F.concat(F.lit("line-"), "turn", F.lit("-"), "i").alias("call_id"), "turn", F.lit("lookup").alias("tool"),
        F.to_json(F.struct(words("line").alias("words"), "line")).alias("arguments"), F.array().cast("array<string>").alias("needs"))
    results = answer.select("conv_id", F.concat(F.lit("ask-"), "asked").alias("call_id"), "turn", F.col("text").alias("content")).unionByName(
        answer.select("conv_id", "turn", "asked", F.posexplode(F.split("text", "\n")).alias("i", "content"))
        .select("conv_id", F.concat(F.lit("line-"), "asked", F.lit("-"), "i").alias("call_id"), "turn", "content"))
    return root.unionByName(leaf), results
