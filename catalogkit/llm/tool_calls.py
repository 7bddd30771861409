"""Tool calls: linked to their results, validated, ordered and serialised.

Calls and results meet in an equi-join on (conversation, call id).  Arguments are checked against a
schema per tool.  A call and its result become one line of canonical JSON (sorted keys, no spaces, raw UTF-8; half a
surrogate pair, which UTF-8 lacks, stays escaped).

Order.  A call is ready at the latest place among its own and those of all calls that it needs, directly or
through others.  Calls are in order of (ready, level, place, id), where a call's level is the length of the longest
chain of needs among calls ready at the same place.  Each call thus follows those it needs, and a conversation
whose calls need earlier ones only is in order of place.

Scale.  Such a conversation, of whatever size, is numbered by a two-level running sum.  One with a call that needs a
later one is ordered in one task if it has at most ``group_rows`` calls, and else by joins of numbered calls, to the same
order.  Chains of calls with one need each are drawn together by doubling pointers; what is left takes as many
rounds as calls with several needs lie on the longest chain that waits for a later place.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm.common import running_sum, settle, stored

_KINDS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}
_HALF = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _finite(number: str) -> float:
    value = float(number)
    if not math.isfinite(value):
        raise ValueError(number)
    return value


def parse(text: str | None) -> object:
    """The value of a JSON text.  What is no JSON (NaN, numbers out of range and nesting too deep to read included) is its
    own text, and of repeated keys the last counts."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_finite)
        canonical(value)
    except (ValueError, RecursionError):
        return text
    return value


def _kinds(rule: dict) -> list[str]:
    kind = rule.get("type", [])
    return [kind] if isinstance(kind, str) else list(kind)


def check_schema(schema: dict) -> None:
    """Raises an error if a schema names an unknown type or a pattern that cannot be read."""
    for kind in _kinds(schema):
        if kind not in _KINDS:
            raise ValueError(f"unknown type {kind!r} in a schema")
    re.compile(schema.get("pattern", ""))
    for part in [*schema.get("properties", {}).values(), *([schema["items"]] if isinstance(schema.get("items"), dict) else [])]:
        check_schema(part)


def _against(value: object, rule: dict, path: str) -> list[str]:
    """Faults of a value at ``path``; a value of a wrong type has no others."""
    if (kinds := _kinds(rule)) and not any(_KINDS[k](value) for k in kinds):
        return [f"type:{path}"]
    out = []
    if "enum" in rule and canonical(value) not in map(canonical, rule["enum"]):
        out.append(f"enum:{path}")
    if isinstance(value, str):
        if not rule.get("minLength", 0) <= len(value) <= rule.get("maxLength", len(value)):
            out.append(f"length:{path}")
        if "pattern" in rule and not re.search(rule["pattern"], value):
            out.append(f"pattern:{path}")
    elif _KINDS["number"](value) and not rule.get("minimum", value) <= value <= rule.get("maximum", value):
        out.append(f"range:{path}")
    elif isinstance(value, list):
        if not rule.get("minItems", 0) <= len(value) <= rule.get("maxItems", len(value)):
            out.append(f"items:{path}")
        for i, v in enumerate(value if "items" in rule else []):
            out += _against(v, rule["items"], f"{path}[{i}]")
    elif isinstance(value, dict):
        at = f"{path}." if path else ""
        known = rule.get("properties", {})
        out += [f"missing:{at}{k}" for k in rule.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += _against(v, known[k], at + k)
            elif not rule.get("additionalProperties", True):
                out.append(f"unexpected:{at}{k}")
    return out


def faults(arguments: object, schema: dict | None) -> list[str]:
    """What a JSON value has against a schema of types (one or several), properties, required, items, enum, pattern and
    bounds, at any depth."""
    if schema is None:
        return ["unknown_tool"]
    if not isinstance(arguments, dict):
        return ["not_an_object"]
    return sorted(_HALF.sub("?", f) for f in _against(arguments, schema, ""))


def order_of(keys: list[tuple], needs: list[list[int]]) -> list[tuple | None]:
    """(ready, level) of each call from its (place, id) and the numbers of the calls it needs; none on or behind a cycle."""
    waits, after = [len(n) for n in needs], [[] for _ in keys]
    for i, own in enumerate(needs):
        for n in own:
            after[n].append(i)
    ready, level, done = list(keys), [0] * len(keys), [False] * len(keys)
    free = deque(i for i, n in enumerate(waits) if not n)
    while free:
        i = free.popleft()
        done[i] = True
        ready[i] = max([keys[i], *(ready[n] for n in needs[i])])
        level[i] = max([0, *(level[n] + 1 for n in needs[i] if ready[n] == ready[i])])
        for x in after[i]:
            waits[x] -= 1
            if not waits[x]:
                free.append(x)
    return [(ready[i], level[i]) if done[i] else None for i in range(len(keys))]


def _shortcuts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of ``edges`` (v, need) drawn together: (v, to, most, steps) of the calls with one need, and the same of the
    needs of the others.

    to is the first call with no need or several that a chain of single needs leads to, most the greatest number before it
    and steps the way there; to is null where the chain runs into a circle.  Pointers double, so that the rounds
    are as many as the logarithm of the longest chain.
    """
    one = edges.groupBy("v").agg(F.count("*").alias("n"), F.min("need").alias("to")).where("n = 1")
    ways = stored(one.select("v", "to", F.col("v").alias("most"), F.lit(1).cast("long").alias("steps")))
    reach, most = 1, ways.count()
    while True:
        ahead = ways.select(F.col("v").alias("to"), F.col("to").alias("next"), F.col("most").alias("more"), F.col("steps").alias("further"))
        longer = F.col("steps") + F.coalesce("further", F.lit(0))
        met = ways.join(ahead, "to", "left").select("v", F.coalesce("next", "to").alias("to"), F.greatest("most", "more").alias("most"), longer.alias("steps"), F.col("next").isNotNull().alias("open"))
        ways = stored(met)
        if reach >= most or ways.where("open").isEmpty():
            break
        reach *= 2
    ways = ways.select("v", F.when(~F.col("open"), F.col("to")).alias("to"), "most", "steps")
    hop = ways.select(F.col("v").alias("need"), "to", "most", "steps", F.lit(True).alias("chained"))
    others = edges.join(ways.select("v"), "v", "left_anti").join(hop, "need", "left")
    to = F.when(F.col("chained"), F.col("to")).otherwise(F.col("need")).alias("to")
    short = others.select("v", to, F.coalesce("most", "need").alias("most"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    return ways, stored(short.groupBy("v", "to").agg(F.max("most").alias("most"), F.max("steps").alias("steps")))


def _ready(calls: DataFrame, ways: DataFrame, short: DataFrame) -> DataFrame:
    """(v, ready): the greatest number among a call's own and those of all calls that it needs."""
    value = moved = stored(short.groupBy("v").agg(F.max("most").alias("most")).select("v", F.greatest("v", "most").alias("value")))
    while True:  # only calls that moved hand on
        risen = short.join(moved.select(F.col("v").alias("to"), F.col("value").alias("new")), "to").groupBy("v").agg(F.max("new").alias("new"))
        moved = stored(risen.join(value, "v").where("new > value").select("v", F.col("new").alias("value")))
        if moved.isEmpty():
            break
        value = stored(value.join(moved.withColumnRenamed("value", "new"), "v", "left").select("v", F.coalesce("new", "value").alias("value")))
    there = value.select(F.col("v").alias("to"), F.col("value").alias("value_there"))
    met = calls.select("v").join(ways, "v", "left").join(there, "to", "left").join(value, "v", "left")
    return stored(met.select("v", F.greatest("v", "most", "to", "value_there", "value").alias("ready")))


def _rounds(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, ready, level) of ``calls`` (v), level null on or behind a cycle: as ``order_of``, by joins.

    v numbers the calls by (conversation, place, id); ``edges`` are (v, need), each once.  Both are stored.
    """
    ways, short = _shortcuts(edges)
    ready = _ready(calls, ways, short)
    needed = ready.select(F.col("v").alias("need"), F.col("ready").alias("theirs"))
    near, far = _shortcuts(stored(edges.join(ready, "v").join(needed, "need").where("ready = theirs").select("v", "need")))
    waiting = far.select(F.col("v").alias("to")).distinct().withColumn("waits", F.lit(True))
    known = F.col("to").isNotNull() & F.col("waits").isNull()
    left = stored(far.join(waiting, "to", "left").select("v", "to", "steps", known.alias("known")))
    levels = left.select("v", F.col("steps").alias("level")).limit(0)
    while True:  # calls all of whose needs have a level get theirs
        free = stored(left.groupBy("v").agg(F.bool_and("known").alias("known"), F.max("steps").alias("level")).where("known").select("v", "level"))
        if free.isEmpty():
            break
        levels = stored(levels.unionByName(free))
        rest = left.join(free.select("v"), "v", "left_anti").join(free.withColumnRenamed("v", "to"), "to", "left")
        left = stored(rest.select("v", "to", (F.col("steps") + F.coalesce("level", F.lit(0))).alias("steps"), (F.col("known") | F.col("level").isNotNull()).alias("known")))
    bound = left.select("v").distinct()
    behind = near.where("to IS NULL").select("v").union(near.join(bound.withColumnRenamed("v", "to"), "to", "left_semi").select("v"))
    stuck = new = stored(bound.union(behind).union(short.where("to IS NULL").select("v")).distinct())
    while not new.isEmpty():
        met = short.join(new.withColumnRenamed("v", "to"), "to", "left_semi").select("v").distinct()
        new = stored(met.join(stuck, "v", "left_anti"))
        stuck = stored(stuck.union(new))
    stuck = stuck.union(ways.where("to IS NULL").select("v")).union(ways.join(stuck.withColumnRenamed("v", "to"), "to", "left_semi").select("v")).distinct()
    there = levels.select(F.col("v").alias("to"), F.col("level").alias("level_there"))
    chained = near.select("v", "to", "steps").join(there, "to", "left").select("v", (F.col("steps") + F.coalesce("level_there", F.lit(0))).alias("level"))
    found = ready.join(levels.unionByName(chained), "v", "left").join(stuck.withColumn("stuck", F.lit(True)), "v", "left")
    return found.select("v", "ready", F.when(F.col("stuck").isNull(), F.coalesce("level", F.lit(0))).alias("level"))


def positions(calls: DataFrame, group_rows: int = 10_000) -> DataFrame:
    """(conv_id, call_id, position): position from 0 in the order above, null on or behind a cycle.

    ``calls`` has distinct (conv_id, call_id), place (long) and needs (array of call ids); needs that name
    no call of the conversation are ignored.
    """
    named = calls.select("conv_id", "call_id", "place", F.explode("needs").alias("need")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("need"), F.col("place").alias("need_place"))
    edges = settle(named.join(known, ["conv_id", "need"]))
    later = F.struct("need_place", "need") >= F.struct("place", "call_id")
    tangled = edges.where(later).select("conv_id").distinct()
    plain = calls.select("conv_id", "call_id", "place").join(tangled, "conv_id", "left_anti").withColumn("one", F.lit(1))
    order = running_sum(plain, "one", "position", ["conv_id"], ["place", "call_id"]).select("conv_id", "call_id", "position")
    if tangled.isEmpty():
        return order
    odd = settle(calls.join(tangled, "conv_id", "left_semi").select("conv_id", "call_id", "place"))
    large = settle(odd.groupBy("conv_id").count().where(F.col("count") > group_rows).select("conv_id"))
    needs = edges.groupBy("conv_id", "call_id").agg(F.collect_list("need").alias("needs"))

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        place = {c: i for i, c in enumerate(frame.call_id)}
        keys = list(zip(frame.place.tolist(), (c.encode() for c in frame.call_id)))
        found = order_of(keys, [[place[n] for n in own] if own is not None else [] for own in frame.needs])
        ranked = sorted((i for i, f in enumerate(found) if f), key=lambda i: (*found[i], keys[i]))
        position = {i: n for n, i in enumerate(ranked)}
        return pd.DataFrame({"conv_id": frame.conv_id, "call_id": frame.call_id, "position": pd.array([position.get(i) for i in range(len(frame))], "Int64")})

    small = odd.join(large, "conv_id", "left_anti").join(needs, ["conv_id", "call_id"], "left")
    order = order.unionByName(small.groupBy("conv_id").applyInPandas(sort, "conv_id long, call_id string, position long"))
    if large.isEmpty():
        return order
    ids = stored(running_sum(odd.join(large, "conv_id", "left_semi").withColumn("one", F.lit(1)), "one", "v", [], ["conv_id", "place", "call_id"]).select("conv_id", "call_id", "v"))
    owned = edges.join(large, "conv_id", "left_semi").join(ids, ["conv_id", "call_id"]).select("conv_id", "v", F.col("need").alias("call_id"))
    numbered = stored(owned.join(ids.withColumnRenamed("v", "need"), ["conv_id", "call_id"]).select("v", "need"))
    long = stored(ids.join(_rounds(ids, numbered), "v"))
    ranked = running_sum(long.where("level IS NOT NULL").withColumn("one", F.lit(1)), "one", "position", ["conv_id"], ["ready", "level", "v"])
    stuck = long.where("level IS NULL").select("conv_id", "call_id", F.lit(None).cast("long").alias("position"))
    return order.unionByName(ranked.select("conv_id", "call_id", "position")).unionByName(stuck)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], group_rows: int = 10_000) -> DataFrame:
    """(conv_id, call_id, position, name, status, calls, results, faults, line): one row per call id.

    ``calls``: conv_id, call_id, place, name, arguments (JSON text), needs; ``results``: conv_id, call_id,
    place, content.  Of calls or results that repeat an id the first by (place, content) counts, and
    ``calls`` and ``results`` say how many there were.  status is linked, no_result (no call of this id was answered)
    or no_call (a result alone: position and name are null).  Rows with a null conversation or id are left
    out, arguments that are null or no JSON count as not_an_object, a null need is ignored, a null place is 0.  A
    schema that cannot be read raises an error.
    """
    for schema in schemas.values():
        check_schema(schema)
    first_call = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("place", "name", "arguments", "needs")).alias("c"), F.count("*").alias("calls")
    ).select("conv_id", "call_id", "c.*", "calls").withColumn("needs", F.coalesce(F.array_compact("needs"), F.array().cast("array<string>")))
    first_call = settle(first_call.withColumn("place", F.coalesce("place", F.lit(0)).cast("long")))
    first_result = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("place", "content")).alias("r"), F.count("*").alias("results")
    ).select("conv_id", "call_id", F.lit(True).alias("answered"), F.col("r.content").alias("content"), "results")
    joined = first_call.drop("needs", "place").join(positions(first_call.select("conv_id", "call_id", "place", "needs"), group_rows), ["conv_id", "call_id"])
    joined = joined.withColumn("called", F.lit(True)).join(first_result, ["conv_id", "call_id"], "full")
    joined = joined.select("conv_id", "call_id", "position", "name", "arguments", "content", "called", "answered", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("calls", "results")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, wrong, lines = [], [], []
            _, call_ids, _, names, arguments, contents, called, answered, *_ = (c.to_pylist() for c in batch.columns)
            for call_id, name, text, content, is_call, is_result in zip(call_ids, names, arguments, contents, called, answered):
                value = parse(text)
                status.append("no_call" if not is_call else "linked" if is_result else "no_result")
                wrong.append(faults(value, schemas.get(name)) if is_call else [])
                record = {"id": call_id} | ({"name": name, "arguments": value} if is_call else {}) | ({"result": content} if is_result else {})
                lines.append(canonical(record))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(status, pa.string()), *batch.columns[8:], pa.array(wrong, pa.list_(pa.string())), pa.array(lines, pa.string())],
                names=["conv_id", "call_id", "position", "name", "status", "calls", "results", "faults", "line"],
            )

    return joined.mapInArrow(run, "conv_id long, call_id string, position long, name string, status string, calls long, results long, faults array<string>, line string")


def from_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a chat table (conv_id, turn, role, text).

    A user's turn is a call of the tool ``answer`` whose result is the assistant's turn after it, and needs the
    user's turn before it, two turns back.  A system turn is a call of ``configure`` without a result, which
    waits for the call of the turn after it.  Of rows that repeat a turn all are read and counted, and the first by
    text counts.  Null turns, roles and texts: rows without turn or role, and those of other roles than user, system
    and assistant, are left out, and a null text is a null argument or result.
    """
    rows = messages.where("turn IS NOT NULL AND role IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    asked = rows.where(F.col("role").isin("user", "system"))
    step = F.when(F.col("role") == "user", -2).otherwise(1)
    needed = F.array(F.concat(F.lit("call_"), (F.col("turn") + step).cast("string")))
    name = F.when(F.col("role") == "user", "answer").otherwise("configure")
    calls = asked.select(
        "conv_id", F.concat(F.lit("call_"), F.col("turn").cast("string")).alias("call_id"), F.col("turn").alias("place"), name.alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"}).alias("arguments"), needed.alias("needs"),
    )
    results = rows.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("place"), F.col("text").alias("content")
    )
    return calls, results


SCHEMAS = {
    name: {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": longest}, "turn": {"type": "integer", "minimum": 0}},
    }
    for name, longest in (("answer", 300), ("configure", 200))
}
