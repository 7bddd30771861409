import json
import random
import re

import pytest

from catalogkit.llm import tool_calls

CALLS = "conv_id long, call_id string, place long, name string, arguments string, needs array<string>, status int"
RESULTS = "conv_id long, call_id string, place long, content string, name string"
SCHEMA = {"add": {"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "s": {"type": "string", "maxLength": 3}, "k": {"enum": ["x", "y"]}}, "additionalProperties": False}}


def run(spark, calls, results, **options):
    out = tool_calls.link(spark.createDataFrame([(*c, 0) for c in calls], CALLS), spark.createDataFrame([(*r, "") for r in results], RESULTS), SCHEMA, **options)
    return {(r.conv_id, r.call_id): r for r in out.collect()}


def test_links_faults_and_lines(spark):
    calls = [
        (1, "a", 0, "add", '{"a": 1, "s": "é"}', []), (1, "b", 1, "add", '{"a": -1, "z": 1, "s": "long", "k": "q"}', ["a", "gone", None]), (1, "c", 2, "mul", "{}", None),
        (1, "d", 3, "add", "no json", ["c"]), (1, "e", 4, "add", None, []), (1, "a", 9, "add", "{}", []), (None, "a", 0, "add", "{}", []), (2, None, 0, "add", "{}", []),
    ]
    results = [(1, "a", 5, "two"), (1, "a", 6, "again"), (1, "z", 7, "lost"), (2, "a", 1, None), (None, "a", 1, "x")]
    got = run(spark, calls, results)
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "e"), (1, "z"), (2, "a")}
    a = got[1, "a"]
    assert (a.position, a.status, a.results, a.faults) == (0, "linked", 2, [])
    assert a.line == '{"arguments":{"a":1,"s":"é"},"id":"a","name":"add","result":"two"}'
    assert got[1, "b"].faults == ["enum:k", "length:s", "range:a", "unexpected:z"]
    assert got[1, "c"].faults == ["unknown_tool"] and got[1, "d"].faults == got[1, "e"].faults == ["not_an_object"]
    assert got[1, "z"].status == got[2, "a"].status == "no_call" and got[1, "z"].position is None
    assert [got[1, c].position for c in "abcde"] == [0, 1, 2, 3, 4]
    assert json.loads(got[2, "a"].line) == {"id": "a", "result": None}


@pytest.mark.parametrize("group_rows", [100, 2])
def test_order_with_later_needs_and_cycles(spark, group_rows):
    calls = [(1, "a", 0, "add", "{}", ["c"]), (1, "b", 1, "add", "{}", []), (1, "c", 2, "add", "{}", ["d"]), (1, "d", 3, "add", "{}", [])]
    calls += [(2, "x", 0, "add", "{}", ["y"]), (2, "y", 1, "add", "{}", ["x"]), (2, "z", 2, "add", "{}", ["y"]), (2, "w", 3, "add", "{}", []), (3, "s", 0, "add", "{}", ["s"])]
    got = run(spark, calls, [], group_rows=group_rows)
    order = sorted("abcd", key=lambda c: got[1, c].position)
    assert sorted(got[1, c].position for c in "abcd") == [0, 1, 2, 3]
    assert order.index("d") < order.index("c") < order.index("a")
    assert got[2, "w"].position == 0 and {got[2, c].position for c in "xyz"} == {None} and got[3, "s"].position is None


def test_conversations_with_nulls_and_none(spark):
    rows = [(1, 0, "system", "be brief", 1), (1, 1, "user", "hi", 1), (1, 2, "assistant", "ho", 1), (1, 3, "user", None, 1), (2, None, "user", "x", 1), (2, 1, None, "x", 1), (2, 1, "user", "q", 1), (2, 1, "user", "q", 1)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name int")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(*tool_calls.from_conversations(messages), tool_calls.SCHEMAS).collect()}
    assert {k: (r.status, r.position, r.faults) for k, r in got.items()} == {
        (1, "call_0"): ("no_result", 1, []), (1, "call_1"): ("linked", 0, []), (1, "call_3"): ("no_result", 2, ["type:prompt"]), (2, "call_1"): ("no_result", 0, []),
    }
    assert got[2, "call_1"].calls == 2 and got[1, "call_1"].calls == 1
    assert tool_calls.link(*tool_calls.from_conversations(messages.limit(0)), tool_calls.SCHEMAS).collect() == []


def brute_order(calls):
    """(ready, level, place, id) ranks by the definition: closures and longest chains, without any queue."""
    place, needs = {c: p for c, p, _ in calls}, {c: [n for n in set(own) if n in {x for x, *_ in calls}] for c, _, own in calls}
    closure = {c: set(needs[c]) for c in place}
    for _ in place:
        closure = {c: own | {y for x in own for y in closure[x]} for c, own in closure.items()}
    stuck = {c for c in place if c in closure[c] or any(x in closure[x] for x in closure[c])}
    ready = {c: max((place[x], x) for x in closure[c] | {c}) for c in place}

    def level(c):
        return max([0, *(level(n) + 1 for n in needs[c] if ready[n] == ready[c])])

    order = sorted((c for c in place if c not in stuck), key=lambda c: (ready[c], level(c), place[c], c))
    return {c: order.index(c) if c in order else None for c in place}


def test_the_order_is_the_same_at_every_size(spark):
    rng, convs = random.Random(4), {}
    for conv in range(6):
        n = rng.randint(3, 9)
        convs[conv] = [(f"c{i}", rng.randint(0, 6), [f"c{rng.randrange(n)}" for _ in range(rng.choice([0, 1, 1, 2]))]) for i in range(n)]
    convs[6] = [(f"c{i}", i, [f"c{i - 1}"]) for i in range(30)] + [("late", -1, ["c29"])]  # a long chain that is almost in order
    convs[7] = [(f"c{i}", i, [f"c{i + 1}"]) for i in range(7)]
    calls = [(conv, c, p, "add", "{}", own) for conv, rows in convs.items() for c, p, own in rows]
    expected = {(conv, c): n for conv, rows in convs.items() for c, n in brute_order(rows).items()}
    for group_rows in (100, 2):
        assert {k: r.position for k, r in run(spark, calls, [], group_rows=group_rows).items()} == expected


def test_calls_that_share_a_place_are_numbered(spark):
    calls = [(1, f"c{i:04}", None, "add", "{}", []) for i in range(3000)]
    got = run(spark, calls, [])
    assert [got[1, f"c{i:04}"].position for i in range(3000)] == list(range(3000))


def test_texts_that_are_no_json(spark):
    texts = ['{"a":"\\ud800"}', "[" * 100_000, '{"a":NaN}', '{"a":1e999}', '{"a":' + "9" * 5000 + "}", '{"a":1,"a":2}', '{"a":"\\ud83d\\ude00"}']
    got = run(spark, [(1, str(i), i, "add", t, []) for i, t in enumerate(texts)], [])
    lines = [got[1, str(i)].line for i in range(len(texts))]
    assert lines[0] == '{"arguments":{"a":"\\ud800"},"id":"0","name":"add"}'
    assert [got[1, str(i)].faults for i in range(1, 5)] == [["not_an_object"]] * 4
    assert [json.loads(x)["arguments"] for x in lines[1:5]] == texts[1:5]
    assert json.loads(lines[5])["arguments"] == {"a": 2} and '"a":"😀"' in lines[6]


def test_nested_schemas():
    schema = {
        "required": ["a"], "properties": {
            "a": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"b": {"type": "integer"}, "x": {"type": ["integer", "null"]}}},
            "l": {"type": "array", "maxItems": 2, "items": {"type": "string", "pattern": "^[a-z]+$"}}, "e": {"enum": [1, "1"]},
        },
    }
    tool_calls.check_schema(schema)
    assert tool_calls.faults({"a": {"x": None, "b": 1}, "l": ["ab"], "e": 1}, schema) == []
    assert tool_calls.faults({"a": {"b": "x", "c": 1}, "l": ["A", 1, "b"], "e": True}, schema) == ["enum:e", "items:l", "missing:a.x", "pattern:l[0]", "type:a.b", "type:l[1]", "unexpected:a.c"]
    for bad in ({"type": "text"}, {"properties": {"p": {"type": ["string", "x"]}}}, {"items": {"type": 3}}, {"pattern": "("}):
        with pytest.raises((ValueError, TypeError, re.error)):
            tool_calls.check_schema(bad)


def test_jobs_do_not_grow_with_a_chain(spark):
    """The number of Spark jobs grows with the logarithm of a chain's length."""

    def jobs(n):
        edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, 0), (n, 1)], "v long, need long")
        group = f"chain-{n}"
        spark.sparkContext.setJobGroup(group, group)
        got = {r.v: (r.ready, r.level) for r in tool_calls._rounds(spark.range(n + 1).toDF("v"), edges).collect()}
        spark.sparkContext.setJobGroup("none", "none")
        assert got == {i: (n - 1, n - 1 - i) for i in range(n)} | {n: (n, 0)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(400) <= 2.5 * jobs(30)
