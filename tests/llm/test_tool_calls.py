import hashlib
import json
import random
from collections import defaultdict

import pytest

from apexframe.llm import tool_calls as T
from apexframe.llm.queries import SCHEMAS, derived_calls

FOLDER = "/root/testdata/sf0.001"
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
GOOD = '{"to": "en", "text": "x"}'


@pytest.fixture(params=[T.SMALL, 0], ids=["whole", "rounds"])
def bound(request, monkeypatch):
    """Conversations are ordered whole, or all of them by rounds over the table."""
    monkeypatch.setattr(T, "SMALL", request.param)
    return request.param


def order(calls):
    """Labels by the definition, one conversation at a time; None for calls on a cycle, or between two."""
    turn = {c: t or 0 for c, t, _ in calls}
    needs = {c: {n for n in ns or [] if n in turn} for c, _, ns in calls}
    bad = set(turn)
    while more := {c for c in bad if not needs[c] & bad or not any(c in needs[d] for d in bad)}:
        bad -= more
    out = dict.fromkeys(bad)

    def label(c):
        if c not in out:
            out[c] = max([(turn[c], 0), *((t, k + 1) for t, k in (label(n) for n in needs[c] - bad))])
        return out[c]

    return {c: label(c) for c in turn}


def brute(calls, results, schemas):
    owners, answers, out = {}, {}, []

    def by_turn(rows):
        dumped = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)
        said = lambda r: [r[3], r[4], dumped(r[5] or [])] if len(r) > 4 else [r[3]]
        return sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, hashlib.sha256(dumped(said(r)).encode()).hexdigest()))

    for r in by_turn(calls):
        if r[0] is not None and r[1] is not None:
            owners.setdefault(r[:2], r)
    for r in by_turn(results):
        if r[0] is not None and r[1] is not None:
            answers.setdefault(r[:2], r)
    conversations = defaultdict(list)
    for r in owners.values():
        conversations[r[0]].append((r[1], r[2], r[5]))
    labels = {(conv, c): label for conv, rows in conversations.items() for c, label in order(rows).items()}
    seen = set()
    for r in by_turn(calls):
        own = owners.get(r[:2]) is r and r[:2] not in seen
        if own:
            seen.add(r[:2])
        answer = answers.get(r[:2]) if own else None
        label = labels[r[:2]] if own else (r[2] or 0, 0)
        try:
            arguments = json.loads(r[4] or "")
            whole = {"id": r[1], "name": r[3], "arguments": arguments} | ({"result": answer[3]} if answer else {})
            text = json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            wrong = r[3] not in schemas or not isinstance(arguments, dict) or bool(T.violations(arguments, schemas[r[3]]))
        except ValueError:
            text, wrong = None, True
        early = answer and r[2] is not None and answer[2] is not None and answer[2] <= r[2]
        status = (
            "repeated" if not own and None not in r[:2] else "cycle" if label is None else "invalid" if wrong else "no result" if not answer else "early result" if early else "ok"
        )
        out.append((*r[:2], r[3], r[2], answer[2] if answer else None, *(label or ((1 << 63) - 1, 0)), status, text))
    used = set()
    for r in by_turn(results):
        first = answers.get(r[:2]) is r and r[:2] in owners and r[:2] not in used
        if first:
            used.add(r[:2])
        else:
            out.append((r[0], r[1], None, None, r[2], None, None, "repeated" if None not in r[:2] and r[:2] in owners else "orphan", None))
    return sorted(out, key=str)


def run(spark, calls, results, schemas=SCHEMAS):
    df = T.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas)
    return got(df)


def got(df):
    names = ["conv_id", "call_id", "name", "call_turn", "result_turn", "order_turn", "order_step", "status", "json"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


EDGE_CALLS = [
    (1, "a", 5, "translate", GOOD, ["b"]), (1, "b", 9, "translate", GOOD, ["missing"]), (1, "c", 2, "translate", GOOD, ["a", "b"]), (1, "d", 20, "translate", GOOD, ["a"]),
    (2, "a", 1, "translate", GOOD, ["b"]), (2, "b", 2, "translate", GOOD, ["a"]), (2, "c", 3, "translate", GOOD, ["b"]), (2, "d", 4, "translate", GOOD, None), (2, "self", 5, "translate", GOOD, ["self"]),
    (3, "a", 1, "translate", GOOD, []), (3, "a", 3, "translate", GOOD, ["a"]), (3, "x", 1, "nothing", GOOD, []), (3, "y", 1, "translate", "[1]", []), (3, "z", 1, "translate", "{", []),
    (3, "n", None, "translate", None, []), (3, "k", 1, "translate", '{"to":"en","to":"fr"}', []), (3, "nan", 1, "translate", '{"to":"en","text":NaN}', []), (3, "long", 1, "translate", json.dumps({"to": "xx", "text": "é" * 200_000}), []),
    (None, "a", 1, "translate", GOOD, ["a"]), (4, None, 1, "translate", GOOD, [None]), (4, "early", 5, "translate", GOOD, []), (4, "num", 1, "search", '{"query": "' + "q" * 30 + '", "limit": 3.0}', []),
]
EDGE_RESULTS = [
    (1, "a", 6, "r"), (1, "c", 3, None), (2, "d", 5, "x"), (3, "a", 2, "first"), (3, "a", 2, "first"), (3, "a", 9, "late"), (3, "none", 4, "orphan"), (4, "early", 5, "soon"),
    (None, "a", 2, "x"), (4, None, 2, "x"), (4, "num", None, "é\n\"\\"), (5, "a", 1, "other conversation"),
]


def test_edge_rows(spark, bound):
    out = run(spark, EDGE_CALLS, EDGE_RESULTS)
    strict = {"k": None, "nan": None}  # stricter than the standard library: repeated keys and NaN are no JSON
    wanted = [(*r[:-1], strict.get(r[1], r[-1])) for r in brute(EDGE_CALLS, EDGE_RESULTS, SCHEMAS)]
    wanted = [(*r[:-1], r[-1].replace('"limit":3.0', '"limit":3') if r[-1] else None) for r in wanted]
    assert out == sorted(wanted, key=str)
    status = {(r[0], r[1], r[3]): r[7] for r in out}
    assert [status[2, c, t] for c, t in (("a", 1), ("b", 2), ("self", 5), ("c", 3), ("d", 4))] == ["cycle"] * 3 + ["no result", "ok"]


def test_order_is_topological(spark, bound):
    rows = {(r[0], r[1]): (r[5], r[6]) for r in run(spark, EDGE_CALLS[:4], [])}
    assert rows[1, "b"] < rows[1, "a"] < rows[1, "c"] and rows[1, "a"] < rows[1, "d"]


def test_long_backward_chain(spark, bound):
    calls = [(7, f"c{i}", i, "translate", GOOD, [f"c{i + 1}"]) for i in range(6)]
    assert run(spark, calls, []) == brute(calls, [], SCHEMAS)


def test_random_needs(spark, bound):
    rng = random.Random(4)
    calls = []
    for conv in range(40):
        n = rng.randint(1, 14)
        for i in range(n):
            calls.append((conv, f"c{i}", rng.choice([i, i, rng.randint(0, n)]), "translate", GOOD, [f"c{rng.randint(0, n)}" for _ in range(rng.choice([0, 1, 1, 2]))]))
    out = run(spark, calls, [])
    assert out == brute(calls, [], SCHEMAS) and {"cycle", "no result"} == {r[7] for r in out}


def test_long_conversation_behind_a_cycle(spark, monkeypatch):
    """What follows a cycle is not looked at round by round."""
    settled = []
    monkeypatch.setattr(T, "SMALL", 0)
    monkeypatch.setattr(T, "settle", lambda df, real=T.settle: settled.append(1) or real(df))
    calls = [(1, f"c{i}", i, "translate", GOOD, [f"c{i - 1}"] + (["c1"] if i == 0 else [])) for i in range(60)]
    assert run(spark, calls, []) == brute(calls, [], SCHEMAS)
    assert len(settled) < 25


def test_whole_table_and_empty_tables(spark):
    conversations = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    calls, results = derived_calls(conversations)
    wanted = brute([tuple(r) for r in calls.collect()], [tuple(r) for r in results.collect()], SCHEMAS)
    out = got(T.linked(calls, results, SCHEMAS))
    assert out == wanted and {"ok", "invalid"} <= {r[7] for r in out}
    assert run(spark, [], []) == [] and len(run(spark, [], EDGE_RESULTS)) == len(EDGE_RESULTS)


def test_violations():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 3}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2}, "maxItems": 2}}}
    assert T.violations({"a": 2, "b": ["x"]}, schema) == [] and T.violations({"a": 2.0}, schema) == []
    assert T.violations({"a": True}, schema) == ["$.a: type"] and T.violations({"a": 4, "c": 1}, schema) == ["$.a: bounds", "$.c: unknown"]
    assert T.violations({"b": ["xyz", 1, ""]}, schema) == ["$.a: missing", "$.b: length", "$.b[0]: length", "$.b[1]: type"]


@pytest.mark.parametrize("text, out", [('{"b": 1.0, "a": [1e2, 0.5, null, "é\\u00e9\\n"]}', '{"a":[100,0.5,null,"éé\\n"],"b":1}'), ('{"a":1e300}', '{"a":1e+300}')])
def test_canonical(text, out):
    assert T.canonical(T.parsed(text)) == out and T.canonical(T.parsed(out)) == out
    for bad in ('{"a":1,"a":2}', "NaN", "", "{", "[1,]"):
        with pytest.raises(ValueError):
            T.parsed(bad)


@pytest.mark.parametrize("inner", [{"pattern": "^a"}, {"anyOf": [{}]}, {"$ref": "#/x"}, {"multipleOf": 2}, {"type": "text"}, {"type": ["string", "text"]}, {"items": {"uniqueItems": True}}, True])
def test_schemas_that_are_not_evaluated_in_full_are_refused(inner):
    with pytest.raises(ValueError):
        T.linked(None, None, {"t": {"type": "object", "properties": {"a": inner}}})


def test_more_keywords():
    several = {"type": ["string", "null"], "description": "any"}
    T.refuse_unknown({"type": "object", "properties": {"a": several}, "additionalProperties": {"type": "integer"}})
    assert T.violations(None, several) == T.violations("x", several) == [] and T.violations(1, several) == ["$: type"]
    assert T.violations(1.0, {"const": 1}) == [] and T.violations(True, {"const": 1}) == T.violations(float("inf"), {"const": 1}) == ["$: const"]
    assert T.violations({"a": 1, "b": "x"}, {"properties": {}, "additionalProperties": {"type": "integer"}}) == ["$.b: type"]


def test_ties_do_not_depend_on_the_files(spark):
    calls = [(c, i, 4, "translate", json.dumps({"to": to, "text": f"{to}{k}"}), [f"x{k}"]) for c in range(3) for i in ("x0", "x1") for k, to in enumerate(["en", "fr", "de", "en"])]
    results = [(c, i, 5, f"answer {k}") for c in range(3) for i in ("x0", "x1") for k in range(4)]
    out = run(spark, calls, results)
    assert out == run(spark, calls[::-1], results[::-1]) == brute(calls, results, SCHEMAS)
    spread = T.linked(spark.createDataFrame(calls, CALLS).repartition(7, "arguments"), spark.createDataFrame(results, RESULTS).repartition(5, "content"), SCHEMAS)
    assert got(spread) == out


def test_long_chain_takes_no_rounds(spark, monkeypatch):
    """A chain of needs of later calls, as long as its conversation, beside very long texts and identifiers."""
    settled = []
    monkeypatch.setattr(T, "settle", lambda df, real=T.settle: settled.append(1) or real(df))
    calls = [(c, f"c{i}", i, "translate", GOOD, [f"c{i + 1}"]) for c in range(2) for i in range(1500)]
    long = json.dumps({"to": "en", "text": "é\n" * 1_000_000}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    calls += [(5, "y" * 100_000, 1, "translate", long, ["z"]), (5, "z", 2, "translate", long, None)]
    results = [(5, "z", 3, "r" * 2_000_000)]
    rows = {(r[0], r[1]): r for r in run(spark, calls, results)}
    assert len(rows) == len(calls) and len(settled) < 8
    assert all(rows[c, f"c{i}"][5:7] == (1499, 1499 - i) for c in range(2) for i in range(1500))
    assert rows[5, "y" * 100_000][5:8] == (2, 1, "no result") and rows[5, "z"][7] == "ok"
    assert json.loads(rows[5, "z"][8]) == {"id": "z", "name": "translate", "arguments": json.loads(long), "result": "r" * 2_000_000}
