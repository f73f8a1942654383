"""Tool calls of conversations: linked to their results, put in order, checked and written as canonical JSON.

Calls and results are joined by conversation and identifier. A call may need the results of others; the order respects
that and otherwise follows the turns. A call's label is its own turn, or that of the call it needs and one step more,
whichever comes later. Where the turns respect all needs of a conversation, every label is the turn. Other conversations
are labelled whole, each by one task, if their identifiers are at most ``SMALL`` bytes. Longer ones are never collected:
every call starts with its own turn as label, a call that needs one with a label not before its own takes that label and
one step more, and this repeats until no label changes. Their cycles are found beforehand, among the few calls that can
lie on one.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import scan, settle
from .common import slices, small_batches

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_CALL = ["conv_id", "call_id"]
#: Bytes of identifiers, and ``ROW_BYTES`` for every call and need, up to which one task orders a conversation.
SMALL = 1 << 20
ROW_BYTES = 32
LAST = (1 << 63) - 1


def canonical(value) -> str:
    """JSON with sorted keys, without white space, whole numbers without fraction; ValueError for what JSON lacks."""

    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("a number that JSON lacks")
            return int(v) if v.is_integer() and abs(v) < 1 << 53 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str | None):
    """Strict JSON: no repeated keys, no NaN."""

    def unique(pairs):
        if len(dict(pairs)) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(name)

    return json.loads(text or "", object_pairs_hook=unique, parse_constant=refuse)


#: Keywords of a schema that ``violations`` evaluates, and those that say nothing about a value.
EVALUATED = {
    "type", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "properties", "required", "additionalProperties", "items",
}
ANNOTATIONS = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly"}


def refuse_unknown(schema, at: str = "$") -> None:
    """ValueError for a schema with a keyword, type or form that ``violations`` does not evaluate."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema must be an object")
    if odd := sorted(set(schema) - EVALUATED - ANNOTATIONS):
        raise ValueError(f"{at}: keywords that are not evaluated: {', '.join(odd)}")
    kinds = schema.get("type", [])
    if odd := [k for k in (kinds if isinstance(kinds, list) else [kinds]) if k not in {*_TYPES, "number", "integer"}]:
        raise ValueError(f"{at}: unknown types: {odd}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        refuse_unknown(schema["additionalProperties"], f"{at}.*")
    for k, inner in schema.get("properties", {}).items():
        refuse_unknown(inner, f"{at}.{k}")
    if "items" in schema:
        refuse_unknown(schema["items"], f"{at}[]")


def same(value, other) -> bool:
    """Equal as JSON: 1 is 1.0, but not true."""
    try:
        return canonical(value) == canonical(other)
    except ValueError:
        return False


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema a value violates: type, enum, const, bounds, lengths, required and further properties, items."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, list):
        fits = any(not violations(value, {"type": k}) for k in kind)
    elif kind == "number":
        fits = number
    elif kind == "integer":
        fits = number and float(value).is_integer()
    else:
        fits = kind is None or isinstance(value, _TYPES[kind])
    if not fits:
        return [f"{at}: type"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: const")
    if number and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        out.append(f"{at}: bounds")
    if isinstance(value, (str, list)) and not schema.get("minLength", schema.get("minItems", 0)) <= len(value) <= schema.get("maxLength", schema.get("maxItems", len(value))):
        out.append(f"{at}: length")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in value if k not in known]
        elif isinstance(schema.get("additionalProperties"), dict):
            for k in value.keys() - known.keys():
                out += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
        for k in known:
            if k in value:
                out += violations(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return sorted(out)


def cyclic_calls(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, call_id`` of the calls that lie on a cycle of needs, or between two.

    Along a cycle, turns go up by needs of later calls only, so all of it lies within the spans of such needs, from the
    call to what it needs. The calls outside are left aside at once; of those inside, calls without needs or without
    dependents among them are peeled off until none is left to peel, which takes as many rounds as the longest chain
    within touching spans.
    """
    turns = calls.select(*_CALL, "turn")
    both = edges.join(turns, _CALL).join(turns.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn")), ["conv_id", "need"])
    spans = settle(both.filter("need_turn >= turn").select("conv_id", F.col("turn").alias("low"), F.col("need_turn").alias("high")))
    if spans.isEmpty():
        return calls.select(*_CALL).limit(0)
    # at one turn, spans begin before the calls are looked at and end after that
    ends = F.array(*(F.struct(F.col(c).alias("at"), F.lit(k).alias("kind"), F.lit(d).cast("long").alias("change")) for c, k, d in (("low", 0, 1), ("high", 2, -1))))
    marks = spans.select("conv_id", F.lit(None).cast("string").alias("call_id"), F.inline(ends))
    looked = calls.join(spans.select("conv_id").distinct(), "conv_id", "left_semi").select(
        *_CALL, F.col("turn").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("change")
    )
    open_spans = scan(settle(marks.unionByName(looked)), ["conv_id"], [F.col("at"), F.col("kind")], running={"open": F.col("change")})
    inside = settle(open_spans.filter("kind = 1 AND open > 0").select(*_CALL))
    left, n = edges, None
    while True:
        left = settle(left.join(inside, _CALL).join(inside.withColumnRenamed("call_id", "need"), ["conv_id", "need"]).select("conv_id", "call_id", "need"))
        if n == (n := left.count()):
            return inside
        inside = settle(left.select(*_CALL).intersect(left.select("conv_id", F.col("need").alias("call_id"))))


def peeled(waits: Mapping[str, list[str]], frees: Mapping[str, list[str]]) -> list[str]:
    """The keys of ``waits`` so that all a key waits for comes before it; those that wait for a cycle are left out.

    ``frees`` is the other direction; names in it that are no keys of ``waits`` are passed over.
    """
    left = {c: len(w) for c, w in waits.items()}
    out = [c for c, n in left.items() if not n]
    for c in out:  # grows while it is read
        for d in frees.get(c, ()):
            if d in left:
                left[d] -= 1
                if not left[d]:
                    out.append(d)
    return out


def labels_of(turn: Mapping[str, int], needs: Mapping[str, list[str]]) -> dict[str, tuple[int, int] | None]:
    """The label of every call of a conversation, in a time that grows with its calls and needs; None on a cycle, or
    between two."""
    users = defaultdict(list)
    for c, wanted in needs.items():
        for n in wanted:
            users[n].append(c)
    order = peeled({c: needs.get(c, []) for c in turn}, users)
    rest = set(turn).difference(order)
    # of those that wait for a cycle, the ones that no cycle waits for have a place
    order += reversed(peeled({c: [u for u in users[c] if u in rest] for c in rest}, needs))
    out: dict[str, tuple[int, int] | None] = dict.fromkeys(turn)
    for c in order:
        before = [out[n] for n in needs.get(c, ()) if out[n] is not None]
        out[c] = max([(turn[c], 0), *((t, step + 1) for t, step in before)])
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 16):
        rows, numbers = [], []
        for i, calls in enumerate(batch.column(1).to_pylist()):
            needs = defaultdict(list)
            for c in calls:
                if c["need"] is not None:
                    needs[c["call_id"]].append(c["need"])
            found = labels_of({c["call_id"]: c["turn"] for c in calls if c["need"] is None}, needs)
            numbers += [i] * len(found)
            rows += [(c, *(label or (LAST, 0)), label is None) for c, label in found.items()]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(numbers, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            [*_CALL, "order_turn", "order_step", "cyclic"],
        )


def ordered(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``conv_id, call_id, order_turn, order_step, cyclic`` of calls (``conv_id, call_id, turn``, each once).

    ``needs`` has ``conv_id, call_id, need``: a call comes after the call it needs; needs that are no calls of the
    conversation are ignored. Sorting by (order_turn, order_step) is a topological order. Calls on a cycle of needs
    have no place in one and come last, and needs of such calls, which cannot be met, are ignored, too.
    """
    calls = settle(calls)
    at = calls.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"))
    edges = settle(
        needs.distinct().join(at, ["conv_id", "need"]).join(calls, _CALL).select("conv_id", "call_id", "need", (F.col("need_turn") >= F.col("turn")).alias("back"))
    )
    of_calls = calls.select(*_CALL, "turn", F.lit(None).cast("string").alias("need"), F.lit(False).alias("back"))
    rows = of_calls.unionByName(edges, allowMissingColumns=True)
    size = F.sum(F.octet_length("call_id") + F.coalesce(F.octet_length("need"), F.lit(0)) + ROW_BYTES).alias("size")
    # the sizes are written first, so that the rows of a long conversation can be split in the joins
    sizes = settle(rows.groupBy("conv_id").agg(size, F.bool_or("back").alias("back")).filter("back").select("conv_id", "size"))
    start = calls.select(*_CALL, F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_step"), F.lit(False).alias("cyclic"))
    touched = settle(rows.drop("back").join(sizes, "conv_id"))
    small, large = touched.filter(F.col("size") <= SMALL), touched.filter(F.col("size") > SMALL)
    whole = small.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "turn", "need")).alias("calls"))
    fields = f"conv_id {calls.schema['conv_id'].dataType.simpleString()}, call_id string, order_turn long, order_step long, cyclic boolean"
    out = start.join(sizes, "conv_id", "left_anti").unionByName(small_batches(whole).mapInArrow(_labelled, fields))
    if large.isEmpty():
        return out
    return out.unionByName(relabelled(large.filter("need IS NULL").select(*_CALL, "turn"), large.filter("need IS NOT NULL").select(*_CALL, "need")))


def relabelled(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``ordered`` of conversations of any length, in as many rounds as the longest chain of needs of later calls."""
    cyclic = settle(cyclic_calls(calls, edges))
    edges = settle(edges.join(cyclic, _CALL, "left_anti").join(cyclic.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_anti"))
    labels = settle(calls.select(*_CALL, F.struct("turn", F.lit(0).cast("long").alias("step")).alias("label")))
    while True:
        after = F.struct(F.col("label.turn").alias("turn"), (F.col("label.step") + 1).alias("step"))
        pushed = edges.join(labels.select("conv_id", F.col("call_id").alias("need"), "label"), ["conv_id", "need"]).groupBy(*_CALL).agg(F.max(after).alias("pushed"))
        moved = settle(labels.join(pushed, _CALL).filter("pushed > label").select(*_CALL, "pushed"))
        if moved.isEmpty():
            break
        labels = settle(labels.join(moved, _CALL, "left").select(*_CALL, F.coalesce("pushed", "label").alias("label")))
    last = F.struct(F.lit(LAST).alias("turn"), F.lit(0).cast("long").alias("step"))
    flagged = labels.join(cyclic.withColumn("cyclic", F.lit(True)), _CALL, "left")
    placed = F.when(F.col("cyclic"), last).otherwise(F.col("label"))
    return flagged.select(*_CALL, placed["turn"].alias("order_turn"), placed["step"].alias("order_step"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and one per result without a call.

    ``calls``: ``conv_id, call_id, turn, name, arguments`` (JSON text), ``needs`` (array of call ids).
    ``results``: ``conv_id, call_id, turn, content``. ``schemas``: a JSON schema per tool, a fixed setting;
    one with a keyword that is not evaluated is a ValueError.

    Columns ``conv_id, call_id, name, call_turn, result_turn, order_turn, order_step, status, errors, json``. Status:
    ``ok``, ``no result``, ``early result`` (before its call), ``invalid`` (unknown tool, arguments that are no JSON
    object or violate the schema; ``errors`` says which), ``cycle``, ``repeated`` (an identifier used again: the
    earliest call owns it, and the earliest result answers it; of equal turns, that whose content has the smallest
    digest, so only rows that repeat everything are interchangeable), ``orphan`` (a result without call). ``json`` is the
    canonical form of the call with its result, null where the arguments are no JSON.

    Conversations and identifiers may be null: such rows are ``orphan`` or ``no result``, linked to nothing. A missing
    turn comes after all others. Arguments and contents of any length are parsed and written whole, one row at a time.
    Other columns are ignored; empty tables give no rows.
    """
    for name, schema in schemas.items():
        refuse_unknown(schema, name)
    small_batches(calls)
    tag = F.monotonically_increasing_id().alias("tag")
    wanted = F.coalesce("needs", F.array().cast("array<string>"))
    said = F.sha2(F.to_json(F.array("name", "arguments", F.to_json(wanted))), 256).alias("digest")
    calls = settle(calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "name", "arguments", wanted.alias("needs"), tag, said))
    answer = F.sha2(F.to_json(F.array("content")), 256).alias("digest")
    results = settle(results.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "content", tag, answer))

    def owners(rows: DataFrame) -> DataFrame:
        # the tag decides between rows that are alike in everything
        first = F.min(F.struct(F.col("turn").isNull().alias("unknown"), "turn", "digest", "tag")).alias("first")
        return rows.dropna(subset=_CALL).groupBy(*_CALL).agg(first).select(*_CALL, F.col("first.tag").alias("tag"))

    owning, answering = owners(calls), owners(results)
    # joined by the row's number, so an identifier that is used over and over is no hot key
    own_calls = calls.join(owning.select("tag"), "tag", "left_semi")
    own_results = results.join(answering.select("tag"), "tag", "left_semi")
    known = F.coalesce("turn", F.lit(0))
    order = ordered(own_calls.select(*_CALL, known.alias("turn")), own_calls.select(*_CALL, F.explode("needs").alias("need")))
    owned = own_calls.join(order, _CALL).join(own_results.select(*_CALL, F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered")), _CALL, "left")
    again = calls.join(owning.select("tag"), "tag", "left_anti").withColumns(
        {"order_turn": known, "order_step": F.lit(0).cast("long"), "again": F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()}
    )
    rows = owned.withColumn("again", F.lit(False)).unionByName(again, allowMissingColumns=True).select(
        *_CALL, "name", F.col("turn").alias("call_turn"), "result_turn", "order_turn", "order_step", "arguments", "content",
        F.coalesce("answered", F.lit(False)).alias("answered"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "again",
    )
    fields = "conv_id: bigint, call_id: string, name: string, call_turn: bigint, result_turn: bigint, order_turn: bigint, order_step: bigint, status: string, errors: string, json: string"
    checked = rows.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(_checked(schemas), fields.replace(":", ""))
    unanswered = results.join(own_results.join(owning, _CALL, "left_semi").select("tag"), "tag", "left_anti")
    return checked.unionByName(
        unanswered.join(owning.select(*_CALL, F.lit(True).alias("called")), _CALL, "left").select(
            F.col("conv_id").cast("long").alias("conv_id"), "call_id", F.col("turn").alias("result_turn"),
            F.when(F.col("called"), "repeated").otherwise("orphan").alias("status"),
        ),
        allowMissingColumns=True,
    )


def _checked(schemas: dict[str, dict]):
    def one(row: dict) -> tuple[str, str | None, str | None]:
        errors, text = [], None
        schema = schemas.get(row["name"])
        if schema is None:
            errors.append("$: unknown tool")
        try:
            arguments = parsed(row["arguments"])
            whole = {"arguments": arguments, "id": row["call_id"], "name": row["name"]}
            text = canonical(whole | {"result": row["content"]} if row["answered"] else whole)
            if not isinstance(arguments, dict):
                errors.append("$: type")
            elif schema is not None:
                errors += violations(arguments, schema)
        except (ValueError, RecursionError):
            errors.append("$: not JSON")
        early = row["answered"] and row["call_turn"] is not None and row["result_turn"] is not None and row["result_turn"] <= row["call_turn"]
        status = (
            "repeated" if row["again"] else "cycle" if row["cyclic"] else "invalid" if errors
            else "no result" if not row["answered"] else "early result" if early else "ok"
        )
        return status, "; ".join(errors) or None, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(zip(*map(one, batch.to_pylist())))
            kept = ["conv_id", "call_id", "name", "call_turn", "result_turn", "order_turn", "order_step"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *(pa.array(c, pa.string()) for c in found)], [*kept, "status", "errors", "json"])

    return run
