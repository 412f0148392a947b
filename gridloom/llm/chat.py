"""Chat formatting with linked tool calls.

Rows are messages (conv_id, turn, role, text). A text may be a JSON object that carries the tool protocol:

    system     {"content": ..., "tools": [{"function": {"name": ..., "parameters": <JSON schema>}}, ...]}
    assistant  {"content": ..., "tool_calls": [{"id": ..., "function": {"name": ..., "arguments": <object or its JSON text>}}, ...]}
    tool       {"tool_call_id": ..., "content": ...}

Any other text is the message's content. Calls and results are hash-joined on (conv_id, identifier). An identifier's
first call owns it; a result of an identifier without a call stays and is marked. A call whose
arguments hold {"$ref": <identifier>} needs that call's result. The order is topological: a call message comes after the results that it refers
to (the first of each; where there is none, after the call), a result after its call; otherwise the turn decides. Levels are found
by rounds of joins, at any depth; calls on or behind a cycle keep their turn and are marked.

Arguments are checked against the schema that the conversation declares for the tool: type, enum, const, required, properties,
additionalProperties, patternProperties, propertyNames, minProperties, maxProperties, items, prefixItems, minItems, maxItems, uniqueItems, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern, allOf, anyOf, oneOf and not. A schema with any other keyword
that could forbid something makes sound arguments "unchecked", with the keywords named. Every message becomes canonical JSON: sorted keys, no blanks, UTF-8.

No step gathers a conversation, so one that holds a third of all rows needs no care; ``transcripts`` gathers
segments of bounded size. Null text is empty content, null role "unknown"; null turns come last; rows without conv_id
are formatted but never linked. Exact repeats of a row are each formatted; their identifiers count once. JSON of more than MAX_DEPTH levels is
content as it stands, and its message has the status "too deep".
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LAST_TURN = (1 << 62) - 1
SEGMENT = 512
#: Levels of JSON that are read; the libraries' own limits are not far above.
MAX_DEPTH = 100
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _clean(value):
    """Lone surrogates, which UTF-8 can't hold, become U+FFFD."""
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, dict):
        return {_clean(k): _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, list) else value


class TooDeep(ValueError):
    """JSON of more than MAX_DEPTH levels."""


def _loads(text: str):
    """JSON of at most MAX_DEPTH levels; numbers that no float holds stay text. ValueError for all else."""
    depth = most = 0
    quoted = escaped = False
    for c in text if text.count("{") + text.count("[") > MAX_DEPTH else "":
        if quoted:
            escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"':
            quoted = True
        else:
            depth += (c in "{[") - (c in "}]")
            most = max(most, depth)
    if most > MAX_DEPTH:
        raise TooDeep
    found = json.loads(text, parse_constant=lambda c: c, parse_float=lambda x: float(x) if math.isfinite(float(x)) else x)
    return _clean(found) if _SURROGATE.search(text) else found


def _object(text: str | None) -> dict | None:
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        found = _loads(text)
    except TooDeep:
        raise
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _refs(value) -> Iterator[str]:
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                yield x["$ref"]
            todo += x.values()
        elif isinstance(x, list):
            todo += x


def _call(raw) -> dict | None:
    function = raw.get("function") if isinstance(raw, dict) else None
    if not isinstance(function, dict) or not isinstance(function.get("name"), str):
        return None
    arguments = function.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = _loads(arguments)
        except TooDeep:
            raise
        except ValueError:
            return {"id": _text(raw.get("id")), "name": function["name"], "arguments": None, "refs": []}
    return {"id": _text(raw.get("id")), "name": function["name"], "arguments": canonical(arguments), "refs": sorted(set(_refs(arguments)))}


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else canonical(value)


def parsed(role: str | None, text: str | None) -> dict:
    """content, calls, result_id and tools of a message, and whether its JSON is too deep to be read."""
    try:
        return _parsed(role, text)
    except TooDeep:
        return {"content": text, "calls": [], "result_id": None, "tools": [], "deep": True}


def _parsed(role: str | None, text: str | None) -> dict:
    out = {"content": text or "", "calls": [], "result_id": None, "tools": [], "deep": False}
    found = _object(text)
    if found is None:
        return out
    if role == "tool" and found.get("tool_call_id") is not None:
        return out | {"content": _text(found.get("content")) or "", "result_id": _text(found["tool_call_id"])}
    if role == "assistant" and isinstance(found.get("tool_calls"), list):
        calls = [_call(c) for c in found["tool_calls"]]
        if all(calls):
            return out | {"content": _text(found.get("content")) or "", "calls": calls}
    if role == "system" and isinstance(found.get("tools"), list):
        tools = [t["function"] for t in found["tools"] if isinstance(t, dict) and isinstance(t.get("function"), dict) and isinstance(t["function"].get("name"), str)]
        return out | {"content": _text(found.get("content")) or "", "tools": [{"name": t["name"], "schema": canonical(t.get("parameters", {}))} for t in tools]}
    return out


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return kind not in _TYPES or isinstance(value, _TYPES[kind])


#: Keywords that forbid nothing.
_REMARKS = {"$schema", "$id", "$comment", "$anchor", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}


class Check:
    """Validation of a value: what breaks the schema (``found``), and the keywords that weren't looked at (``unknown``)."""

    def __init__(self, value, schema):
        self.found: list[str] = []
        self.unknown: set[str] = set()
        self.look(value, schema, "$")

    def verdict(self) -> str:
        return "; ".join(sorted(self.found)) or ("unchecked: " + ", ".join(sorted(self.unknown)) if self.unknown else "valid")

    def _part(self, value, schema) -> list[str]:
        other = Check(value, schema)
        self.unknown |= other.unknown
        return other.found

    def look(self, value, schema, at: str) -> None:
        """A value {"$ref": identifier} stands for a result and fits any schema."""
        if schema is False:
            self.found.append(f"{at}: not allowed")
        if not isinstance(schema, dict) or isinstance(value, dict) and set(value) == {"$ref"}:
            return
        kinds = schema.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []
        if kinds and not any(_is(value, k) for k in kinds):
            self.found.append(f"{at}: not {' or '.join(map(str, kinds))}")
            return
        for keyword, rule in schema.items():
            check = getattr(self, f"_{keyword.lower()}", None) if keyword.isalpha() and keyword != "part" else None
            if check:
                check(value, rule, at, schema)
            elif keyword not in _REMARKS | {"type", "then", "else"} or keyword in ("then", "else") and "if" in schema:
                self.unknown.add(keyword)

    def say(self, wrong: bool, at: str, what: str) -> None:
        if wrong:
            self.found.append(f"{at}: {what}")

    def _enum(self, value, rule, at, schema):
        self.say(isinstance(rule, list) and not any(_same(value, e) for e in rule), at, "not in enum")

    def _const(self, value, rule, at, schema):
        self.say(not _same(value, rule), at, "not the constant")

    def _number(self, value, rule) -> bool:
        return _is(value, "number") and _is(rule, "number")

    def _minimum(self, value, rule, at, schema):
        self.say(self._number(value, rule) and (value < rule or schema.get("exclusiveMinimum") is True and value == rule), at, f"under {rule}")

    def _maximum(self, value, rule, at, schema):
        self.say(self._number(value, rule) and (value > rule or schema.get("exclusiveMaximum") is True and value == rule), at, f"over {rule}")

    def _exclusiveminimum(self, value, rule, at, schema):
        self.say(self._number(value, rule) and value <= rule, at, f"not over {rule}")

    def _exclusivemaximum(self, value, rule, at, schema):
        self.say(self._number(value, rule) and value >= rule, at, f"not under {rule}")

    def _multipleof(self, value, rule, at, schema):
        if self._number(value, rule) and rule > 0:
            self.say(Fraction(str(value)) % Fraction(str(rule)) != 0, at, f"not a multiple of {rule}")

    def _minlength(self, value, rule, at, schema):
        self.say(isinstance(value, str) and _is(rule, "integer") and len(value) < rule, at, f"shorter than {rule}")

    def _maxlength(self, value, rule, at, schema):
        self.say(isinstance(value, str) and _is(rule, "integer") and len(value) > rule, at, f"longer than {rule}")

    def _pattern(self, value, rule, at, schema):
        if isinstance(value, str) and isinstance(rule, str):
            found = _search(rule, value)
            self.unknown |= {"pattern"} if found is None else set()
            self.say(found is False, at, "doesn't match the pattern")

    def _minitems(self, value, rule, at, schema):
        self.say(isinstance(value, list) and _is(rule, "integer") and len(value) < rule, at, f"fewer than {rule} items")

    def _maxitems(self, value, rule, at, schema):
        self.say(isinstance(value, list) and _is(rule, "integer") and len(value) > rule, at, f"more than {rule} items")

    def _uniqueitems(self, value, rule, at, schema):
        self.say(rule is True and isinstance(value, list) and len({_key(x) for x in value}) < len(value), at, "items repeat")

    def _prefixitems(self, value, rule, at, schema):
        if isinstance(value, list) and isinstance(rule, list):
            for i, (x, s) in enumerate(zip(value, rule)):
                self.look(x, s, f"{at}[{i}]")

    def _items(self, value, rule, at, schema):
        before = schema.get("prefixItems")
        skip = len(before) if isinstance(before, list) else 0
        for i, x in enumerate(value if isinstance(value, list) else []):
            if isinstance(rule, list):  # the older spelling of prefixItems
                self.look(x, rule[i] if i < len(rule) else None, f"{at}[{i}]")
            elif i >= skip:
                self.look(x, rule, f"{at}[{i}]")

    def _required(self, value, rule, at, schema):
        for k in rule if isinstance(rule, list) and isinstance(value, dict) else []:
            self.say(k not in value, f"{at}.{k}", "missing")

    def _minproperties(self, value, rule, at, schema):
        self.say(isinstance(value, dict) and _is(rule, "integer") and len(value) < rule, at, f"fewer than {rule} properties")

    def _maxproperties(self, value, rule, at, schema):
        self.say(isinstance(value, dict) and _is(rule, "integer") and len(value) > rule, at, f"more than {rule} properties")

    def _properties(self, value, rule, at, schema):
        if isinstance(value, dict) and isinstance(rule, dict):
            for k in sorted(set(value) & set(rule)):
                self.look(value[k], rule[k], f"{at}.{k}")

    def _patternproperties(self, value, rule, at, schema):
        for k in sorted(value) if isinstance(value, dict) and isinstance(rule, dict) else []:
            for pattern, own in rule.items():
                if _search(pattern, k):
                    self.look(value[k], own, f"{at}.{k}")

    def _additionalproperties(self, value, rule, at, schema):
        named = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        patterns = schema.get("patternProperties") if isinstance(schema.get("patternProperties"), dict) else {}
        for k in sorted(value) if isinstance(value, dict) else []:
            if k not in named and not any(_search(p, k) for p in patterns):
                self.say(rule is False, f"{at}.{k}", "unknown")
                self.look(value[k], rule if isinstance(rule, dict) else None, f"{at}.{k}")

    def _propertynames(self, value, rule, at, schema):
        for k in sorted(value) if isinstance(value, dict) else []:
            self.look(k, rule, f"{at}.{k}")

    def _allof(self, value, rule, at, schema):
        for own in rule if isinstance(rule, list) else []:
            self.look(value, own, at)

    def _anyof(self, value, rule, at, schema):
        self.say(isinstance(rule, list) and all([self._part(value, own) for own in rule]), at, "fits no alternative")

    def _oneof(self, value, rule, at, schema):
        self.say(isinstance(rule, list) and sum(not self._part(value, own) for own in rule) != 1, at, "doesn't fit exactly one alternative")

    def _not(self, value, rule, at, schema):
        self.say(isinstance(rule, (dict, bool)) and rule is not False and not self._part(value, rule), at, "fits what it must not")


def _key(value) -> str:
    """Canonical JSON in which equal numbers look alike."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{_key(v)}" for k, v in sorted(value.items())) + "}"
    return "[" + ",".join(map(_key, value)) + "]" if isinstance(value, list) else canonical(value)


def _same(a, b) -> bool:
    return _key(a) == _key(b)


def _search(pattern: str, text: str) -> bool | None:
    """Whether a pattern is found in a text; None if it can't be compiled."""
    try:
        return re.search(pattern, text) is not None
    except re.error:
        return None


def verdict(arguments: str | None, schema: str | None) -> str:
    """valid, no schema, malformed arguments, unchecked: keywords, or what is wrong."""
    if arguments is None:
        return "malformed arguments"
    if schema is None:
        return "no schema"
    return Check(json.loads(arguments), json.loads(schema)).verdict()


_PARSED = "array<struct<id string, name string, arguments string, refs array<string>>>"


def _parse(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("refs", pa.list_(pa.string()))])
        tool = pa.struct([("name", pa.string()), ("schema", pa.string())])
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                found = [parsed(r, t) for r, t in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
                more = [pa.array([f[n] for f in found], kind) for n, kind in (("content", pa.string()), ("calls", pa.list_(call)), ("result_id", pa.string()), ("tools", pa.list_(tool)), ("deep", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *more], ["uid", "conv_id", "turn", "role", "content", "calls", "result_id", "tools", "deep"])

    slim = messages.select(F.monotonically_increasing_id().alias("uid"), F.col("conv_id").cast("string").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), "text")
    return slim.mapInArrow(run, f"uid long, conv_id string, turn long, role string, content string, calls {_PARSED}, result_id string, tools array<struct<name string, schema string>>, deep boolean")


def _levels(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Per call message (uid): level, and turn' (no earlier than the results it refers to). Rounds of joins.

    ``answers``: conv_id, id, and the turn of the first result.

    Level 0 refers to no call; level n + 1 to calls up to level n. Messages on or behind a cycle get level -1.

    A row (uid, needs, steps, turn') says: level at least that of ``needs`` plus steps, and turn' at least its turn' and this one; without
    ``needs`` the two are meant as they are. Each round puts the rows of messages that need at most one other in the place of
    references to them, so a chain halves and takes a logarithmic number of rounds; messages that need several others which don't fall
    together take a round a level. What needs nothing more is done. No path without a cycle has as many steps as there are messages.
    """
    owners = calls.where("id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "uid")).alias("o"))
    owners = owners.select("conv_id", F.col("id").alias("ref"), F.col("o.uid").alias("needs"))
    needs = calls.select("conv_id", "uid", "turn", F.explode("refs").alias("ref")).join(owners.hint("shuffle_hash"), ["conv_id", "ref"])
    needs = needs.join(answers.withColumnsRenamed({"id": "ref", "turn": "answered"}).hint("shuffle_hash"), ["conv_id", "ref"], "left")
    needs = needs.groupBy("uid", "needs").agg(F.max(F.greatest("turn", "answered")).alias("at"))
    needs = materialize(needs.select("uid", "needs", F.lit(1).cast("long").alias("steps"), "at"), "needs")
    nodes = calls.select("uid", "turn").distinct()
    if needs.isEmpty():
        return nodes.select("uid", F.lit(0).alias("level"), F.col("turn").alias("at"))
    nodes = materialize(nodes, "nodes")
    most = nodes.count()
    rows = nodes.select("uid", F.lit(None).cast("long").alias("needs"), F.lit(0).cast("long").alias("steps"), F.col("turn").alias("at")).unionByName(needs)
    while True:
        plain = rows.groupBy("uid").agg(F.count("needs").alias("open"), F.max(F.when(F.col("needs").isNotNull(), F.col("steps"))).alias("far"))
        plain = plain.where(f"open = 0 OR open = 1 AND far < {most}").select(F.col("uid").alias("needs"))
        inner = rows.select(F.col("uid").alias("needs"), F.col("needs").alias("next"), F.col("steps").alias("more"), F.col("at").alias("after")).join(plain, "needs")
        moving = rows.where(f"needs IS NOT NULL AND steps < {most}").join(inner, "needs", "left").withColumn("moved", F.col("more").isNotNull())
        moving = moving.select("uid", F.when(F.col("moved"), F.col("next")).otherwise(F.col("needs")).alias("needs"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.greatest("at", "after").alias("at"), "moved")
        still = rows.where(f"needs IS NULL OR steps >= {most}").withColumn("moved", F.lit(False))
        after = still.unionByName(moving).groupBy("uid", "needs").agg(F.max("steps").alias("steps"), F.max("at").alias("at"), F.max("moved").alias("moved"))
        after = materialize(after, "level")
        rows = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    ends = rows.groupBy("uid").agg(F.count("needs").alias("open"), F.max("steps").alias("level"), F.max("at").alias("at"))
    ends = ends.join(nodes, "uid")
    return ends.select("uid", F.when(F.col("open") == 0, F.col("level")).otherwise(-1).cast("int").alias("level"), F.when(F.col("open") == 0, F.col("at")).otherwise(F.col("turn")).alias("at"))


def format_messages(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, order_turn, order_step, role, json, n_calls, n_linked, n_invalid, status.

    Sorting a conversation by (order_turn, order_step, turn, json) gives the topological order. n_linked counts a call
    message's calls that have a result, and is 1 for a linked result; n_invalid counts calls whose arguments break
    their schema or are malformed. status: ok, unmatched result, duplicate result, cyclic, or too deep.
    """
    kind = messages.schema["conv_id"].dataType
    rows = materialize(_parse(messages), "messages")
    calls = materialize(rows.select("uid", "conv_id", "turn", F.posexplode("calls").alias("pos", "call")).select("uid", "conv_id", "turn", "pos", "call.*"), "calls")
    tools = rows.select("conv_id", "turn", "uid", F.explode("tools").alias("t")).groupBy("conv_id", F.col("t.name").alias("name"))
    tools = tools.agg(F.min_by("t.schema", F.struct("turn", "uid")).alias("schema")).where("conv_id IS NOT NULL")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(a, s) for a, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(found, pa.string())], ["uid", "conv_id", "turn", "pos", "id", "verdict"])

    judged = calls.join(tools.hint("shuffle_hash"), ["conv_id", "name"], "left").select("arguments", "schema", "uid", "conv_id", "turn", "pos", "id")
    judged = materialize(judged.mapInArrow(judge, "uid long, conv_id string, turn long, pos int, id string, verdict string"), "judged")
    results = rows.where("result_id IS NOT NULL").select("uid", "conv_id", "turn", F.col("result_id").alias("id"))
    first = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "uid")).alias("f")).select("conv_id", "id", F.col("f.uid").alias("first"), F.col("f.turn").alias("turn"))
    first = materialize(first, "first")
    levels = materialize(_levels(calls.select("uid", "conv_id", "turn", "id", "refs"), first.drop("first")), "levels")

    # one owner per identifier, one first result per identifier: the join has at most one match on either side
    owners = judged.where("id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "uid", "pos")).alias("o"))
    owners = owners.select("conv_id", "id", F.col("o.uid").alias("owner"), F.col("o.pos").alias("owner_pos")).join(levels.withColumnRenamed("uid", "owner"), "owner")
    linked = materialize(owners.join(first.drop("turn").hint("shuffle_hash"), ["conv_id", "id"]).select("conv_id", "id", "owner", "owner_pos", "first", "level", "at"), "linked")
    placed = results.join(linked.hint("shuffle_hash"), ["conv_id", "id"], "left").select(
        "uid", F.when(F.col("owner").isNull(), "unmatched result").when(F.col("uid") != F.col("first"), "duplicate result").otherwise("ok").alias("r_status"),
        F.greatest("turn", "at").alias("r_at"), (2 * F.greatest(F.col("level"), F.lit(0)) + 1).alias("r_step"), F.col("owner").isNotNull().alias("r_linked"),
    )
    has = linked.select(F.col("owner").alias("uid"), F.col("owner_pos").alias("pos"), F.lit(1).alias("answered"))
    facts = judged.join(has, ["uid", "pos"], "left").groupBy("uid").agg(
        F.count("answered").alias("c_linked"), F.count(F.when(~F.col("verdict").isin("valid", "no schema") & ~F.col("verdict").startswith("unchecked: "), 1)).alias("c_invalid"),
        F.sort_array(F.collect_list(F.struct("pos", "verdict"))).alias("verdicts"),
    )
    facts = facts.join(levels, "uid").withColumnsRenamed({"at": "c_at", "level": "c_level"})
    whole = rows.join(placed, "uid", "left").join(facts, "uid", "left").select(
        F.col("conv_id").cast(kind).alias("conv_id"), F.when(F.col("turn") < LAST_TURN, F.col("turn")).alias("turn"), F.coalesce("r_at", "c_at", "turn").alias("order_turn"),
        F.coalesce(F.col("r_step").cast("long"), F.when(F.col("c_level") > 0, 2 * F.col("c_level").cast("long")), F.lit(0).cast("long")).alias("order_step"), "role", "content", "calls", "result_id", "tools",
        F.col("verdicts.verdict").alias("verdicts"), F.size("calls").cast("long").alias("n_calls"), F.coalesce("c_linked", F.col("r_linked").cast("long"), F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("c_invalid", F.lit(0)).cast("long").alias("n_invalid"), F.coalesce("r_status", F.when(F.col("c_level") < 0, "cyclic"), F.when(F.col("deep"), "too deep"), F.lit("ok")).alias("status"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ["conv_id", "turn", "order_turn", "order_step", "role", "n_calls", "n_linked", "n_invalid", "status"]
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                texts = [message_json(r) for r in part.select(["role", "content", "calls", "result_id", "tools", "verdicts"]).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "json"])

    return whole.mapInArrow(write, f"conv_id {kind.simpleString()}, turn long, order_turn long, order_step long, role string, n_calls long, n_linked long, n_invalid long, status string, json string")


def message_json(row: dict) -> str:
    out = {"role": row["role"], "content": row["content"]}
    if row["calls"]:
        verdicts = row["verdicts"] or []
        out["tool_calls"] = [
            {"id": c["id"], "type": "function", "function": {"name": c["name"], "arguments": json.loads(c["arguments"]) if c["arguments"] is not None else None}, "validation": v}
            for c, v in zip(row["calls"], verdicts)
        ]
    if row["result_id"] is not None:
        out["tool_call_id"] = row["result_id"]
    if row["tools"]:
        out["tools"] = [{"type": "function", "function": {"name": t["name"], "parameters": json.loads(t["schema"])}} for t in row["tools"]]
    return canonical(out)


def transcripts(formatted: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation and segment of at most ``segment`` messages: conv_id, segment, messages (a JSON array in order).

    The messages are sorted across tasks and numbered as they lie; a message's rank is its number less that of the first of its conversation in the
    task, and the conversation's messages in tasks before. So a conversation may span any number of tasks.
    """
    order = ["conv_id", "order_turn", "order_step", "turn", "json"]
    ordered = formatted.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialize(ordered.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("n")), "ordered")
    parts = ordered.groupBy("conv_id", "task").agg(F.min("n").alias("begin"), F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumnRenamed("conv_id", "conv")
    ranked = ordered.join(parts.withColumnRenamed("task", "part"), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("task") == F.col("part")))
    ranked = ranked.withColumn("rank", F.col("n") - F.col("begin") + F.col("before")).withColumn("segment", F.floor(F.col("rank") / segment))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "json"))), lambda x: x["json"])
    return ranked.groupBy("conv_id", "segment").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("messages"))
