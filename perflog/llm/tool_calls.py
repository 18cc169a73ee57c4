"""Tool-call linking for chat formatting (operator 10).

Messages hold calls as ``<tool_call>{"id", "name", "arguments", "after"}</tool_call>`` blocks
and results as messages of role ``tool`` with ``{"tool_call_id", "content"}``. Calls and
results meet in a hash join by conversation and identifier. ``after`` names calls that must
come first. Calls are ordered by the place of the last call they wait for: a call's rank is
its own place, or the rank of a call it waits for with one hop added, whichever is greater.
Ranks settle in as many rounds as displaced calls follow one another; calls that wait only
for earlier ones need none. Ranks that exceed the number of displaced calls of a conversation lie on or behind
a circle. Arguments are validated against the tool's schema, and each call with its result
becomes one line of canonical JSON (sorted keys, no blanks, UTF-8).

One row per call or unmatched result, so a conversation of any length needs no single task.
``status``: ok, bad_json, unknown_tool, bad_arguments, no_result, circular, orphan_result, duplicate_id (a
second call of one id, with its own name, place and faults; the earliest counts) or no_id. Of several results of a call the
earliest is used; n_results counts them. Waiting for an unknown id waits for nothing. Messages with a
null conversation, text or identifier are kept as no_id where they hold a call or result,
and otherwise give no row. Repeated rows are duplicates. An empty table gives no rows.

bad_json is what can't be written as JSON again, too: numbers that are not finite, halves of surrogate pairs, and nesting
deeper than the parser follows (of which the identifier is read by a pattern). Turns beyond 2 ** 42 count as 2 ** 42.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perflog.llm.runtime import ready, stage

BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


ID = {"call": re.compile(r'"id"\s*:\s*"([^"\\]*)"'), "result": re.compile(r'"tool_call_id"\s*:\s*"([^"\\]*)"')}
MOST_TURN = 1 << 42


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def clean(value):
    """``value`` as text, None if it is none or can't be written."""
    try:
        text = value if isinstance(value, str) else None if value is None else canonical(value)
        if text is not None:
            text.encode()
        return text
    except (ValueError, RecursionError):
        return None


def decode(raw: str, kind: str) -> tuple[dict, bool]:
    """A block's object and whether it is bad."""
    try:
        x = json.loads(raw)
    except RecursionError:
        found = ID[kind].search(raw)
        return ({"id": found[1], "tool_call_id": found[1]} if found else {}), True
    except ValueError:
        return {}, True
    if not isinstance(x, dict):
        return {}, True
    try:
        canonical(x).encode()
    except (ValueError, RecursionError):
        return x, True
    return x, False


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema`` (the usual keywords of JSON schemas for tool arguments)."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
    fits = {"number": number, "integer": number and whole}.get(
        kind, kind is None or isinstance(value, TYPES.get(kind, object)))
    if not fits:
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if number and not (schema.get("minimum", value) <= value <= schema.get("maximum", value)):
        out.append(f"{at}: out of range")
    if isinstance(value, str) and not (schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))):
        out.append(f"{at}: length")
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in faults(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        out += [x for k in sorted(known) if k in value for x in faults(value[k], known[k], f"{at}.{k}")]
    return out


def parse(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, place (turn and number in it), kind (call or result), call_id, name, payload (arguments or content), after, bad."""
    conv = messages.schema[conv_col].dataType.simpleString()
    schema = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()),
                        ("payload", pa.string()), ("after", pa.list_(pa.string())), ("bad", pa.bool_())])

    def run(batches):
        for b in batches:
            rows = []
            for i, (turn, role, text) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                if not text:
                    continue
                place = max(-MOST_TURN, min(MOST_TURN, turn if turn is not None else 0)) << 20
                blocks = [("result", text)] if role == "tool" else [("call", x) for x in BLOCK.findall(text)] if "<tool_call>" in text else []
                for k, (kind, raw) in enumerate(blocks):
                    x, bad = decode(raw, kind)
                    after = x.get("after") if isinstance(x.get("after"), list) else []
                    payload = clean(x.get("content")) if kind == "result" else raw if bad else canonical(x.get("arguments"))
                    rows.append({"row": i, "place": place + k, "kind": kind, "bad": bad, "call_id": clean(x.get("id") if kind == "call" else x.get("tool_call_id")),
                                 "name": clean(x.get("name")), "payload": raw if bad and not x else payload, "after": [a for a in map(clean, after) if a is not None]})
            t = pa.Table.from_pylist(rows, schema=schema)
            out = [b.column(0).take(t.column("row").combine_chunks() if t.num_rows else pa.array([], pa.int64()))]
            yield pa.RecordBatch.from_arrays(out + [c.combine_chunks() if t.num_rows else pa.array([], c.type) for c in t.columns[1:]],
                                             ["conv", *schema.names[1:]])

    return messages.select(conv_col, turn_col, role_col, text_col).mapInArrow(
        run, f"conv {conv}, place long, kind string, call_id string, name string, payload string, after array<string>, bad boolean")


def ranks(calls: DataFrame) -> DataFrame:
    """conv, call_id, at, hop, circular for calls (conv, call_id, place, after) of different ids."""
    waits = calls.select("conv", "call_id", F.explode(F.array_distinct("after")).alias("wait"))
    known = calls.select("conv", F.col("call_id").alias("wait"), F.col("place").alias("wait_place"))
    waits = waits.join(known, ["conv", "wait"]).join(calls.select("conv", "call_id", "place"), ["conv", "call_id"])
    waits = stage(waits, "waits")
    now = calls.select("conv", "call_id", F.col("place").alias("at"), F.lit(0).cast("long").alias("hop"))
    if waits.where("wait_place >= place").isEmpty():
        return now.withColumn("circular", F.lit(False))
    # the conversations with calls that wait for a later one; only theirs can move
    moved = waits.where("wait_place >= place").select("conv").distinct()
    waits = stage(waits.join(moved, "conv").select("conv", "call_id", "wait"), "waits")
    total = calls.join(moved, "conv").groupBy("conv").agg(F.count(F.lit(1)).alias("total"))
    part = stage(now.join(total, "conv").withColumn("circular", F.lit(False)), "ranks")
    while True:
        far = (waits.join(part.select("conv", F.col("call_id").alias("wait"), "at", "hop", "circular"), ["conv", "wait"])
               .groupBy("conv", "call_id").agg(F.max(F.struct("at", (F.col("hop") + 1).alias("hop"))).alias("far"), F.max("circular").alias("behind")))
        new = part.join(far, ["conv", "call_id"], "left")
        up = F.coalesce(F.col("far.at") > F.col("at"), F.lit(False)) | F.coalesce(
            (F.col("far.at") == F.col("at")) & (F.col("far.hop") > F.col("hop")), F.lit(False))
        stop = F.col("circular") | F.coalesce("behind", F.lit(False)) | (F.col("hop") > F.col("total"))
        new = stage(new.select("conv", "call_id", F.when(up & ~stop, F.col("far.at")).otherwise(F.col("at")).alias("at"),
                               F.when(up & ~stop, F.col("far.hop")).otherwise(F.col("hop")).alias("hop"), "total", stop.alias("circular"),
                               ((up & ~stop) | (stop != F.col("circular"))).alias("changed")), "ranks")
        part = new.drop("changed")
        if new.where("changed").isEmpty():
            break
    still = now.join(moved, "conv", "left_anti").withColumn("circular", F.lit(False))
    return still.unionByName(part.drop("total"))


def link_calls(messages: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """conv, call_id, order_at and order_hop (order of a conversation's calls), n_results, status, faults, line."""
    ready(messages.sparkSession)
    conv = messages.schema[conv_col].dataType.simpleString()
    parts = stage(parse(messages, conv_col, turn_col, role_col, text_col), "blocks")
    lost = F.col("conv").isNull() | F.col("call_id").isNull()
    good = parts.where(~lost)
    same = ["conv", "call_id"]
    calls = good.where("kind = 'call'").groupBy(*same).agg(
        F.min(F.struct("place", "name", "payload", "after", "bad")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    calls = stage(calls.select(*same, "c.*", "n_calls"), "calls")
    results = good.where("kind = 'result'").groupBy(*same).agg(
        F.min(F.struct(F.col("place").alias("result_place"), F.col("payload").alias("content"))).alias("r"), F.count(F.lit(1)).alias("n_results"))
    linked = calls.join(results.select(*same, "r.*", "n_results"), same, "full").join(ranks(calls.select(*same, "place", "after")), same, "left")
    # further calls of an id, each as it is; equal ones are counted before they move
    shape = ["place", "name", "payload", "after", "bad"]
    many = calls.where("n_calls > 1").select(*same, *[F.col(c).alias(f"__{c}") for c in shape])
    first = F.lit(True)
    for c in shape:
        first = first & F.col(c).eqNullSafe(F.col(f"__{c}"))
    again = good.where("kind = 'call'").groupBy(*same, *shape).agg(F.count(F.lit(1)).alias("m")).join(many, same)
    again = again.withColumn("m", F.col("m") - first.cast("int")).where("m > 0").select(*same, "place", "name", "payload", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("k"))
    rows = linked.select(*same, "name", "payload", "content", F.coalesce("at", "result_place").alias("order_at"), F.coalesce("hop", F.lit(0)).alias("order_hop"),
                         F.coalesce("n_results", F.lit(0)).alias("n_results"),
                         F.when(F.col("place").isNull(), "orphan_result").when(F.col("bad"), "bad_json").when(F.col("circular"), "circular")
                         .when(F.col("n_results").isNull(), "no_result").otherwise("ok").alias("status"))
    rows = rows.unionByName(again.select(*same, "name", "payload", F.lit(None).cast("string").alias("content"), F.col("place").alias("order_at"),
                                         F.lit(0).cast("long").alias("order_hop"), F.lit(0).cast("long").alias("n_results"), F.lit("duplicate_id").alias("status")))
    rows = rows.unionByName(parts.where(lost).select(*same, "name", "payload", F.lit(None).cast("string").alias("content"), F.col("place").alias("order_at"),
                                                     F.lit(0).cast("long").alias("order_hop"), F.lit(0).cast("long").alias("n_results"), F.lit("no_id").alias("status")))

    def write(batches):
        for b in batches:
            status, wrong, lines = [], [], []
            for c, i, name, raw, content, s in zip(*(b.column(k).to_pylist() for k in ("conv", "call_id", "name", "payload", "content", "status"))):
                found, line = [], None
                if s == "duplicate_id" and name in schemas:
                    arguments, bad = decode('{"arguments":%s}' % raw, "call")
                    found = ["$: not json"] if bad else faults(arguments["arguments"], schemas[name])
                if s in ("ok", "no_result", "circular"):
                    arguments = json.loads(raw)
                    if name not in schemas:
                        s = "unknown_tool"
                    else:
                        found = faults(arguments, schemas[name])
                        s = "bad_arguments" if found else s
                    if s in ("ok", "no_result"):
                        line = canonical({"conversation": c, "id": i, "name": name, "arguments": arguments, "result": content})
                status.append(s)
                wrong.append(found)
                lines.append(line)
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in ("conv", "call_id", "order_at", "order_hop", "n_results")] + [
                    pa.array(status, pa.string()), pa.array(wrong, pa.list_(pa.string())), pa.array(lines, pa.string())],
                [conv_col, "call_id", "order_at", "order_hop", "n_results", "status", "faults", "line"])

    return rows.select("conv", "call_id", "name", "payload", "content", "status", "order_at", "order_hop", "n_results").mapInArrow(
        write, f"`{conv_col}` {conv}, call_id string, order_at long, order_hop long, n_results long, status string, faults array<string>, line string")


#: Tools that the query's derived calls name, and their argument schemas.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 400}}},
    "summarise": {"type": "object", "required": ["text", "words"], "properties": {
        "text": {"type": "string", "maxLength": 2000}, "words": {"type": "integer", "minimum": 0}}},
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations told as tool use: an assistant's turn is a call of a tool that the text's checksum chooses, the turn after it
    that call's result. A call waits for the conversation's call before; where the checksum says so, for the next one."""
    c = conversations.select("conv_id", "turn", "role", "text")
    sum_ = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    name = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    late = c.where("role = 'assistant'").groupBy("conv_id", "turn").agg(F.max((sum_ % 17 == 0).cast("int")).alias("late"))
    before = late.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("late").alias("late_before"))
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    call = F.to_json(F.struct(
        name(F.col("turn")).alias("id"), F.when(sum_ % 3 == 0, "search").when(sum_ % 3 == 1, "summarise").otherwise("translate").alias("name"),
        F.when(sum_ % 3 == 0, F.struct(F.col("text").alias("query"), words.alias("limit"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("words")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("limit"), F.col("text").alias("text"), words.alias("words"))).alias("arguments"),
        F.array(F.when(sum_ % 17 == 0, name(F.col("turn") + 2)).when(F.coalesce("late_before", F.lit(0)) == 0, name(F.col("turn") - 2)).otherwise(F.lit("none"))).alias("after")))
    told = F.when(F.col("role") == "assistant", F.concat(F.lit("<tool_call>"), call, F.lit("</tool_call>"))).when(
        (F.col("role") == "user") & (F.col("turn") > 0), F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))))
    return c.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.when((F.col("role") == "user") & (F.col("turn") > 0), "tool").otherwise(F.col("role")).alias("role"),
        F.coalesce(told, F.col("text")).alias("text"))
