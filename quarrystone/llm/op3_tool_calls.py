"""Tool-call linking for chat formatting.

Calls and results of a conversation are joined by identifier, ordered topologically
(a call after all calls it depends on, a result after its call), their arguments are
validated against schemas, and each message is serialised as canonical JSON: keys
sorted, no blanks. Identifiers count within their conversation only.

A level is the length of the longest chain of calls before a call. Each call points to
one of those it depends on, the latest to begin with; pointer jumping gives all lengths
along these pointers, since each round doubles the distance that a call knows, so a
chain of n calls takes log2(n) joins. Then each call that depends on one of a higher
level points there instead, and lengths are taken anew, until no call finds a higher
one. Each step holds one row per call, however many ways lead to it, and no
conversation meets in one task. Each message is a row; a conversation is read in the
order of (level, turn).

Defined results: a result whose call is missing and a call without a result are
unlinked; parents that are no call of the conversation count as none; calls on a cycle
or under one have a null level; of calls with one identifier the first by turn, name
and arguments is linked and the others are duplicates, but repeated rows are linked
alike; arguments that are no JSON object, lack a required field, have one of another
type or outside its values, or one that a closed schema does not name are invalid;
unknown tools are invalid; calls and results without an identifier are unlinked; rows
without a conversation are one conversation; null texts and arguments that are no JSON
are null in the JSON; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import discard, materialize, read_table

#: field: (what it holds, required). What it holds is a type of JSON, or a dict of ``type``,
#: ``enum`` (allowed values), ``fields`` (a Schema, of objects), ``items`` (what an array's
#: elements hold) and ``closed`` (whether objects may hold named fields only).
Schema = dict[str, tuple[str | dict, bool]]
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*"}


#: Stands for the level of calls on a cycle or under one, above all others.
_ENDLESS = 1 << 60


def _lengths(ids: DataFrame, pointers: DataFrame, total: int) -> DataFrame:
    """``(id, level)``: how many pointers (id, anc) lead on from each id, ``_ENDLESS`` where they run in circles."""
    state = ids.join(pointers, "id", "left").select("id", "anc", F.when(F.col("anc").isNull(), 0).otherwise(1).cast("bigint").alias("level"))
    state, reach = materialize(state, "lengths"), 1
    while reach <= 2 * total and state.where("anc is not null").limit(1).count():
        up = state.select(F.col("id").alias("i"), F.col("anc").alias("a2"), F.col("level").alias("l2"))
        # an id without a pointer needs no join, so the first calls do not pile up under one key
        moving = state.where("anc is not null").join(up, F.col("anc") == F.col("i")).select("id", F.col("a2").alias("anc"), (F.col("level") + F.col("l2")).alias("level"))
        before, state = state, materialize(state.where("anc is null").union(moving), "lengths")
        discard(before)
        reach *= 2
    return state.select("id", F.when(F.col("anc").isNull(), F.col("level")).otherwise(_ENDLESS).alias("level"))


def levels(calls: DataFrame) -> DataFrame:
    """``(id, level)`` of ``calls(id, parent)``, a row for each parent: the longest chain before it; null on and under cycles.

    A column ``hint`` tells which parents to try first, those of the greatest value.
    """
    ids = materialize(calls.select("id").distinct(), "ids")
    hint = F.col("hint") if "hint" in calls.columns else F.lit(0)
    steps = calls.where("parent is not null").select("id", F.col("parent").alias("anc"), hint.alias("hint"))
    steps = materialize(steps.join(ids.withColumnRenamed("id", "anc"), "anc", "left_semi").groupBy("id", "anc").agg(F.max("hint").alias("hint")), "steps")
    total = ids.count()
    pointers = steps.groupBy("id").agg(F.max(F.struct("hint", "anc"))["anc"].alias("anc"))
    while True:
        pointers = materialize(pointers, "pointers")
        now = _lengths(ids, pointers, total)
        above = steps.join(now.select(F.col("id").alias("anc"), F.col("level").alias("l")), "anc").groupBy("id").agg(F.max(F.struct("l", "anc")).alias("best"))
        # a higher parent than the one pointed to; on a cycle there is none higher
        better = materialize(above.join(now, "id").where(F.col("best.l") + 1 > F.col("level")).where(F.col("level") < _ENDLESS).select("id", F.col("best.anc").alias("anc")), "better")
        if not better.limit(1).count():
            return now.select("id", F.when(F.col("level") < _ENDLESS, F.col("level")).alias("level"))
        pointers = pointers.join(better.select("id"), "id", "left_anti").union(better)


def _field_problems(root: Column, text: Column, path: str, name: str, spec: str | dict, required: bool) -> list[Column]:
    """What is wrong with one field and the fields below it, each null if nothing is."""
    spec = {"type": spec} if isinstance(spec, str) else spec
    got = F.try_variant_get(root, path, "variant")
    shape = F.schema_of_variant(got)
    missing, kind = shape.isNull() | (shape == "VOID"), spec["type"]
    fits = shape.rlike(f"^({_TYPES[kind]})")
    out = [F.when(missing, F.lit(f"missing {name}") if required else F.lit(None)).when(~fits, F.lit(f"{name} is not {kind}"))]
    if "enum" in spec:
        out.append(F.when(fits & ~F.to_json(got).isin([json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for v in spec["enum"]]), F.lit(f"{name} is none of its values")))
    if "items" in spec:
        wrong = F.exists(F.try_variant_get(root, path, "array<variant>"), lambda v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike(f"^({_TYPES[spec['items']]})"))
        out.append(F.when(fits & wrong, F.lit(f"{name} holds other than {spec['items']}")))
    if "fields" in spec:
        for field, (inner, needed) in spec["fields"].items():
            out += [F.when(fits, x) for x in _field_problems(root, text, f"{path}.{field}", f"{name}.{field}", inner, needed)]
        if spec.get("closed"):
            out.append(F.when(fits, _unnamed(F.get_json_object(text, path), list(spec["fields"]), name)))
    return out


def _unnamed(text: Column, fields: list[str], name: str) -> Column:
    """That an object holds fields beside ``fields``; null if it does not."""
    more = F.array_except(F.json_object_keys(text), F.array(*map(F.lit, fields)) if fields else F.expr("CAST(array() AS array<string>)"))
    return F.when(F.size(more) > 0, F.concat(F.lit(f"{name} holds unnamed "), F.array_join(F.array_sort(more), " ")))


def problems(name: Column, arguments: Column, schemas: dict[str, Schema], closed: bool = False) -> Column:
    """What is wrong with a call's arguments (array<string>, empty if valid); ``closed`` allows named fields only."""
    parsed = F.try_parse_json(arguments)
    shape = F.schema_of_variant(parsed)
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        checks = [x for field, (spec, required) in schema.items() for x in _field_problems(parsed, arguments, f"$.{field}", field, spec, required)]
        if closed:
            checks.append(_unnamed(arguments, list(schema), "call"))
        own = F.when(parsed.isNull() | ~shape.startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(F.array_compact(F.array(*checks)) if checks else F.expr("CAST(array() AS array<string>)"))
        out = F.when(name == tool, own).otherwise(out)
    return out


def link_tool_calls(messages: DataFrame, schemas: dict[str, Schema], closed: bool = False) -> DataFrame:
    """Messages in, with link, level, validity and canonical JSON out.

    ``messages``: conv_id, turn, kind (``call``, ``result`` or ``text``), role, call_id,
    parents (array, of calls; or ``parent``, a single one), name, arguments (JSON text),
    content.
    """
    parents = F.col("parents") if "parents" in messages.columns else F.array("parent")
    # a conversation's own names; rows without an identifier are spread and meet nothing
    within = lambda x: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("\x01")), F.lit("\x00"), x)
    spread = F.concat(F.lit("\x02"), F.monotonically_increasing_id().cast("string"))
    m = messages.select("conv_id", "turn", "kind", "role", "call_id", parents.alias("parents"), "name", "arguments", "content", F.coalesce(within(F.col("call_id")), spread).alias("key"))
    m = materialize(m, "messages")
    calls = m.where("kind = 'call' and call_id is not null")
    first = calls.groupBy("key").agg(F.min(F.struct("turn", "name", "arguments", "parents")).alias("c"), F.first("conv_id").alias("conv_id"))
    first = materialize(first.select(F.col("key").alias("id"), "conv_id", "c"), "calls")
    edges = first.select("id", F.explode_outer(F.transform("c.parents", within)).alias("parent"))
    edges = edges.join(first.select(F.col("id").alias("parent"), F.col("c.turn").alias("hint")), "parent", "left")
    answered = m.where("kind = 'result' and call_id is not null").select(F.col("key").alias("answered")).distinct()
    index = first.select("id", F.col("c").alias("first")).join(levels(edges), "id").join(answered, F.col("id") == F.col("answered"), "left")
    linked = m.join(index, m["key"] == index["id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    same = F.col("turn").eqNullSafe(F.col("first.turn")) & F.col("name").eqNullSafe(F.col("first.name")) & F.col("arguments").eqNullSafe(F.col("first.arguments"))
    wrong = F.when(is_call, problems(F.col("name"), F.col("arguments"), schemas, closed))
    level = F.when(is_call, 2 * F.col("level")).when(is_result, 2 * F.col("level") + 1)
    body = F.when(is_call, F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", "role"), {"ignoreNullFields": "false"}))
    body = body.when(is_result, F.to_json(F.struct("content", "role", F.col("call_id").alias("tool_call_id")), {"ignoreNullFields": "false"}))
    body = body.otherwise(F.to_json(F.struct("content", "role"), {"ignoreNullFields": "false"}))
    return linked.select(
        "conv_id", "turn", "kind", "call_id",
        F.when(is_call, F.col("answered").isNotNull() & same).when(is_result, F.col("id").isNotNull()).alias("linked"),
        level.cast("bigint").alias("level"), F.when(is_call, F.size(wrong) == 0).alias("valid"), F.array_join(wrong, "; ").alias("problems"), body.alias("json"),
    )


#: The tool as which a user's turn is called.
SCHEMAS: dict[str, Schema] = {"reply": {"prompt": ("string", True), "turn": ("integer", True), "context": ({"type": "object", "closed": True, "fields": {"after": ({"type": "array", "items": "integer"}, True)}}, True)}}


def as_messages(conversations: DataFrame) -> DataFrame:
    """User turns as calls of ``reply``, which depend on the user turns 2 and 4 before, the assistant's next turn as the result, other turns as text.

    Calls are named after their turn, so every conversation uses the same names.
    """
    name = lambda back: F.concat(F.lit("call_"), (F.col("turn") - back).cast("string"))
    call, result = F.col("role") == "user", F.col("role") == "assistant"
    context = F.struct(F.array(F.col("turn") - 2, F.col("turn") - 4).alias("after"))
    return conversations.select(
        "conv_id", "turn", F.when(call, "call").when(result, "result").otherwise("text").alias("kind"), "role",
        F.when(call, name(0)).when(result, name(1)).alias("call_id"), F.when(call, F.array(name(2), name(4))).alias("parents"), F.when(call, F.lit("reply")).alias("name"),
        F.when(call, F.to_json(F.struct(F.col("turn").alias("turn"), context.alias("context"), F.col("text").alias("prompt")))).alias("arguments"), F.col("text").alias("content"),
    )


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(as_messages(read_table(spark, sf_dir, "conversations")), SCHEMAS, closed=True)


ORACLE = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'text' END AS kind,
    CASE role WHEN 'user' THEN 'call_' || turn WHEN 'assistant' THEN 'call_' || (turn - 1) END AS call_id FROM conversations),
u AS (SELECT DISTINCT conv_id, turn FROM c WHERE kind = 'call'),
e AS (SELECT u.conv_id, u.turn, p.turn AS parent FROM u JOIN u p ON u.conv_id IS NOT DISTINCT FROM p.conv_id AND p.turn IN (u.turn - 2, u.turn - 4)),
lv(conv_id, turn, depth) AS (
  SELECT conv_id, turn, 0 FROM u
  UNION SELECT e.conv_id, e.turn, depth + 1 FROM e JOIN lv ON e.conv_id IS NOT DISTINCT FROM lv.conv_id AND e.parent = lv.turn),
i AS (SELECT conv_id, 'call_' || turn AS id, max(depth) AS depth FROM lv GROUP BY ALL),
a AS (SELECT DISTINCT conv_id, call_id FROM c WHERE kind = 'result')
SELECT c.conv_id, turn, kind, c.call_id,
  CASE kind WHEN 'call' THEN a.call_id IS NOT NULL WHEN 'result' THEN i.id IS NOT NULL END AS linked,
  (CASE kind WHEN 'call' THEN 2 * depth WHEN 'result' THEN 2 * depth + 1 END)::BIGINT AS level,
  CASE WHEN kind = 'call' THEN text IS NOT NULL END AS valid,
  CASE WHEN kind = 'call' THEN CASE WHEN text IS NULL THEN 'missing prompt' ELSE '' END END AS problems,
  CASE kind
    WHEN 'call' THEN '{"arguments":{"context":{"after":[' || (turn - 2) || ',' || (turn - 4) || ']}' || coalesce(',"prompt":' || to_json(text)::VARCHAR, '') || ',"turn":' || turn || '},"id":' || to_json(c.call_id)::VARCHAR || ',"name":"reply","role":"user"}'
    WHEN 'result' THEN '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":"assistant","tool_call_id":' || to_json(c.call_id)::VARCHAR || '}'
    ELSE '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' END AS json
FROM c LEFT JOIN i ON c.conv_id IS NOT DISTINCT FROM i.conv_id AND c.call_id = i.id LEFT JOIN a ON c.kind = 'call' AND c.conv_id IS NOT DISTINCT FROM a.conv_id AND c.call_id = a.call_id
"""
