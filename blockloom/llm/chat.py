"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Everything here is DataFrame or SQL functions.

Calls and results meet in a hash join on the call's identifier, built on what
is kept of each identifier: one row with its level and its result.  A call may
depend on one earlier call, the one whose result it builds on; levels in that
order come from pointer doubling, so rounds grow with the logarithm of the
longest chain, and no conversation is gathered anywhere.  Arguments are parsed
as variants and held against the tool's schema: arguments that are missing, of
another type, too long or unknown.  Canonical JSON has its keys sorted, no white
space and null members dropped.

Defined cases: a row whose conversation or turn is null has no identifier, is
linked to nothing and is serialised as a message; a null text is an absent
member; calls that repeat an identifier keep their own arguments, errors and
JSON, and share their level (by the least parent) and their result; of results
that repeat an identifier the least content is linked; arguments that aren't
a JSON object fail validation; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import table, written

#: Arguments of a tool by name: (type, required, and for a string the most characters, if limited).  Types are "string", "integer", "number", "boolean", "object" and "array".
Schema = dict[str, tuple[str, bool] | tuple[str, bool, int]]
#: Most characters of a request's text.
MOST_TEXT = 256
SCHEMAS: dict[str, Schema] = {"respond": {"conv_id": ("integer", True), "text": ("string", True, MOST_TEXT), "turn": ("integer", True), "style": ("string", False)}}

#: Rounds after which only a cycle can be left: 2 to this power calls in a chain.
MOST_ROUNDS = 40

#: What variants call the JSON types.
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def violations(tool: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """What is wrong with a call, in order, as an array of strings; null members count as missing."""
    parsed = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.array(F.concat(F.lit("unknown tool "), tool))
    for name, schema in schemas.items():
        checks = []
        for arg, (kind, required, *most) in sorted(schema.items()):
            long = F.lit(False)
            if most:
                long = F.char_length(F.try_variant_get(parsed, f"$.{arg}", "string")) > most[0]
            got = F.schema_of_variant(F.try_variant_get(parsed, f"$.{arg}", "variant"))
            missing = got.isNull() | (got == "VOID")
            fits = F.lit(False)
            for prefix in _TYPES[kind]:
                fits = fits | got.startswith(prefix)
            checks.append(F.when(missing, F.lit(f"missing {arg}") if required else F.lit(None)).when(~fits, F.lit(f"{arg} is not {kind}")).when(long, F.lit(f"{arg} is too long")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, schema)))), lambda k: F.concat(F.lit("unknown "), k))
        own = F.when(F.json_object_keys(arguments).isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(F.array_compact(F.array(*checks)), extra))
        out = F.when(tool == name, own).otherwise(out)
    return F.when(tool.isNull(), F.array(F.lit("no tool"))).otherwise(out)


def levels(calls: DataFrame) -> DataFrame:
    """``call_id, level``: 1 for a call without a parent among ``calls`` (call_id, parent_id), else one more than its parent's.

    ``call_id`` is distinct.  Each round doubles how far a call sees; calls on a
    cycle, which no order allows, get level 0.
    """
    known = calls.select(F.col("call_id").alias("known"))
    now = written(calls.join(known, F.col("parent_id") == F.col("known"), "left").select("call_id", F.col("known").alias("far"), F.lit(1).cast("long").alias("level")), "levels")
    for _ in range(MOST_ROUNDS):
        if now.where("far is not null").isEmpty():
            break
        step = now.select(F.col("call_id").alias("at"), F.col("far").alias("next"), F.col("level").alias("more"))
        now = written(now.join(step, F.col("far") == F.col("at"), "left").select("call_id", F.col("next").alias("far"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
    return now.select("call_id", F.when(F.col("far").isNull(), F.col("level")).otherwise(F.lit(0)).alias("level"))


def canonical(arguments: Column) -> Column:
    """A JSON object with sorted keys and no white space, as a variant; null if it isn't JSON."""
    return F.try_parse_json(arguments)


def identified(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each identifier of a call: ``call_id, level, answered, content`` (of its result)."""
    one = calls.where("call_id is not null").groupBy("call_id").agg(F.min("parent_id").alias("parent_id"))
    answer = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    out = levels(one).join(answer.hint("shuffle_hash"), "call_id", "left")
    return out.select("call_id", "level", F.coalesce("answered", F.lit(False)).alias("answered"), "content")


def described(calls: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """``calls`` (call_id, tool, arguments, level, content and others) with ``errors`` and canonical ``json``."""
    body = F.struct(canonical(F.col("arguments")).alias("arguments"), F.col("call_id").alias("id"), "level", F.col("tool").alias("name"), F.col("content").alias("result"))
    return calls.withColumn("errors", F.array_join(violations(F.col("tool"), F.col("arguments"), schemas), "; ")).withColumn("json", F.to_json(body))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """``calls`` (call_id, parent_id, tool, arguments), those with an identifier, with level, answered, their result's content (results: call_id, content), errors and canonical json."""
    own = calls.where("call_id is not null")
    return described(own.join(identified(own, results).hint("shuffle_hash"), "call_id"), schemas)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` with its call, level, errors and canonical JSON.

    A user turn calls ``respond``; its identifier is made of conversation and
    turn.  An assistant turn is the result of the call one turn before it.  A
    call builds on the exchange two turns before it.
    """
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")

    def identifier(turn: Column) -> Column:
        return F.concat(F.lit("call_"), F.md5(F.concat_ws(":", F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), F.col("conv_id")), turn).cast("binary")))

    present = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    call = F.when(present & (F.col("role") == "user"), identifier(F.col("turn"))).when(present & (F.col("role") == "assistant"), identifier(F.col("turn") - 1))
    arguments = F.when(F.col("role") == "user", F.to_json(F.struct("turn", "text", "conv_id")))  # as a model might write them; made canonical later
    rows = turns.select("conv_id", "turn", "role", "text", call.alias("call_id"), F.lit("respond").alias("tool"), arguments.alias("arguments"))
    calls = rows.where("role = 'user'").select("call_id", identifier(F.col("turn") - 2).alias("parent_id"))
    results = rows.where("role = 'assistant'").select("call_id", F.col("text").alias("content"))
    known = identified(calls, results).withColumn("linked", F.lit(True))
    # Rows without an identifier have nothing to meet and stay out of the join, where they would be one group.
    alone = rows.where("call_id is null").select("*", *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns if c != "call_id"))
    met = rows.where("call_id is not null").join(known.hint("shuffle_hash"), "call_id", "left").select(*alone.columns)
    out = described(met.unionByName(alone), SCHEMAS)
    kind = F.when(F.col("linked").isNull(), F.when(F.col("role") == "assistant", "orphan").otherwise("message")).when(F.col("role") == "user", "call").otherwise("result")
    json = F.when(kind == "call", F.col("json")).when(kind == "result", F.to_json(F.struct("call_id", "role", "text"))).otherwise(F.to_json(F.struct("role", "text")))
    return out.select("conv_id", "turn", "role", kind.alias("kind"), F.when(F.col("linked"), F.col("call_id")).alias("call_id"), F.coalesce("answered", F.lit(False)).alias("answered"), F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.when(kind == "call", F.col("errors")).otherwise(F.lit("")).alias("errors"), json.alias("json"))


#: The same rows in DuckDB: levels by recursion over exchanges, JSON by its own functions.
ORACLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN role = 'user' THEN 'call_' || md5(conv_id || ':' || turn)
         WHEN role = 'assistant' THEN 'call_' || md5(conv_id || ':' || (turn - 1)) END AS call_id
  FROM conversations),
calls AS (SELECT conv_id, turn, text, call_id FROM t WHERE role = 'user'),
depth AS (
  SELECT conv_id, turn, 1 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, d.level + 1 FROM calls c JOIN depth d ON c.conv_id = d.conv_id AND c.turn = d.turn + 2),
found AS (
  SELECT c.call_id, c.conv_id, c.turn, c.text, d.level, a.text AS result, a.call_id IS NOT NULL AS answered
  FROM calls c JOIN depth d USING (conv_id, turn)
  LEFT JOIN (SELECT call_id, text FROM t WHERE role = 'assistant') a USING (call_id))
SELECT t.conv_id, t.turn, t.role,
  CASE WHEN f.call_id IS NULL THEN CASE WHEN t.role = 'assistant' THEN 'orphan' ELSE 'message' END
       WHEN t.role = 'user' THEN 'call' ELSE 'result' END AS kind,
  f.call_id, coalesce(f.answered, false) AS answered, CAST(coalesce(f.level, 0) AS BIGINT) AS level,
  CASE WHEN f.call_id IS NULL OR t.role <> 'user' THEN '' WHEN t.text IS NULL THEN 'missing text' WHEN length(t.text) > {MOST_TEXT} THEN 'text is too long' ELSE '' END AS errors,
  CAST(CASE WHEN f.call_id IS NULL THEN json_object('role', t.role, 'text', t.text)
       WHEN t.role <> 'user' THEN json_object('call_id', t.call_id, 'role', t.role, 'text', t.text)
       WHEN f.answered THEN json_object('arguments', json_object('conv_id', t.conv_id, 'text', t.text, 'turn', t.turn),
         'id', f.call_id, 'level', f.level, 'name', 'respond', 'result', f.result)
       ELSE json_object('arguments', json_object('conv_id', t.conv_id, 'text', t.text, 'turn', t.turn),
         'id', f.call_id, 'level', f.level, 'name', 'respond') END AS VARCHAR) AS json
FROM t LEFT JOIN found f USING (call_id)
"""
