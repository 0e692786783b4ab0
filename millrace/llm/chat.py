"""Chat formatting: tool calls linked to their results.

Calls and results meet in a hash join on (conversation, identifier), so one
conversation of any length spreads over tasks. Calls are put in topological
order over their stated dependencies by joins: chains of single dependencies
are contracted by doubling pointers, then each round gives a level to the calls
whose dependencies all have one, and a cycle is what is left. Arguments are read and validated against each
tool's schema by SQL expressions, and each linked call becomes one line of
canonical JSON: keys in code-point order, no blanks, no null members.

All of it is DataFrame work; no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import removed, written

ONE = ["conv_id", "call_id"]


@dataclass(frozen=True)
class Argument:
    """A member of a tool's arguments: its JSON kind (string, integer, number, boolean) and limits."""

    kind: str
    required: bool = True
    least: float | None = None
    longest: int | None = None


Schemas = dict[str, dict[str, Argument]]

#: JSON text of each kind, as the type that schema_of_variant gives.
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}


def _faults(schemas: Schemas) -> Column:
    """An array of what is wrong with ``parsed`` for the tool ``name``."""
    by_tool = []
    for tool, arguments in sorted(schemas.items()):
        tests = []
        for key, a in sorted(arguments.items()):
            value = F.try_variant_get("parsed", f"$.{key}", "variant")
            kind = F.regexp_replace(F.schema_of_variant(value), r"\(.*", "")
            missing = F.coalesce(F.is_variant_null(value), F.lit(True)) | value.isNull()
            if a.required:
                tests.append(F.when(missing, F.lit(f"{key}: missing")))
            tests.append(F.when(~missing & ~kind.isin(_KINDS[a.kind]), F.lit(f"{key}: not {a.kind}")))
            if a.least is not None:
                tests.append(F.when(F.try_variant_get("parsed", f"$.{key}", "double") < a.least, F.lit(f"{key}: below {a.least:g}")))
            if a.longest is not None:
                tests.append(F.when(F.char_length(F.try_variant_get("parsed", f"$.{key}", "string")) > a.longest, F.lit(f"{key}: over {a.longest}")))
        keys = F.json_object_keys("arguments")
        extra = F.array_except(keys, F.array(*map(F.lit, arguments)).cast("array<string>"))
        tests.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), "+"))))
        by_tool.append((tool, F.filter(F.array(*tests), lambda t: t.isNotNull())))
    out = F.array(F.lit("unknown tool"))
    for tool, faults in by_tool:
        out = F.when(F.col("name") == tool, faults).otherwise(out)
    return F.when(F.col("parsed").isNull() | (F.schema_of_variant("parsed").startswith("OBJECT") == F.lit(False)), F.array(F.lit("arguments: not an object"))).otherwise(out)


def _chains(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, top, steps) for calls that need exactly one other: where their chain leads, and how far.

    Pointers double: a round joins each pointer to that of its target, so rounds number the logarithm
    of the longest chain. Chains that run into a cycle have no end and are missing from the result.
    """
    pointers = written(single.select(*ONE, F.col("needs").alias("top"), F.lit(1).cast("long").alias("steps")), "chains")
    rounds = pointers.count().bit_length() + 1
    for _ in range(rounds):
        onward = pointers.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"))
        joined = pointers.join(onward, ["conv_id", "top"], "left")
        moved = joined.select(*ONE, F.coalesce("_top", "top").alias("top"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_top").isNotNull().alias("moved"))
        before, pointers = pointers, written(moved, "chains")
        removed(before)
        if pointers.filter("moved").isEmpty():
            break
    return pointers.filter("not moved").drop("moved")


def levels(calls: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that have one: 0 without dependencies, else one above the deepest.

    ``dependencies`` has conv_id, call_id, needs; those on calls that do not exist are met. Calls on a
    cycle or behind one are missing from the result. Chains of calls that need one other each are
    contracted first; the rounds after that number the longest chain of calls that need several.
    """
    calls = written(calls.select(*ONE).distinct(), "calls")
    known = calls.withColumnRenamed("call_id", "needs")
    edges = written(dependencies.select(*ONE, "needs").distinct().join(calls, ONE, "left_semi").join(known, ["conv_id", "needs"], "left_semi"), "needs")
    counts = edges.groupBy(*ONE).agg(F.count("*").alias("n"))
    single = edges.join(counts.filter("n = 1"), ONE, "left_semi")
    chained = written(single.select(*ONE), "chained")
    ends = _chains(single) if not single.isEmpty() else chained.select(*ONE, F.col("call_id").alias("top"), F.lit(0).cast("long").alias("steps"))
    ends = written(ends, "ends")

    # What is left: calls that need several, over edges of the length of the chain between.
    several = edges.join(chained, ONE, "left_anti")
    far = ends.select("conv_id", F.col("call_id").alias("needs"), "top", "steps")
    inside = chained.withColumnRenamed("call_id", "needs").withColumn("inside", F.lit(True))
    long = several.join(far, ["conv_id", "needs"], "left").join(inside, ["conv_id", "needs"], "left")
    # A need inside a chain without an end waits for ever: it points at itself.
    waiting = written(
        long.select(*ONE, F.when(F.col("inside").isNull(), F.col("needs")).otherwise(F.coalesce("top", "call_id")).alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "waiting"
    )
    done = written(calls.join(chained, ONE, "left_anti").join(waiting, ONE, "left_anti").withColumn("level", F.lit(0).cast("long")), "level")
    while not waiting.isEmpty():
        told = done.select("conv_id", F.col("call_id").alias("top"), "level")
        joined = waiting.join(told, ["conv_id", "top"], "left")
        ready = joined.groupBy(*ONE).agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0").drop("open")
        ready = written(ready, "level")
        if ready.isEmpty():
            break
        waiting = written(waiting.join(ready, ONE, "left_anti"), "waiting")
        done = written(done.unionByName(ready), "level")
    tops = done.select("conv_id", F.col("call_id").alias("top"), F.col("level").alias("_level"))
    below = ends.join(tops, ["conv_id", "top"]).select(*ONE, (F.col("_level") + F.col("steps")).alias("level"))
    return done.unionByName(below).select(*ONE, F.col("level").cast("int").alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, dependencies: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and result of it: conv_id, call_id, name, level, status, faults, message.

    ``calls`` has conv_id, call_id, name, arguments (JSON text); ``results`` has conv_id, call_id,
    content; ``dependencies`` has conv_id, call_id, needs.

    ``status`` is the first that holds: cycle (no level), invalid (``faults`` says why), unanswered,
    linked. A result without a call is a row of status orphan with null name and level. Of results that
    share an identifier each gets a row; calls that do, too. Where both do, which result answers which
    call is not known: the calls are invalid (identifier: repeated) and the results orphans. Rows whose conv_id or call_id is null are
    linked with nothing. ``level`` orders a conversation's calls so that each stands after all it needs.
    ``message`` is canonical JSON with the keys arguments, content, id, level, name; null values are
    left out, and arguments that are no object stay text. Null texts are null; empty tables give an
    empty result; other columns are ignored.
    """
    own = calls.select("conv_id", "call_id", "name", "arguments")
    answers = results.select("conv_id", "call_id", "content", F.lit(True).alias("answered"))
    order = levels(calls.filter("conv_id is not null and call_id is not null"), dependencies)
    # Several calls and several results of one identifier: which answers which is not known, and their pairs would be many.
    several = lambda rows: rows.groupBy(*ONE).agg(F.count("*").alias("rows")).filter("rows > 1").select(*ONE)
    unclear = written(several(own).join(several(answers), ONE), "unclear").withColumn("unclear", F.lit(True))
    side = lambda rows, n: rows.join(unclear, ONE, "left").withColumn("side", F.when(F.col("unclear"), n).otherwise(0)).drop("unclear")
    linked = side(own, 1).withColumn("called", F.lit(True)).join(side(answers, 2), [*ONE, "side"], "full").join(order, ONE, "left")
    repeated = F.when(F.col("side") == 1, F.array(F.lit("identifier: repeated"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    checked = linked.withColumn("parsed", F.try_parse_json("arguments")).withColumn("faults", F.when(F.col("called"), F.concat(_faults(schemas), repeated)).otherwise(none))
    alone = F.col("conv_id").isNull() | F.col("call_id").isNull()
    status = (
        F.when(F.col("called").isNull(), "orphan")
        .when(F.col("level").isNull() & ~alone, "cycle")
        .when(F.size("faults") > 0, "invalid")
        .when(F.col("answered").isNull(), "unanswered")
        .otherwise("linked")
    )
    return checked.select(*ONE, "name", "level", status.alias("status"), F.array_join("faults", "; ").alias("faults"), _message().alias("message"))


def _member(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))


def _text(c: str) -> Column:
    """A JSON string: to_json of a one-element array without its brackets."""
    whole = F.to_json(F.array(c))
    return F.when(F.col(c).isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def _message() -> Column:
    """Members in the order of their keys; a variant prints its object with keys in order and without blanks."""
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    arguments = F.when(is_object, F.to_json("parsed")).otherwise(_text("arguments"))
    members = [("arguments", arguments), ("content", _text("content")), ("id", _text("call_id")), ("level", F.col("level").cast("string")), ("name", _text("name"))]
    return F.concat(F.lit("{"), F.concat_ws(",", *[_member(k, v) for k, v in members]), F.lit("}"))


#: What the conversations' turns are checked against.
REPLY: Schemas = {"reply": {"prompt": Argument("string", longest=400), "turn": Argument("integer", least=0)}}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies of plain conversations (conv_id, turn, role, text).

    Each user turn calls ``reply`` under the identifier c<turn>, and needs the call two turns before; an
    assistant turn answers the call of the turn before it.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    asked = own.filter("role = 'user'")
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")))
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = own.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    needs = asked.select("conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("needs"))
    return calls, results, needs


def other_turns(turns: DataFrame) -> DataFrame:
    """A row like those of ``link_calls`` for every turn whose role is neither user nor assistant, null roles included.

    Its identifier is m<turn>, its status message, and its ``message`` is canonical JSON with the keys
    content, id, role; null values are left out. A system turn that shares its number with a user turn
    has a row of its own.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("content"))
    rest = own.filter(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).withColumn("call_id", F.concat(F.lit("m"), F.col("turn").cast("string")))
    members = [_member("content", _text("content")), _member("id", _text("call_id")), _member("role", _text("role"))]
    message = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    return rest.select(
        *ONE, F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.lit("message").alias("status"), F.lit("").alias("faults"), message.alias("message")
    )


def every_turn(turns: DataFrame, schemas: Schemas) -> DataFrame:
    """Every turn of ``turns`` in a row: calls and results linked, all others as messages."""
    return link_calls(*from_turns(turns), schemas).unionByName(other_turns(turns))


ORACLE_SQL = """
    WITH RECURSIVE asked AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
    chained AS (
      SELECT conv_id, turn, 0 AS level FROM asked a WHERE NOT EXISTS (SELECT 1 FROM asked b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
      UNION ALL
      SELECT a.conv_id, a.turn, c.level + 1 FROM asked a JOIN chained c ON a.conv_id = c.conv_id AND a.turn = c.turn + 2),
    calls AS (SELECT a.conv_id, 'c' || a.turn AS call_id, a.text, a.turn, c.level FROM asked a JOIN chained c USING (conv_id, turn)),
    results AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
    linked AS (
      SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.text, c.turn, c.level, r.content
      FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
    SELECT conv_id, call_id, CASE WHEN turn IS NOT NULL THEN 'reply' END AS name, level::INTEGER AS level,
      CASE WHEN turn IS NULL THEN 'orphan' WHEN length(text) > 400 THEN 'invalid' WHEN content IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
      CASE WHEN length(text) > 400 THEN 'prompt: over 400' ELSE '' END AS faults,
      '{' || concat_ws(',', CASE WHEN turn IS NOT NULL THEN '"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '}' END,
        '"content":' || to_json(content), '"id":' || to_json(call_id), '"level":' || level, CASE WHEN turn IS NOT NULL THEN '"name":"reply"' END) || '}' AS message
    FROM linked"""


EVERY_TURN_SQL = f"""
    SELECT * FROM ({ORACLE_SQL}) UNION ALL
    SELECT conv_id, 'm' || turn, NULL, NULL::INTEGER, 'message', '',
      '{{' || concat_ws(',', '"content":' || to_json(text), '"id":' || to_json('m' || turn), '"role":' || to_json(role)) || '}}'
    FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""
