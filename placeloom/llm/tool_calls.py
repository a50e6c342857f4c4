"""Chat formatting: tool calls linked to their results, in dependency order, as canonical JSON. DataFrame functions only.

Calls and results are joined by call id. A call may name one earlier call (``after``) that must come first; its level
in the order is its distance from the first call of its chain, found by pointer doubling (each round doubles the
distance looked at, so long chains take few rounds). Arguments are parsed and checked against the schema of the
tool, and each call becomes one line of JSON with sorted keys and no blanks. Lines are ordered by
(conversation, level, turn); a conversation is never gathered into one row.

Rows: a null call id is invalid (``no_id``) and linked with nothing. Of calls with one id the first (turn, arguments)
stands, others are ``duplicate``, as often as they occur; of results with one id the first (turn, content) counts.
Null or broken arguments are ``not_json``. Calls on a cycle or behind one have no level (``cycle``), calls behind a
call that does not exist ``no_parent``. Results without a call are returned as ``orphan``. Null content is JSON null.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import write_once

# tool -> field -> (kind, required); kinds as in KINDS
Schemas = dict[str, dict[str, tuple[str, bool]]]
KINDS = {"integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "string": ["STRING"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted list of what is wrong with the arguments of a call; empty if they fit the schema."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    fields = F.map_keys(F.from_json(arguments, "map<string,string>"))

    def of_tool(schema: dict[str, tuple[str, bool]]) -> Column:
        checks = []
        for field, (kind, required) in schema.items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            found = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
            absent = value.isNull() | (found == "VOID")
            wrong = F.when(~found.isin(KINDS[kind]), F.lit(f"{field}: not {kind}"))
            checks.append(F.when(absent, F.lit(f"{field}: missing") if required else F.lit(None)).otherwise(wrong))
        more = F.transform(F.array_except(fields, F.array(*map(F.lit, schema))), lambda f: F.concat(f, F.lit(": unknown")))
        return F.array_sort(F.array_compact(F.concat(F.array(*checks), more)))

    errors = F.array(F.lit("tool: unknown"))
    for tool, schema in schemas.items():
        errors = F.when(name == tool, of_tool(schema)).otherwise(errors)
    return F.when(parsed.isNull(), F.array(F.lit("arguments: not json"))).when(~is_object, F.array(F.lit("arguments: not an object"))).otherwise(errors)


def levels(calls: DataFrame) -> DataFrame:
    """``_id``, ``_level`` (null on or behind a cycle or a missing call) and ``_why`` for unique ``_id`` with ``_after``."""
    ids = calls.select(F.col("_id").alias("_up"), F.lit(True).alias("_there"))
    # (call, the call it points at, steps to it); a pointer of null has reached the first call
    state = calls.join(ids, F.col("_after") == F.col("_up"), "left").select(
        "_id", F.when(F.col("_there"), F.col("_after")).alias("_to"), F.when(F.col("_after").isNull(), 0).otherwise(1).cast("long").alias("_steps"),
        (F.col("_after").isNotNull() & F.col("_there").isNull()).alias("_lost"))
    state = write_once(state, "levels")
    total, reach = state.count(), 1
    while reach <= total and not state.filter("_to is not null").isEmpty():
        far = state.select(F.col("_id").alias("_mid"), F.col("_to").alias("_next"), F.col("_steps").alias("_more"), F.col("_lost").alias("_also"))
        state = write_once(state.join(far, F.col("_to") == F.col("_mid"), "left").select(
            "_id", F.col("_next").alias("_to"), (F.col("_steps") + F.coalesce("_more", F.lit(0))).alias("_steps"),
            (F.col("_lost") | F.coalesce("_also", F.lit(False))).alias("_lost")), "levels")
        reach *= 2
    why = F.when(F.col("_to").isNotNull(), "cycle").when(F.col("_lost"), "no_parent")
    return state.select("_id", F.when(why.isNull(), F.col("_steps")).alias("_level"), why.alias("_why"))


def linked(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """``conv_id``, ``turn``, ``call_id``, ``level``, ``status``, ``errors`` and ``line`` (canonical JSON) per call and orphan.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after; ``results``: conv_id, turn, call_id, content.
    """
    given = calls.select("conv_id", "turn", F.col("call_id").alias("_id"), "name", "arguments", F.col("after").alias("_after"))
    order = F.struct("turn", "arguments", "name", "conv_id", "_after")
    once = write_once(given.filter("_id is not null").groupBy("_id").agg(F.min(order).alias("_first")), "calls")
    placed = levels(once.select("_id", F.col("_first._after").alias("_after")))
    answers = results.filter("call_id is not null").groupBy(F.col("call_id").alias("_id")).agg(
        F.min(F.struct("turn", "content", "conv_id")).alias("_answer"))
    heads = once.join(placed, "_id").join(answers, "_id", "full").select(
        "_id", F.coalesce(F.col("_first.conv_id"), F.col("_answer.conv_id")).alias("conv_id"),
        F.coalesce(F.col("_first.turn"), F.col("_answer.turn")).alias("turn"), F.col("_first.name").alias("name"),
        F.col("_first.arguments").alias("arguments"), "_level", "_why", F.col("_answer.content").alias("content"),
        F.col("_first").isNull().alias("_orphan"), F.col("_answer").isNotNull().alias("_has"))
    # the calls that are no head: further copies of an id, counted by their own content, and calls without id
    counted = given.groupBy(*given.columns).agg(F.count("*").alias("_n"))
    firsts = once.select(F.col("_id").alias("_fid"), "_first")
    copies = counted.join(firsts, F.col("_id") == F.col("_fid"), "left").withColumn(
        "_n", F.col("_n") - F.coalesce(F.col("_first") == order, F.lit(False)).cast("int")).filter("_n > 0")
    copies = copies.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(
        "_id", "conv_id", "turn", "name", "arguments", F.lit(None).cast("long").alias("_level"),
        F.when(F.col("_id").isNull(), "no_id").otherwise("duplicate").alias("_why"), F.lit(None).cast("string").alias("content"),
        F.lit(False).alias("_orphan"), F.lit(False).alias("_has"))
    rows = heads.unionByName(copies).withColumn("errors", F.when(
        F.col("_orphan"), F.array().cast("array<string>")).otherwise(argument_errors(F.col("name"), F.col("arguments"), schemas)))
    status = (
        F.when(F.col("_orphan"), "orphan").when(F.col("_why").isNotNull(), F.col("_why"))
        .when(F.array_contains("errors", "arguments: not json"), "not_json").when(F.size("errors") > 0, "invalid")
        .when(~F.col("_has"), "no_result").otherwise("linked"))
    # a variant prints its keys sorted and without blanks; text is escaped by the JSON writer
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    text = lambda c: F.expr(f"coalesce(substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2), 'null')")
    line = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"call_id":'), text("_id"), F.lit(',"name":'), text("name"), F.lit(',"result":'), text("content"), F.lit("}"))
    return rows.select("conv_id", "turn", F.col("_id").alias("call_id"), F.col("_level").alias("level"), status.alias("status"), "errors", line.alias("line"))
