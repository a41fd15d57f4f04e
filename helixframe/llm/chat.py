"""Tool-call linking: calls and results to ordered, validated, canonical JSON records.

DataFrame and SQL functions only. Calls are gathered by identifier, with partial
sums before the shuffle, and results are joined to the one call of theirs. In a conversation where each call stands after the call it answers
to, the turn is a topological order. The other conversations get each call's
depth in the forest of parents by pointer jumping, whose rounds are the
logarithm of the longest chain. A record is one call or result, never a whole
conversation, so a conversation of any length stays spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import Scratch

#: JSON types of a schema and the variant types that fulfil them; an integer is a number without a fraction, however it is written.
TYPES = {"string": ("STRING",), "integer": ("BIGINT", "DOUBLE", "DECIMAL"), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
#: What a value has to be: the name of a type, or a mapping of type, enum, minimum, maximum, items (of an array), fields (of an object: spec and whether required).
Spec = str | Mapping[str, object]
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
#: A string, a number, or what stands between them; possessive, so that a string of any length needs no stack.
_PIECE = r'"(?:[^"\\]++|\\.)*+"|' + _NUMBER + r'|[^"0-9-]++'


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), 0)


def _is_number(piece: Column) -> Column:
    return F.substring(piece, 1, 1).isin(*"-0123456789")


def number_text(piece: Column) -> Column:
    """A JSON number in its one form: whole ones under 10^21 in digits, others as the shortest double, with an exponent below 10^-6 and from 10^21 on.

    No digit of a whole number that is written as one is lost, whatever its length up to 21.
    """
    value = piece.cast("double")
    plain = lambda kind: F.regexp_replace(value.cast("string").cast(kind).cast("string"), r"\.?0+$", "")
    whole = F.when(value == 0, "0").otherwise(value.cast("decimal(38,0)").cast("string"))
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0E", "E"), "E-", "e-"), "E", "e+")
    size = F.abs(value)
    return (
        F.when(piece.rlike("^-?[1-9][0-9]{0,20}$"), piece)
        .when((size < 1e21) & (value == F.floor(value)), whole)
        .when((size >= 1e-6) & (size < 1e7), plain("decimal(38,30)"))
        .when((size >= 1e7) & (size < 1e21), plain("decimal(38,18)"))
        .otherwise(power)
    )


def canonical(value: Column) -> Column:
    """The text of a variant: keys sorted, no blanks, numbers in their one form."""
    text = F.to_json(value)
    again = F.array_join(F.transform(_pieces(text), lambda p: F.when(_is_number(p), number_text(p)).otherwise(p)), "")
    return F.when(text.rlike("[0-9][.eE]|-0"), again).otherwise(text)  # only such numbers can have another form


def _read(text: Column) -> tuple[Column, Column]:
    """(variant, what is wrong): the one JSON value that a whole text is.

    Spark's parsers stop after the first value. So a text is one value where it can
    stand as the only element of an array and as the value of an object: whatever
    follows a first value breaks one of the two.
    """
    listed, named = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"a":'), text, F.lit("}"))
    strict = {"allowSingleQuotes": "false"}
    formed = F.coalesce((F.size(F.from_json(listed, "array<string>", strict)) == 1) & F.from_json(named, "map<string, string>", strict).isNotNull(), F.lit(False))
    value = F.when(F.try_parse_json(listed).isNotNull() & F.try_parse_json(named).isNotNull(), F.try_parse_json(text))
    huge = F.exists(_pieces(text), lambda p: _is_number(p) & (F.abs(p.try_cast("double")) == float("inf")))
    wrong = F.when(text.isNull(), "missing").when(~formed, "not JSON").when(value.isNull(), "a repeated key").when(huge, "a number out of range").when(~F.schema_of_variant(value).startswith("OBJECT"), "not an object")
    return F.when(wrong.isNull() | (wrong == "not an object"), value), wrong


def _wrong(at: Column, spec: Spec, path: Column) -> Column:
    """Texts of what is wrong with a variant that is there."""
    spec = {"type": spec} if isinstance(spec, str) else spec
    kind, checks = spec.get("type"), []
    say = lambda what: F.array(F.concat(path, F.lit(f": {what}")))
    none = F.array().cast("array<string>")
    is_kind = F.lit(True)
    if kind is not None:
        is_kind = F.regexp_extract(F.schema_of_variant(at), "^[A-Z]+", 0).isin(*TYPES[kind])
        if kind == "integer":
            value = F.try_variant_get(at, "$", "double")
            is_kind = is_kind & (value == F.floor(value))
    if "enum" in spec:
        allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in spec["enum"]]
        checks.append(F.when(~canonical(at).isin(*allowed), say("none of the allowed values")).otherwise(none))
    value = F.try_variant_get(at, "$", "double")
    if "minimum" in spec:
        checks.append(F.when(value < spec["minimum"], say(f"below {spec['minimum']}")).otherwise(none))
    if "maximum" in spec:
        checks.append(F.when(value > spec["maximum"], say(f"above {spec['maximum']}")).otherwise(none))
    if "fields" in spec:
        checks.append(_of_fields(F.try_variant_get(at, "$", "map<string, variant>"), spec["fields"], F.concat(path, F.lit("."))))
    if "items" in spec:
        items = F.try_variant_get(at, "$", "array<variant>")
        each = F.transform(items, lambda x, i: _wrong(x, spec["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        checks.append(F.coalesce(F.flatten(each), none))
    inside = F.concat(none, *checks)
    return F.when(~F.coalesce(is_kind, F.lit(False)), say(f"not {kind}")).otherwise(inside)


def _of_fields(given: Column, fields: Mapping[str, tuple[Spec, bool]], prefix: Column) -> Column:
    """Texts of what is wrong with the fields of an object, given as a map; a null field counts as absent."""
    checks = [F.array().cast("array<string>")]
    for name, (spec, required) in sorted(fields.items()):
        at, path = F.element_at(given, name), F.concat(prefix, F.lit(name))
        missing = F.array(F.concat(path, F.lit(": missing"))) if required else F.array().cast("array<string>")
        checks.append(F.when(at.isNull() | F.is_variant_null(at), missing).otherwise(_wrong(at, spec, path)))
    known = F.array(*[F.lit(f) for f in sorted(fields)]).cast("array<string>")
    extra = F.transform(F.array_except(F.coalesce(F.map_keys(given), F.array().cast("array<string>")), known), lambda k: F.concat(prefix, k, F.lit(": unknown")))
    return F.concat(*checks, extra)


def _errors(parsed: Column, wrong: Column, name: Column, schemas: Mapping[str, Mapping[str, tuple[Spec, bool]]]) -> Column:
    """Sorted texts of what is wrong with arguments: schemas gives (spec, required) by field by tool."""
    found = F.array(F.lit("no such tool"))
    given = F.try_variant_get(parsed, "$", "map<string, variant>")  # names of any characters, unlike paths
    for tool, fields in sorted(schemas.items()):
        found = F.when(name == tool, _of_fields(given, fields, F.lit(""))).otherwise(found)
    return F.array_sort(F.when(wrong.isNotNull(), F.array(F.concat(F.lit("arguments: "), wrong))).otherwise(found))


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, __depth: calls above each one in its forest of parents; -1 on or below a cycle.

    calls has conv_id, call_id and parent_id, one row for each call; a parent
    that does not exist counts as none.
    """
    scratch = Scratch(calls.sparkSession)
    at = calls.select("conv_id", "call_id", F.col("parent_id").alias("__up"))
    ids = calls.select("conv_id", F.col("call_id").alias("__up"), F.lit(1).alias("__there")).distinct()
    at = at.join(ids, ["conv_id", "__up"], "left").select("conv_id", "call_id", F.when(F.col("__there") == 1, F.col("__up")).alias("__up"))
    at = scratch.save(at.withColumn("__depth", F.col("__up").isNotNull().cast("long")), "0")
    rounds, limit = 0, at.count().bit_length() + 1
    while rounds < limit and not at.filter("__up is not null").isEmpty():
        above = at.select("conv_id", F.col("call_id").alias("__up"), F.col("__up").alias("__next"), F.col("__depth").alias("__more"))
        at = at.join(above, ["conv_id", "__up"], "left").select("conv_id", "call_id", F.col("__next").alias("__up"), (F.col("__depth") + F.coalesce("__more", F.lit(0))).alias("__depth"))
        rounds += 1
        at = scratch.save(at, str(rounds))
        scratch.drop(str(rounds - 1))
    return at.select("conv_id", "call_id", F.when(F.col("__up").isNull(), F.col("__depth")).otherwise(-1).alias("__depth"))


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[Spec, bool]]]) -> DataFrame:
    """One record for each result, each call without one, and each further call of an identifier.

    calls: conv_id, call_id, turn, name, arguments (JSON text), parent_id (the
    call whose result it answers to, or null). results: conv_id, call_id, turn,
    content. Result: conv_id, call_id, turn, result_turn, status, depth (null where
    the turn is the order), valid, errors, record (canonical JSON: sorted keys, no
    blanks), range-sorted in topological order within each conversation; calls on a
    cycle come last.

    Calls that agree in all columns are one. An identifier stands for its first
    call by turn, name, arguments and parent, nulls first; every result of that
    identifier is a record with it (linked), so rows grow with calls and results,
    never with their product. A call without a result is pending, a result without
    a call orphan, a later call of the same identifier repeated. Null identifiers
    never link. Arguments are invalid that are null, are not one JSON value as a whole
    (anything after it counts), name a key twice, hold a number beyond a double or
    are no object; only an object or another value that can be read is in the
    record. Numbers have one form there (see number_text()). Schemas may nest (see
    Spec). Texts of any length are used whole. Empty inputs give no rows. Other columns
    are not read, so none can clash.
    """
    key = ["conv_id", "call_id"]
    c = calls.select(*key, "turn", "name", "arguments", "parent_id").distinct()
    r = results.select(*key, F.col("turn").alias("result_turn"), "content")
    named = c.filter("conv_id is not null and call_id is not null")
    whole = F.struct("turn", "name", "arguments", "parent_id")
    # read several times below, so they are written once
    scratch = Scratch(calls.sparkSession)
    firsts = scratch.save(named.groupBy(*key).agg(F.min(whole).alias("first"), F.count("*").alias("n")), "firsts")
    parents = firsts.select("conv_id", F.col("call_id").alias("parent"), F.col("first.turn").alias("parent_turn"))
    children = firsts.select("conv_id", F.col("first.parent_id").alias("parent"), F.col("first.turn").alias("turn")).filter("parent is not null")
    backward = scratch.save(children.join(parents, ["conv_id", "parent"]).filter("parent_turn >= turn").select("conv_id").distinct(), "backward")
    if backward.isEmpty():
        firsts = firsts.withColumn("depth", F.lit(None).cast("long"))
    else:
        some = firsts.select(*key, F.col("first.parent_id").alias("parent_id")).join(backward, "conv_id", "left_semi")
        firsts = firsts.join(depths(some).withColumnRenamed("__depth", "depth"), key, "left")
    no_result = [F.lit(None).cast(r.schema[x].dataType).alias(x) for x in ("result_turn", "content")]
    of_result = r.join(firsts.withColumn("there", F.lit(True)), key, "left").select(*key, "first.*", "result_turn", "content", "depth", F.when(F.col("there"), "linked").otherwise("orphan").alias("status"))
    pending = firsts.join(r.select(*key).distinct(), key, "left_anti").select(*key, "first.*", *no_result, "depth", F.lit("pending").alias("status"))
    more = named.join(firsts.filter("n > 1").select(*key, "first", "depth"), key).filter(~whole.eqNullSafe(F.col("first")))
    repeated = more.select(*key, "turn", "name", "arguments", "parent_id", *no_result, "depth", F.lit("repeated").alias("status"))
    unnamed = c.filter("conv_id is null or call_id is null").select(*key, "turn", "name", "arguments", "parent_id", *no_result, F.lit(None).cast("long").alias("depth"), F.lit("pending").alias("status"))
    linked = of_result.unionByName(pending).unionByName(repeated).unionByName(unnamed)
    is_call = F.col("status") != "orphan"
    value, wrong = _read(F.col("arguments"))
    checked = linked.withColumns({"parsed": value, "wrong": wrong})
    checked = checked.withColumn("errors", F.when(is_call, _errors(F.col("parsed"), F.col("wrong"), F.coalesce("name", F.lit("")), schemas)))
    checked = checked.withColumn("valid", F.size("errors") == 0)
    rest = F.to_json(F.struct("call_id", "content", "conv_id", "name", "parent_id", "status", "turn", "valid"), {"ignoreNullFields": "false"})
    record = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("parsed")), F.lit("null")), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    out = checked.select(*key, "turn", "result_turn", "status", "depth", "valid", "errors", record.alias("record"))
    order = [F.when(F.col("depth") < 0, 1).otherwise(0), F.coalesce("depth", F.lit(0)), F.coalesce("turn", "result_turn"), "call_id", "result_turn"]
    return out.orderBy("conv_id", *order)


#: The tool that the turns of plain conversations stand for.
REPLY = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def turns_as_calls(conversations: DataFrame, newest_first: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns: each user turn calls reply, the assistant's next turn is its result.

    A call's identifier is conversation:turn; its parent is the call whose result
    stands right before it, or right after it where newest_first holds. Turns of
    other roles, or with a null role, are neither.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    before = F.when(F.col("turn") >= 2, name(F.col("turn") - 2))
    calls = c.filter("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"),
        (before if newest_first is None else F.when(newest_first, name(F.col("turn") + 2)).otherwise(before)).alias("parent_id"),
    )
    results = c.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
