"""Tool-call linking in DataFrame expressions: results join calls by identifier, calls are ordered after what they depend on,
arguments keep their JSON types and are checked against schemas, and each call becomes canonical JSON (keys sorted at every
depth, nulls written). Nothing vanishes: rows without identifier, conflicting repeats and results without a call say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import materialise

KEY = ["conv_id", "call_id"]
# How Spark names the types of JSON values, and ours. Named types stand alone in a schema or nested: ``object<n:integer>``,
# ``array<string>``; a plain ``object`` or ``array`` holds anything.
NAMES = {r"BIGINT|DECIMAL\(\d+,0\)": "integer", r"DECIMAL\(\d+,\d+\)|DOUBLE": "number", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _told_apart(df: DataFrame, *values: str) -> DataFrame:
    """Distinct rows with ``copies``, their number, and ``first``: whether a row stands for its identifier, which of several different ones
    the one of the smallest SHA-256 does, and null without an identifier. Counts and minima combine before they shuffle, and minima are those of
    digests, so texts travel twice; no identifier is one task's."""
    digest = F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)
    rows = df.groupBy(*KEY, *values).agg(F.count("*").alias("copies")).withColumn("_v", digest)
    least = df.select(*KEY, digest.alias("_v")).where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min("_v").alias("_least"))
    return rows.join(least, KEY, "left").withColumn("first", F.when(F.col("_least").isNotNull(), F.col("_v") == F.col("_least"))).drop("_v", "_least")


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls(conv_id, call_id, parent_id): 0 without a known parent, else one more than its parent's; null on
    a cycle or behind one. Pointers double each round, so rounds grow with the logarithm of the longest chain and no conversation is
    gathered in one task: every join is on the identifier."""
    known = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    start = calls.join(known, ["conv_id", "parent_id"], "left").select(*KEY, F.when(F.col("known"), F.col("parent_id")).alias("up"))
    state = materialise(start.withColumn("level", F.col("up").isNotNull().cast("long")), "chat-levels")
    left, reach = state.count(), 1
    while reach <= left and not state.where("up is not null").isEmpty():
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
        state = state.join(above, ["conv_id", "up"], "left").select(*KEY, F.col("up2").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        state, reach = materialise(state, "chat-levels"), reach * 2
    return state.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


#: Number literals that a variant doesn't hold as they are: more than 38 digits, or, with an exponent, more than 15 or more than two in the exponent.
TOO_LARGE = r"[0-9](?:\.?[0-9]){38}|[0-9](?:\.?[0-9]){15,40}[eE]|[0-9.][eE][-+]?[0-9]{3}"


def parsed_arguments(text: Column) -> Column:
    """The arguments as a variant; null where they are no JSON, name a key twice, or have a number that would lose digits."""
    outside = F.regexp_replace(F.regexp_replace(text, F.lit(r"(?s)\\."), F.lit("")), F.lit('"[^"]*"'), F.lit('""'))
    lost = F.when(text.rlike(TOO_LARGE), outside.rlike(TOO_LARGE)).otherwise(False)
    return F.when(~lost, F.try_parse_json(text))


def arguments_valid(arguments: Column, required: Column, types: Column) -> Column:
    """Whether the parsed arguments (null: malformed) are an object with every required name, no unknown one, and values of the named types."""
    def fits(name: Column, value: Column) -> Column:
        found = F.schema_of_variant(value)
        for spark_name, ours in NAMES.items():
            found = F.regexp_replace(found, rf"(?<=^|<|: )(?:{spark_name})(?=$|[,>])", ours)
        found = F.regexp_replace(F.regexp_replace(found, "(?<=^|<|: )(OBJECT|ARRAY)<", "~$1<"), ": ", ":")
        # names that are no identifiers stand in backticks
        found = F.translate(F.replace(F.replace(found, F.lit("~OBJECT"), F.lit("object")), F.lit("~ARRAY"), F.lit("array")), "` ", "")
        kind = F.regexp_replace(F.translate(F.try_element_at(types, name), "` ", ""), r"([-.+*?()\[\]{}^$|\\])", r"\\$1")
        for was, becomes in ((r"\barray<(\w+)>", "array<(?:null|$1)>"), (r"\bnumber(?=$|[,>)])", "(?:number|integer)"), (r"\b(object|array)(?=$|[,>)])", "$1<.*>")):
            kind = F.regexp_replace(kind, was, becomes)
        return F.coalesce(F.regexp_like(found, F.concat(F.lit("^(?:"), kind, F.lit(")$"))), F.lit(False))

    held = F.try_variant_get(arguments, "$", "map<string,variant>")
    keys = F.map_keys(held)
    return F.coalesce(F.forall(required, lambda r: F.array_contains(keys, r)) & F.forall(keys, lambda k: fits(k, F.try_element_at(held, k))), F.lit(False))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, kind, status, copies, level, valid, json) of calls(conv_id, call_id, parent_id, name, arguments JSON) and
    results(conv_id, call_id, content), whose equal rows are one with a number of ``copies``.

    A call (kind ``call``) is ``linked`` or ``unanswered``; a result that links is part of its call's JSON, one without a call is a row of its
    own (kind ``result``, ``orphan``). Of different calls or results with one identifier the one of the smallest digest counts, the others are ``repeat``;
    without identifier rows are ``unnamed``. ``level`` is null where calls depend on themselves, and for rows that don't count.
    schemas(name, required array, types map): of several for one tool the smallest counts. A call of an unknown tool or with malformed
    arguments (repeated keys and numbers of more than 38 digits, or 15 with an exponent, too) is invalid; malformed text stays as ``raw``. ``1.0`` is an integer, ``1e2`` a number. Null content is a result like any other. Texts of any length are
    one value of one row. Empty tables give no rows, further columns are ignored.
    """
    calls, results = _told_apart(calls, "name", "arguments", "parent_id"), _told_apart(results, "content")
    answers = results.where("first").select(*KEY, "content", F.lit(True).alias("linked"))
    levels = call_levels(calls.where("first").select(*KEY, "parent_id"))
    tools = schemas.groupBy("name").agg(F.min(F.struct("required", F.map_entries("types").alias("types"))).alias("s"))
    tools = tools.select("name", "s.required", F.map_from_entries("s.types").alias("types"))
    full = calls.join(answers, KEY, "left").join(levels, KEY, "left").join(tools, "name", "left").withColumn("parsed", parsed_arguments(F.col("arguments")))
    full = full.withColumns({c: F.when(F.col("first"), F.col(c)) for c in ("content", "linked", "level")})
    # a variant holds the fields of its objects in the order of their names
    raw = F.when(F.col("parsed").isNull(), F.col("arguments"))
    body = F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("parent_id").alias("parent"), raw.alias("raw"), F.col("content").alias("result"))
    named = F.when(F.col("first").isNull(), "unnamed").when(~F.col("first"), "repeat")
    out = full.select(
        *KEY, F.lit("call").alias("kind"), F.coalesce(named, F.when(F.col("linked"), "linked").otherwise("unanswered")).alias("status"), "copies", "level",
        arguments_valid(F.col("parsed"), F.col("required"), F.col("types")).alias("valid"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"),
    )
    asked = calls.where("first").select(*KEY, F.lit(True).alias("asked"))
    lone = results.join(asked, KEY, "left").where("asked is null or first is null or not first")
    text = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    nothing = lambda kind: F.lit(None).cast(kind)
    return out.unionByName(lone.select(*KEY, F.lit("result").alias("kind"), F.coalesce(named, F.lit("orphan")).alias("status"), "copies", nothing("long").alias("level"), nothing("boolean").alias("valid"), text.alias("json")))


#: Tools that turns of the generated conversations are read as calls of: (name, required, types).
TOOLS = (
    ("reply", ("text",), {"text": "string", "length": "integer"}),
    ("outline", ("lines", "options"), {"lines": "array<string>", "options": "object<numbered:boolean,words:integer>"}),
)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations``: system turns as messages, user turns as calls with what the assistant says next, other turns of
    the assistant as results without a call.

    The table names no tools. A user turn of several lines reads as a call of ``outline``, with the number of words as a string, which its
    schema rejects, where the last line has a comma; any other one as a call of ``reply``. It depends on the user turn
    two before. Turns of other roles count as messages, too.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    lines = F.split("text", "\n")
    words, numbered = F.size(F.split("text", r"\s+")), F.size(lines) > 2
    options = lambda n: F.struct(numbered.alias("numbered"), n.alias("words"))
    reply = F.to_json(F.struct("text", F.length("text").alias("length")))
    outline = F.when(~F.contains(F.element_at(lines, -1), F.lit(",")), F.to_json(F.struct(lines.alias("lines"), options(words).alias("options")))).otherwise(F.to_json(F.struct(lines.alias("lines"), options(words.cast("string")).alias("options"))))
    several = F.contains("text", F.lit("\n"))
    calls = turns.where("role = 'user'").select(
        "conv_id", F.col("turn").alias("call_id"), (F.col("turn") - 2).alias("parent_id"), F.when(several, "outline").otherwise("reply").alias("name"), F.when(several, outline).otherwise(reply).alias("arguments")
    )
    results = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    each = [F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, r)).alias("required"), F.create_map(*[F.lit(x) for pair in t.items() for x in pair]).alias("types")) for n, r, t in TOOLS]
    linked = link_calls(calls, results, spark.range(1).select(F.inline(F.array(*each))))
    said = turns.where("role is null or role not in ('user', 'assistant')").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    message = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    nothing = lambda kind: F.lit(None).cast(kind)
    return linked.unionByName(said.select("conv_id", F.col("turn").alias("call_id"), F.lit("message").alias("kind"), F.lit("said").alias("status"), "copies", nothing("long").alias("level"), nothing("boolean").alias("valid"), message.alias("json")))
