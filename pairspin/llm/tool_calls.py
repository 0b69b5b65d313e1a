"""Tool-call linking for chat formatting.  DataFrame functions only.

Calls and results meet in a hash join on (conversation, call id).  Arguments are checked against the tools' schemas,
references from arguments to earlier calls order the calls topologically, and each call, with its
result, becomes one canonical JSON text (keys sorted, no blanks, one spelling of each number and string).

Rows that share (conversation, call id) are numbered by turn, and the k-th call meets the k-th result, so every
input row is in one output row.  Numbers come from range partitions and the counts of those before, and
joins are by (conversation, call id, number): a hot id is no hot group.  Null conversations and ids are
keys of their own.  References mean the first call of an id.  Levels are found in
rounds, each a join of edges with the calls settled before; a round's rows are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table

#: tool -> field -> (type, required, least, most); of strings the length is bounded, of numbers the value.
Schemas = Mapping[str, Mapping[str, tuple[str, bool, int | None, int | None]]]
SCHEMAS: Schemas = {
    "lookup": {"limit": ("int", True, 1, 20), "query": ("string", True, 1, 250)},
    "search": {"after": ("object", False, None, None), "limit": ("int", True, 0, 40), "query": ("string", True, 1, 400)},
}

#: Equal rows that one array tells apart.
CHUNK = 4096


#: What stands for an escaped backslash and an escaped quote while a text is cut at its quotes, and begins the strings that stand for numbers.
BACKSLASH, QUOTE, NUMBER = "\x02", "\x03", "\\u0001"


def canonical_number(token: Column) -> Column:
    """One text for all JSON numbers of one value, with every digit: plain up to twenty zeros or places, then digits and a power of ten."""
    whole, places = F.regexp_extract(token, "^-?([0-9]+)", 1), F.regexp_extract(token, r"\.([0-9]+)", 1)
    power = F.regexp_extract(token, "[eE]([+-]?[0-9]+)$", 1)
    exponent = F.when(power == "", F.lit(0).cast("long")).otherwise(power.try_cast("long"))
    stripped = F.rtrim(F.concat(whole, places), F.lit("0"))
    digits = F.ltrim(stripped, F.lit("0"))
    shift = exponent - F.length(stripped) + F.length(whole)
    point = (F.length(digits) + shift).cast("int")
    plain = (
        F.when(shift.between(0, 20), F.concat(digits, F.repeat(F.lit("0"), shift.cast("int"))))
        .when(shift.between(-20, -1) & (point > 0), F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        .when(shift.between(-20, -1), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(F.concat(digits, F.lit("e"), shift.cast("string")))
    )
    found = F.when(digits == "", "0").otherwise(F.concat(F.when(token.startswith("-"), "-").otherwise(""), plain))
    return F.when(exponent.isNull() | (F.abs(exponent) > 1_000_000_000), token).otherwise(found)


def canonical_json(text: Column) -> Column:
    """``text`` with sorted keys, no blanks, one spelling of each string and number; null for what isn't JSON, or repeats a key in an object.

    Numbers are put in strings of their own while the text is a variant, which has not room for all of them.
    """
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    number = F.lit(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")

    def outside(part: Column) -> Column:
        tokens = F.regexp_extract_all(part, F.lit("-?[0-9][0-9.eE+-]*|[^0-9-]+|-"), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.when(F.regexp_like(t, number), F.concat(F.lit('"' + NUMBER), canonical_number(t), F.lit('"'))).otherwise(t)), "")

    parts = F.transform(F.split(hidden, '"'), lambda part, k: F.when(k % 2 == 0, outside(part)).when(part.startswith(NUMBER), F.concat(F.lit(NUMBER), part)).otherwise(part))
    ready = F.replace(F.replace(F.array_join(parts, '"'), F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))
    clean = ~F.contains(text, F.lit(BACKSLASH)) & ~F.contains(text, F.lit(QUOTE))
    sorted_ = F.to_json(F.try_parse_json(F.when(clean, ready)))
    # a quote that opens a string stands after one of these, or first
    opening = r'(?:^|(?<=[{\[,:]))"'
    back = F.regexp_replace(sorted_, opening + r'\\u0001(-?[0-9][0-9.e-]*)"', "$1")
    return F.regexp_replace(back, opening + r"\\u0001\\u0001", r'"\\u0001')


def schema_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with ``arguments`` (JSON text) for the tool ``name``; empty if nothing is."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    unknown_tool = F.array(F.lit("unknown tool"))
    out = unknown_tool
    for tool, fields in schemas.items():
        checks: list[Column] = []
        for field, (kind, required, least, most) in fields.items():
            here = F.coalesce(F.array_contains(keys, field), F.lit(False))
            if required:
                checks.append(F.when(~here, F.lit(f"{field}: missing")))
            # what the JSON itself says the type is
            found = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            accepted = {"int": found.isin("BIGINT"), "number": found.isin("BIGINT", "DOUBLE") | found.startswith("DECIMAL"), "string": found == "STRING", "boolean": found == "BOOLEAN", "object": found.startswith("OBJECT"), "array": found.startswith("ARRAY")}[kind]
            fits = F.coalesce(accepted, F.lit(False))
            checks.append(F.when(here & ~fits, F.lit(f"{field}: not {kind}")))
            size = F.length(F.try_variant_get(value, f"$.{field}", "string")) if kind == "string" else F.try_variant_get(value, f"$.{field}", "double")
            if least is not None:
                checks.append(F.when(here & fits & (size < least), F.lit(f"{field}: under {least}")))
            if most is not None:
                checks.append(F.when(here & fits & (size > most), F.lit(f"{field}: over {most}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(fields)))), lambda k: F.concat(F.lit("unknown field "), k))
        errors = F.array_sort(F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.array().cast("array<string>"))))
        out = F.when(name == tool, errors).otherwise(out)
    # what a parser takes that leaves out what it has met before is JSON
    repeated = F.get_json_object(arguments, "$").isNotNull() & value.isNull()
    return F.when(repeated, F.array(F.lit("repeated key"))).when(keys.isNull() | value.isNull(), F.array(F.lit("not a JSON object"))).otherwise(out)


def references(arguments: Column) -> Column:
    """Distinct call ids that canonical arguments refer to, as ``{"$ref":"id"}`` anywhere in them."""
    found = F.regexp_extract_all(F.coalesce(arguments, F.lit("")), F.lit(r'"\$ref":"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_compact(F.array_distinct(F.transform(found, lambda x: F.get(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>"), F.lit(0)))))


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, where nulls equal each other."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    both = left.join(right.hint("shuffle_hash"), F.expr(" AND ".join(f"{k} <=> _{k}" for k in keys)), how)
    if how == "full":
        both = both.withColumns({k: F.coalesce(k, f"_{k}") for k in keys})
    return both.drop(*(f"_{k}" for k in keys))


def numbered(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``rows`` (conv_id, call_id, columns) with k, the place by ``columns`` from 0 among the rows of its ids, and n, their count.

    Equal rows are counted first and told apart at the end.  The rest is ranged over partitions; only ids that go on
    from one partition in another need the counts of others, at most two rows of such a table a partition.
    """
    ids, order = ["conv_id", "call_id"], [columns[0], "tie"]
    kinds = rows.select(*ids, *columns).groupBy(*ids, *columns).agg(F.count("*").alias("same"))
    ranged = kinds.withColumn("tie", F.xxhash64(*columns)).repartitionByRange(*ids, *order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), name)
    inside = Window.partitionBy("part", *ids)
    before = inside.orderBy(*order, *columns[1:]).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("part", *ids).agg(F.sum("same").alias("rows"))
    # of each partition only the first and the last ids can be in others
    edges = ranged.groupBy("part").agg(F.min(F.struct(*ids)).alias("a"), F.max(F.struct(*ids)).alias("z"))
    edges = edges.select("part", F.explode(F.array_distinct(F.array("a", "z"))).alias("x")).select("part", F.col("x.conv_id").alias("conv_id"), F.col("x.call_id").alias("call_id"))
    over = meet(counts, F.broadcast(edges), ["part", *ids], "left_semi")
    every = Window.partitionBy(*ids)
    over = over.select("part", *ids, F.coalesce(F.sum("rows").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"), F.sum("rows").over(every).alias("rows_all"))
    placed = ranged.withColumn("first", F.coalesce(F.sum("same").over(before), F.lit(0))).withColumn("here", F.sum("same").over(inside))
    placed = meet(placed, F.broadcast(over), ["part", *ids], "left")
    placed = placed.select(*ids, *columns, "same", (F.col("first") + F.coalesce("rows_before", F.lit(0))).alias("first"), F.coalesce("rows_all", "here").alias("n"))
    # in two steps, so that no array is long
    placed = placed.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (same - 1) div {CHUNK})")))
    one = F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(same, (chunk + 1) * {CHUNK}) - 1)"))
    return placed.withColumn("one", one).select(*ids, *columns, (F.col("first") + F.col("one")).alias("k"), "n")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, dangling): length of the longest chain of references below each call.

    ``dangling`` counts references to no call.  Calls on a cycle, or after one, have a null level.
    ``calls`` has one row for each (conv_id, call_id), and ``refs``.
    """
    ids, up = ["conv_id", "call_id"], ["conv_id", "parent"]
    nodes = calls.select("conv_id", "call_id", "refs")
    edges = nodes.select("conv_id", "call_id", F.explode("refs").alias("parent"))
    known = nodes.select("conv_id", F.col("call_id").alias("parent"))
    live = materialize(meet(edges, known, up, "left_semi"), "call-edges")
    degree = live.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_parents"))
    all_ = materialize(meet(nodes, degree, ids, "left").select("conv_id", "call_id", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), (F.size("refs") - F.coalesce("n_parents", F.lit(0))).alias("dangling")), "call-nodes")
    settled = all_.where("n_parents = 0").select("conv_id", "call_id", F.lit(0).alias("level"))
    waiting = live
    while True:
        met = meet(waiting, settled.withColumnRenamed("call_id", "parent"), up, "left")
        per = met.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("level").alias("done"), F.max("level").alias("top"))
        new = materialize(per.where("n = done").select("conv_id", "call_id", (F.col("top") + 1).alias("level")), "call-level")
        if not new.limit(1).count():
            break
        settled = settled.unionByName(new)
        waiting = meet(waiting, new.select("conv_id", "call_id"), ids, "left_anti")
    return meet(all_, settled, ids, "left").select("conv_id", "call_id", F.col("level").cast("int").alias("level"), F.col("dangling").cast("int").alias("dangling"))


def later_levels(repeats: DataFrame, settled: DataFrame) -> DataFrame:
    """(conv_id, call_id, k, level, dangling) of calls that nothing can refer to, from the levels of first calls."""
    ids = ["conv_id", "call_id", "k"]
    edges = repeats.select(*ids, F.explode_outer("refs").alias("parent"))
    parents = settled.select("conv_id", F.col("call_id").alias("parent"), "level", F.lit(1).alias("known"))
    # a null parent stands for no reference
    met = edges.where("parent is null").select(*ids, "parent", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("known"))
    met = met.unionByName(meet(edges.where("parent is not null"), parents, ["conv_id", "parent"], "left"))
    level = F.when(F.count("known") == F.count("level"), F.coalesce(F.max("level") + 1, F.lit(0)))
    return met.groupBy(*ids).agg(level.cast("int").alias("level"), (F.count("parent") - F.count("known")).cast("int").alias("dangling"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call, and each result without one.

    ``calls``: conv_id, call_id, turn, name, arguments; ``results``: conv_id, call_id, turn, content.  Of rows that repeat a
    (conv_id, call_id) the k-th call by turn is linked to the k-th result; ``repeats`` tells how many other calls (of a call)
    and other results (of a result) have the same ids.  Rows of such repeats come before those of first calls and results.
    Null ids and conversations are values of their own, and stay null; empty tables give an empty one, columns of other names aren't read.
    Arguments that are not JSON, or repeat a key, stay in ``json`` as a string of their text, and ``errors`` says so.  Columns: conv_id, call_id, call_turn,
    result_turn, status (``linked``, ``early`` if the result comes before the call, ``unanswered``, ``orphan``), repeats,
    level, dangling, errors, json.
    """
    ids = ["conv_id", "call_id", "k"]
    c = numbered(calls, ["turn", "name", "arguments"], "ranged-calls").withColumn("canonical", canonical_json(F.col("arguments")))
    c = materialize(c.withColumn("refs", references(F.col("canonical"))), "calls")
    r = materialize(numbered(results, ["turn", "content"], "ranged-results"), "results")
    found = materialize(levels(c.where("k = 0")), "call-levels")

    def paired(which: str, of_calls: DataFrame) -> DataFrame:
        c_ = meet(c.where(which), of_calls, ids, "left").select(*ids, F.col("turn").alias("call_turn"), "name", "arguments", "canonical", "level", "dangling", (F.col("n") - 1).alias("n1"))
        r_ = r.where(which).select(*ids, F.col("turn").alias("result_turn"), "content", (F.col("n") - 1).alias("n2"))
        return meet(c_, r_, ids, "full")

    both = paired("k > 0", later_levels(c.where("k > 0"), found)).unionByName(paired("k = 0", found.withColumn("k", F.lit(0).cast("long"))))
    is_call = F.col("n1").isNotNull()
    status = F.when(~is_call, "orphan").when(F.col("n2").isNull(), "unanswered").when(F.col("result_turn") < F.col("call_turn"), "early").otherwise("linked")
    quoted = lambda x: F.coalesce(F.expr(f"substr(to_json(named_struct('x', {x})), 6, length(to_json(named_struct('x', {x}))) - 6)"), F.lit("null"))
    text = lambda x: F.when(F.col(x).isNull(), F.lit("null")).otherwise(quoted(x))
    # arguments that have no canonical form stay as a string of theirs
    json = F.concat(F.lit('{"arguments":'), F.when(is_call, F.coalesce("canonical", text("arguments"))).otherwise(F.lit("null")), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"result":'), text("content"), F.lit("}"))
    errors = F.when(is_call, schema_errors(F.col("name"), F.coalesce("canonical", "arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    return both.select("conv_id", "call_id", "call_turn", "result_turn", status.alias("status"), (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("repeats"), "level", "dangling", errors.alias("errors"), json.alias("json"))


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations, which hold no tool messages of their own.

    Each user turn counts as a call of ``lookup`` (even turns) or ``search`` with its text; searches refer to the call at half their
    turn.  Each assistant turn counts as the result of the call at the turn before.
    """
    name = lambda turn: F.concat(F.lit("call-"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), turn.cast("string"))
    user, reply = turns.where("role = 'user'"), turns.where("role = 'assistant'")
    even = F.col("turn") % 2 == 0
    fields = F.struct(F.col("text").alias("query"), (F.length("text") % 45).alias("limit"), F.when(~even, F.struct(name(F.expr("turn div 2")).alias("$ref"))).alias("after"))
    calls = user.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.when(even, "lookup").otherwise("search").alias("name"), F.to_json(fields).alias("arguments"))
    return calls, reply.select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_conversations(table(spark, sf_dir, "conversations"))
    found = link(calls, results, SCHEMAS)
    return found.select("conv_id", "call_id", "call_turn", "result_turn", "status", "repeats", "level", "dangling", F.concat_ws("; ", "errors").alias("errors"), F.length("json").cast("long").alias("json_chars"), F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


def _oracle() -> str:
    return """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, min(text) AS text, count(*) - 1 AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL),
c AS (SELECT conv_id, turn, text, n, turn % 2 = 0 AS even, CAST(length(text) % 45 AS INT) AS lim, 'call-' || conv_id || '-' || turn AS call_id, 'call-' || conv_id || '-' || (turn // 2) AS ref FROM t WHERE role = 'user'),
r AS (SELECT conv_id, turn, text, n, 'call-' || conv_id || '-' || (turn - 1) AS call_id FROM t WHERE role = 'assistant'),
p AS (SELECT c.conv_id, c.call_id, CASE WHEN NOT c.even AND q.call_id IS NOT NULL THEN q.call_id END AS parent FROM c LEFT JOIN c q ON q.conv_id = c.conv_id AND q.call_id = c.ref),
lv(conv_id, call_id, level) AS (SELECT conv_id, call_id, 0 FROM p WHERE parent IS NULL UNION ALL SELECT p.conv_id, p.call_id, lv.level + 1 FROM p JOIN lv ON p.conv_id = lv.conv_id AND p.parent = lv.call_id),
e AS (SELECT c.*, lv.level, CAST(NOT even AND p.parent IS NULL AS INT) AS dangling,
  concat_ws('; ', CASE WHEN lim IS NULL THEN 'limit: missing' WHEN even AND lim < 1 THEN 'limit: under 1' WHEN even AND lim > 20 THEN 'limit: over 20' WHEN NOT even AND lim > 40 THEN 'limit: over 40' END,
    CASE WHEN text IS NULL THEN 'query: missing' WHEN length(text) < 1 THEN 'query: under 1' WHEN even AND length(text) > 250 THEN 'query: over 250' WHEN NOT even AND length(text) > 400 THEN 'query: over 400' END) AS errors,
  '{' || concat_ws(',', CASE WHEN NOT even THEN '"after":{"$ref":"' || ref || '"}' END, CASE WHEN lim IS NOT NULL THEN '"limit":' || lim END, CASE WHEN text IS NOT NULL THEN '"query":' || CAST(to_json(text) AS VARCHAR) END) || '}' AS args
  FROM c LEFT JOIN p USING (conv_id, call_id) LEFT JOIN lv USING (conv_id, call_id)),
j AS (SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, coalesce(e.call_id, r.call_id) AS call_id, e.turn AS call_turn, r.turn AS result_turn,
  CASE WHEN e.n IS NULL THEN 'orphan' WHEN r.n IS NULL THEN 'unanswered' WHEN r.turn < e.turn THEN 'early' ELSE 'linked' END AS status,
  CAST(coalesce(e.n, 0) + coalesce(r.n, 0) AS BIGINT) AS repeats, e.level AS level, e.dangling AS dangling, coalesce(e.errors, '') AS errors,
  '{"arguments":' || coalesce(e.args, 'null') || ',"id":"' || coalesce(e.call_id, r.call_id) || '","name":' || CASE WHEN e.n IS NULL THEN 'null' WHEN e.even THEN '"lookup"' ELSE '"search"' END || ',"result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS json
  FROM e FULL JOIN r ON e.conv_id = r.conv_id AND e.call_id = r.call_id)
SELECT conv_id, call_id, call_turn, result_turn, status, repeats, level, dangling, errors, CAST(length(json) AS BIGINT) AS json_chars, sha256(json) AS json_sha256 FROM j"""


QUERIES = {"op6_tool_calls": op6_tool_calls}
ORACLE_SQL = {"op6_tool_calls": _oracle()}
