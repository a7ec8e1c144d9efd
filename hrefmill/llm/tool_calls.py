"""Chat formatting: tool calls linked with their results, ordered, validated, and written as canonical JSON.

A message whose text is a JSON object with ``tool_calls`` places calls (``id``, ``name``, ``arguments`` and
optionally ``depends_on``, ids of calls it needs); one with ``tool_call_id`` is a result; anything else is text.
Calls and results of a conversation are hash-joined by identifier. Arguments are checked against the tools'
schemas (known, required and typed parameters). The output is one row per call, result or text with its
canonical JSON (VARIANT: keys sorted, no white space), so a conversation of any length stays spread over tasks.

``(conv_id, level, turn, place)`` is a topological order. A call that depends on earlier calls only is in order
as it stands and has level 0; conversations in which some call depends on a later one are levelled by rounds,
one per step of their longest chain. Calls on a cycle, or behind one, get no level and the error ``cyclic``.

Defined cases: a null text is an empty message of kind ``text``; a call without an id cannot be linked (error
``no id``); of calls with one id the first in turn order is linked, later ones have the error ``repeated id``;
of results with one id the first counts as the answer; rows without a conversation form one of their own;
repeated rows are separate messages; an empty table gives no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefmill.llm.tables import keep

#: Tools of the registered query: parameter -> (type, required).
TOOLS = {
    "answer": {"prompt": ("string", True), "turn": ("integer", True)},
    "configure": {"instruction": ("string", True)},
}


def _variant(of: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(of, path, kind)


def parts(messages: DataFrame) -> DataFrame:
    """One row per call, result or text of ``messages (conv_id, turn, role, text)``."""
    read = messages.select("conv_id", "turn", "role", "text", F.try_parse_json("text").alias("v"))
    calls = _variant(F.col("v"), "$.tool_calls", "array<variant>")
    answers = _variant(F.col("v"), "$.tool_call_id", "string")
    read = read.withColumns({"calls": calls, "answers": answers})
    placing = F.coalesce(F.size("calls") > 0, F.lit(False))
    # A message without calls goes on as one row.
    rows = read.select(
        "conv_id", "turn", "role", "text", "v", "answers", placing.alias("placing"),
        F.posexplode(F.when(placing, F.col("calls")).otherwise(F.array(F.lit(None).cast("variant")))).alias("place", "call"),
    )
    arguments = _variant(F.col("call"), "$.arguments", "variant")
    # Some senders put the arguments into a string.
    arguments = F.when(F.schema_of_variant(arguments) == "STRING", F.try_parse_json(arguments.cast("string"))).otherwise(arguments)
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("placing"), "call").when(F.col("answers").isNotNull(), "result").otherwise("text").alias("kind"),
        "place",
        F.when(F.col("placing"), _variant(F.col("call"), "$.id", "string")).otherwise(F.col("answers")).alias("call_id"),
        F.when(F.col("placing"), _variant(F.col("call"), "$.name", "string")).alias("tool"),
        F.when(F.col("placing"), arguments).alias("arguments"),
        F.when(F.col("placing"), F.coalesce(_variant(F.col("call"), "$.depends_on", "array<string>"), F.array().cast("array<string>")))
        .alias("depends_on"),
        F.when(F.col("answers").isNotNull() & ~F.col("placing"), F.col("v")).alias("body"),
        F.when(F.col("answers").isNull() & ~F.col("placing"), F.coalesce("text", F.lit(""))).alias("content"),
    )


def problems(tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted list of what is wrong with a call's tool and arguments. The tools are part of the plan."""
    given = _variant(F.col("arguments"), "$", "map<string,variant>")
    kinds = F.transform_values(given, lambda _, v: F.schema_of_variant(v))
    none = F.array().cast("array<string>")
    checks: Column | None = None
    for name, parameters in tools.items():
        found = [none]
        for p, (kind, required) in parameters.items():
            is_kind = F.get(F.array(F.element_at(kinds, p)), F.lit(0))
            fits = {
                "string": is_kind == "STRING",
                "integer": is_kind == "BIGINT",
                "number": (is_kind == "BIGINT") | (is_kind == "DOUBLE") | is_kind.startswith("DECIMAL"),
                "boolean": is_kind == "BOOLEAN",
                "object": is_kind.startswith("OBJECT"),
                "array": is_kind.startswith("ARRAY"),
            }[kind]
            absent = F.array(F.lit(f"missing {p}")) if required else none
            found.append(F.when(is_kind.isNull(), absent).when(~fits, F.array(F.lit(f"type of {p}"))).otherwise(none))
        allowed = F.array(*[F.lit(p) for p in parameters]) if parameters else none
        extra = F.transform(F.array_except(F.map_keys(given), allowed), lambda k: F.concat(F.lit("unknown "), k))
        found.append(F.coalesce(extra, none))
        here = F.when(given.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.concat(*found))
        checks = F.when(F.col("tool") == name, here) if checks is None else checks.when(F.col("tool") == name, here)
    unknown = F.array(F.lit("unknown tool"))
    return F.array_sort(unknown if checks is None else checks.otherwise(unknown))


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` by rounds: a call is placed when all calls it depends on are."""
    placed = None
    left = keep(calls.select("conv_id", "call_id"))
    edges = keep(edges.select("conv_id", "call_id", "needs"))
    level = 0
    while not left.isEmpty():
        waiting = edges.select("conv_id", "call_id").distinct()
        same = left["conv_id"].eqNullSafe(waiting["conv_id"]) & (left["call_id"] == waiting["call_id"])
        ready = keep(left.join(waiting, same, "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        placed = ready if placed is None else keep(placed.unionByName(ready))
        gone = ready.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
        left = keep(left.join(gone, left["conv_id"].eqNullSafe(gone["c"]) & (left["call_id"] == gone["i"]), "left_anti"))
        edges = keep(edges.join(gone, edges["conv_id"].eqNullSafe(gone["c"]) & (edges["needs"] == gone["i"]), "left_anti"))
        level += 1
    if placed is None:
        return left.withColumn("level", F.lit(None).cast("int"))
    return placed.unionByName(left.withColumn("level", F.lit(None).cast("int")))


def link(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """All parts of the messages: ``conv_id, turn, place, role, kind, call_id, tool, level, linked, errors, json``."""
    rows = parts(messages)
    position = F.struct("turn", "place", F.col("json"))
    canonical = (
        F.when(F.col("kind") == "call", F.to_json(F.struct("arguments", "depends_on", F.col("call_id").alias("id"), F.col("tool").alias("name"))))
        .when(F.col("kind") == "result", F.to_json("body"))
        .otherwise(F.to_json(F.struct("content", "role")))
    )
    rows = rows.withColumn("errors", F.when(F.col("kind") == "call", problems(tools)))
    rows = keep(
        rows.withColumn("json", canonical).select(
            "conv_id", "turn", "place", "role", "kind", "call_id", "tool", "depends_on", "errors", "json"
        )
    )
    named = rows.filter(F.col("call_id").isNotNull())
    is_call = F.col("kind") == "call"
    # One row per identifier, summed up before the shuffle: the first call, and whether there is a result.
    ids = keep(
        named.groupBy("conv_id", "call_id").agg(
            F.min(F.when(is_call, position)).alias("first_call"),
            F.min(F.when(~is_call, position)).alias("first_result"),
        )
    ).withColumnsRenamed({"conv_id": "c", "call_id": "i"})
    same = lambda left: left["conv_id"].eqNullSafe(ids["c"]) & (left["call_id"] == ids["i"])
    joined = named.join(ids, same(named))
    first = F.coalesce(F.col("first_call") == position, F.lit(False))
    needs = joined.filter(is_call & first & (F.size("depends_on") > 0)).select(
        "conv_id", "call_id", F.col("first_call").alias("at"), F.explode(F.array_distinct("depends_on")).alias("needs")
    )
    known = ids.filter(F.col("first_call").isNotNull()).select(
        F.col("c").alias("kc"), F.col("i").alias("ki"), F.col("first_call").alias("needed_at")
    )
    edges = keep(
        needs.join(known, needs["conv_id"].eqNullSafe(known["kc"]) & (needs["needs"] == known["ki"]), "left").select(
            "conv_id", "call_id", "needs", F.col("needed_at").isNull().alias("dangling"),
            F.coalesce(F.col("needed_at") >= F.col("at"), F.lit(False)).alias("forward"),
        )
    )
    late = edges.filter("forward").select(F.col("conv_id").alias("lc")).distinct()
    dangling = (
        edges.filter("dangling")
        .groupBy("conv_id", "call_id")
        .agg(F.array_sort(F.collect_list(F.concat(F.lit("unknown call "), "needs"))).alias("lost"))
    ).withColumnsRenamed({"conv_id": "dc", "call_id": "di"})
    out = joined.withColumn("first", first)
    out = out.join(dangling, out["conv_id"].eqNullSafe(dangling["dc"]) & (out["call_id"] == dangling["di"]), "left").drop("dc", "di")
    out = out.withColumns({"level": F.lit(0), "cyclic": F.lit(False)})
    if not late.isEmpty():
        late = keep(late)
        calls = known.select(F.col("kc").alias("conv_id"), F.col("ki").alias("call_id"))
        within = lambda df: df.join(late, df["conv_id"].eqNullSafe(late["lc"]), "left_semi")
        levels = keep(_levels(within(calls), within(edges.filter(~F.col("dangling"))))).select(
            F.col("conv_id").alias("vc"), F.col("call_id").alias("vi"), F.col("level").alias("found"), F.lit(True).alias("levelled")
        )
        out = out.join(levels, out["conv_id"].eqNullSafe(levels["vc"]) & (out["call_id"] == levels["vi"]), "left").withColumns(
            {
                "level": F.when(F.col("levelled"), F.col("found")).otherwise(F.lit(0)),
                "cyclic": F.coalesce("levelled", F.lit(False)) & F.col("found").isNull(),
            }
        )
    none = F.array().cast("array<string>")
    call_errors = F.concat(
        F.coalesce("errors", none),
        F.coalesce(F.when(F.col("first"), F.col("lost")), none),
        F.when(F.col("first"), none).otherwise(F.array(F.lit("repeated id"))),
        F.when(F.col("cyclic"), F.array(F.lit("cyclic"))).otherwise(none),
    )
    errors = F.when(is_call, call_errors).otherwise(
        F.when(F.col("first_call").isNull(), F.array(F.lit("no call"))).otherwise(none)
    )
    linked = F.when(is_call, F.col("first") & F.col("first_result").isNotNull()).otherwise(F.col("first_call").isNotNull())
    columns = ["conv_id", "turn", "place", "role", "kind", "call_id", "tool", "level", "linked", "errors", "json"]
    out = out.withColumns({"errors": errors, "linked": linked}).select(*columns)
    bare = rows.filter(F.col("call_id").isNull()).withColumns(
        {
            "level": F.lit(0),
            "linked": F.lit(False),
            "errors": F.when(is_call, F.concat(F.coalesce("errors", none), F.array(F.lit("no id")))).otherwise(none),
        }
    )
    return out.unionByName(bare.select(*columns))


def as_transcript(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool transcripts: users and systems place calls, assistants answer the call before.

    The digits of a text's MD5 make a user's calls differ. By the first, one in eight gives its turn as a string;
    by the second, one in sixteen takes the id of two turns earlier; by the third, five in sixteen need the call two
    turns later, and three in sixteen the one two turns earlier.
    """
    call = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    turn = F.col("turn")
    digit = lambda i: F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), i, 1)
    own = F.when((turn >= 2) & (digit(2) == "0"), call(turn - 2)).otherwise(call(turn))
    needs = F.when(digit(3) < "5", F.array(call(turn + 2))).when((turn >= 2) & (digit(3) < "8"), F.array(call(turn - 2)))

    def placed(turn_given: Column) -> Column:
        arguments = F.struct(turn_given.alias("turn"), F.col("text").alias("prompt"))
        one = F.struct(own.alias("id"), F.lit("answer").alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
        return F.to_json(F.struct(F.array(one).alias("tool_calls")))

    told = F.struct(
        F.array(
            F.struct(
                call(turn).alias("id"),
                F.lit("configure").alias("name"),
                F.struct(F.col("text").alias("instruction")).alias("arguments"),
            )
        ).alias("tool_calls")
    )
    answered = F.struct(call(turn - 1).alias("tool_call_id"), F.col("text").alias("content"))
    is_user = F.col("role") == "user"
    text = (
        F.when(is_user & (digit(1) < "2"), placed(turn.cast("string")))
        .when(is_user, placed(turn))
        .when(F.col("role") == "system", F.to_json(told))
        .when(F.col("role") == "assistant", F.to_json(answered))
        .otherwise(F.col("text"))
    )
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as tool transcripts: linked, ordered, validated, in canonical JSON."""
    found = link(as_transcript(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)
    return found.select(
        "conv_id", "turn", "kind", "call_id", "tool", "level", "linked", F.array_join("errors", "; ").alias("errors"), "json"
    )


OP2_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, 'call_' || conv_id || '_' AS p, to_json(text)::VARCHAR AS t, md5(text) AS d
    FROM conversations WHERE role IN ('user', 'system', 'assistant')),
calls AS (SELECT *, p || (turn - CASE WHEN role = 'user' AND turn >= 2 AND d[2] = '0' THEN 2 ELSE 0 END) AS id,
    CASE WHEN role <> 'user' THEN NULL WHEN d[3] < '5' THEN p || (turn + 2)
        WHEN turn >= 2 AND d[3] < '8' THEN p || (turn - 2) END AS dep,
    CASE WHEN d[1] < '2' THEN '"' || turn || '"' ELSE turn::VARCHAR END AS given,
    role = 'user' AND d[1] < '2' AS odd FROM m WHERE role <> 'assistant'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn) = 1 AS is_first FROM calls),
firsts AS (SELECT * FROM ranked WHERE is_first),
results AS (SELECT *, p || (turn - 1) AS id FROM m WHERE role = 'assistant'),
rids AS (SELECT DISTINCT conv_id, id FROM results),
edges AS (SELECT f.conv_id, f.id, f.dep, k.turn >= f.turn AS forward
    FROM firsts f JOIN firsts k ON k.conv_id = f.conv_id AND k.id = f.dep),
late AS (SELECT DISTINCT conv_id FROM edges WHERE forward),
placed AS (
    SELECT f.conv_id, f.id, 0 AS level FROM firsts f
    WHERE f.conv_id IN (FROM late) AND NOT EXISTS (FROM edges e WHERE e.conv_id = f.conv_id AND e.id = f.id)
    UNION ALL
    SELECT e.conv_id, e.id, placed.level + 1 FROM placed JOIN edges e ON e.conv_id = placed.conv_id AND e.dep = placed.id),
ids AS (SELECT f.conv_id, f.id, CASE WHEN l.conv_id IS NULL THEN 0 ELSE p.level END AS level
    FROM firsts f LEFT JOIN late l ON l.conv_id = f.conv_id LEFT JOIN placed p ON p.conv_id = f.conv_id AND p.id = f.id)
SELECT c.conv_id, c.turn, 'call' AS kind, c.id AS call_id,
    CASE role WHEN 'user' THEN 'answer' ELSE 'configure' END AS tool, i.level, c.is_first AND r.id IS NOT NULL AS linked,
    concat_ws('; ', CASE WHEN odd THEN 'type of turn' END,
        CASE WHEN c.is_first AND dep IS NOT NULL AND n.known IS NULL THEN 'unknown call ' || dep END,
        CASE WHEN NOT c.is_first THEN 'repeated id' END, CASE WHEN i.level IS NULL THEN 'cyclic' END) AS errors,
    CASE role WHEN 'user' THEN '{"arguments":{"prompt":' || t || ',"turn":' || given || '},"depends_on":['
        || CASE WHEN dep IS NOT NULL THEN '"' || dep || '"' ELSE '' END || '],"id":"' || c.id || '","name":"answer"}'
    ELSE '{"arguments":{"instruction":' || t || '},"depends_on":[],"id":"' || c.id || '","name":"configure"}' END AS json
FROM ranked c JOIN ids i ON i.conv_id = c.conv_id AND i.id = c.id
LEFT JOIN rids r ON r.conv_id = c.conv_id AND r.id = c.id
LEFT JOIN (SELECT conv_id, id AS known FROM firsts) n ON n.conv_id = c.conv_id AND n.known = c.dep
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.id, NULL, CASE WHEN i.id IS NULL THEN 0 ELSE i.level END, i.id IS NOT NULL,
    CASE WHEN i.id IS NULL THEN 'no call' ELSE '' END, '{"content":' || t || ',"tool_call_id":"' || r.id || '"}'
FROM results r LEFT JOIN ids i ON i.conv_id = r.conv_id AND i.id = r.id
"""
