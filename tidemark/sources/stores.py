"""Transcripts of the SQLite layouts: rows of ``sqlite_sessions`` to messages.

Values of the wrong type read as their default; rows whose JSON is not an
object are left out (relational) or shown as corrupted (keys and values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.coerce import iso_ms
from tidemark.sources.subagents import completions

# fixed values: text keys of a bubble in order, and the ways a plan is accepted
TEXT_KEYS = ("text", "content", "finalText", "message", "markdown", "textDescription")
ACCEPTED = ("accept", "accepted", "approve", "approved")
NO_TEXT = ("[empty message]", "[corrupted message]")


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _typed(value: Column, path: str, kind: str) -> Column:
    """The value as text where it is of that JSON kind, else null."""
    return F.when(F.schema_of_variant(_get(value, path, "variant")).startswith(kind), _get(value, path))


def _filled(value: Column, path: str) -> Column:
    return F.nullif(F.trim(_typed(value, path, "STRING")), F.lit(""))


def relational_messages(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages of the opencode and zcode layouts in order of time, with their parts.

    Unknown part kinds stay as a kind and a time; a message without parts has
    an empty array.
    """
    v = F.col("v")
    piece = parts.select("message_id", F.col("id").alias("part_id"), F.coalesce("time_created", F.lit(0)).alias("at"), F.try_parse_json("data").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    kind = F.coalesce(_typed(v, "$.type", "STRING"), F.lit("unknown"))
    talk, tool, step = kind.isin("text", "reasoning"), kind == "tool", kind.isin("step-start", "step-finish")
    blank = lambda path: F.coalesce(_typed(v, path, "STRING"), F.lit(""))
    part = F.struct(
        "at", "part_id", kind.alias("kind"), F.when(talk, blank("$.text")).alias("text"), F.when(tool, blank("$.tool")).alias("tool"), F.when(tool, blank("$.callID")).alias("call_id"), F.when(tool, blank("$.title")).alias("title"),
        F.when(tool, F.coalesce(_typed(v, "$.state", "OBJECT"), F.lit("{}"))).alias("state"), F.when(step, _get(v, "$.reason")).alias("reason"), F.when(step, _get(v, "$.tokens")).alias("tokens"), F.when(step, _get(v, "$.cost")).alias("cost"))
    packed = piece.groupBy("message_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    rows = messages.select("session_id", "id", F.coalesce("time_created", F.lit(0)).alias("at"), F.try_parse_json("data").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    text = lambda path: _typed(v, path, "STRING")
    amount = _get(v, "$.cost", "double")
    rows = rows.select(
        F.col("session_id").alias("session"), F.row_number().over(Window.partitionBy("session_id").orderBy("at", "id")).cast("long").alias("seq"), F.coalesce(text("$.role"), F.lit("unknown")).alias("role"), text("$.mode").alias("mode"),
        F.col("id").alias("message_id"), "at", text("$.agent").alias("agent"), text("$.modelID").alias("model"), text("$.providerID").alias("provider"), _get(v, "$.time.completed", "bigint").alias("completed"), F.coalesce(_typed(v, "$.tokens", "OBJECT"), F.lit("{}")).alias("usage"),
        F.when(F.isnan(amount) | (F.abs(amount) == float("inf")), 0.0).otherwise(F.coalesce(amount, F.lit(0.0))).alias("cost"))
    empty = F.array().cast(packed.schema["parts"].dataType)
    return rows.join(packed, "message_id", "left").withColumn("parts", F.coalesce("parts", empty))


def _bubble_text(v: Column, mine: Column) -> Column:
    """The first of: an assistant's text, code blocks, an assistant's thinking, other text keys."""
    blocks = F.filter(F.transform(F.coalesce(_get(v, "$.codeBlocks", "array<variant>"), F.array().cast("array<variant>")), lambda x: _filled(x, "$.content")), lambda x: x.isNotNull())
    return F.coalesce(F.when(mine, _filled(v, "$.text")), F.nullif(F.array_join(blocks, "\n\n"), F.lit("")), F.when(mine, _filled(v, "$.thinking.text")), *[_filled(v, f"$.{key}") for key in TEXT_KEYS])


def _bubbles(pairs: DataFrame) -> DataFrame:
    """One row for each bubble with its text, tool and plan fields."""
    composers = pairs.filter(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("session"), F.try_parse_json("value").alias("c"))
    composers = composers.select("session", F.coalesce(_get(F.col("c"), "$.createdAt", "bigint"), iso_ms(_get(F.col("c"), "$.createdAt"))).alias("made"))
    split = F.split("key", ":")
    rows = pairs.filter(F.col("key").startswith("bubbleId:")).select("row", split[1].alias("session"), F.element_at(split, -1).alias("bubble"), F.try_parse_json("value").alias("v")).join(composers, "session", "left")
    v, tool = F.col("v"), "$.toolFormerData"
    intact = F.coalesce(F.schema_of_variant(v).startswith("OBJECT") & (F.to_json(v) != "{}"), F.lit(False))
    mine = ~intact | F.coalesce(_get(v, "$.type", "int") == 2, F.lit(False))
    stamps = [F.nullif(iso_ms(_typed(v, "$.createdAt", "STRING")), F.lit(0)), *[_get(v, f"$.timingInfo.{key}", "bigint") for key in ("clientRpcSendTime", "clientSettleTime", "clientEndTime")]]
    name = F.when(_typed(v, f"{tool}.name", "STRING") != "", _get(v, f"{tool}.name"))
    given = F.coalesce(_get(v, f"{tool}.params"), _get(v, f"{tool}.rawArgs"))
    arguments = F.when(F.try_parse_json(given).isNotNull(), given).otherwise(F.to_json(F.struct(given.alias("_raw"))))
    agent = F.lower(name).contains("agent") | F.lower(name).contains("task")
    result = F.try_parse_json(_get(v, f"{tool}.result"))
    parents = ["$.parentMessageId", "$.parentBubbleId", *[f"{tool}.{x}" for x in ("parentMessageId", "parentBubbleId", "messageId", "additionalData.parentMessageId", "additionalData.parentBubbleId")]]
    planned = name == "create_plan"
    refused = _get(result, "$.rejected")
    rows = rows.select(
        "session", "row", "bubble", intact.alias("intact"), F.when(mine, "assistant").otherwise("user").alias("role"), F.coalesce(F.when(intact, F.coalesce(*stamps)), "made", F.lit(0)).alias("at"), _filled(v, "$.modelInfo.modelName").alias("model"),
        F.when(intact, _bubble_text(v, mine)).otherwise("[corrupted message]").alias("text"), F.when(~planned, name).alias("title"), F.when(~planned, F.when(agent, "subagent").otherwise(name)).alias("tool"), F.when(name.isNotNull() & given.isNotNull(), arguments).alias("arguments"),
        F.coalesce(F.nullif(_get(v, f"{tool}.additionalData.status"), F.lit("")), _get(v, f"{tool}.status")).alias("status"), _get(v, f"{tool}.result").alias("result"), F.coalesce(_filled(v, f"{tool}.toolCallId"), _filled(v, f"{tool}.callId"), F.lit("")).alias("call_id"),
        F.when(agent & ~planned, F.coalesce(_filled(v, f"{tool}.additionalData.subagentComposerId"), _filled(result, "$.agentId"), _filled(result, "$.agent_id"))).alias("child"), F.coalesce(*[_filled(v, x) for x in parents]).alias("parent"),
        F.when(planned, _filled(F.try_parse_json(given), "$.plan")).alias("plan"), F.when(~F.coalesce(refused.isin("{}", "[]", "null"), F.lit(False)), refused).alias("refused"), F.lower(F.trim(_get(v, f"{tool}.additionalData.reviewData.selectedOption"))).isin(*ACCEPTED).alias("accepted"))
    order = Window.partitionBy("session").orderBy("row")
    active = F.last(F.when(F.col("role") == "user", F.col("model")), ignorenulls=True).over(order)
    return rows.withColumn("model", F.when(F.col("intact"), F.coalesce("model", active)))


def keyed_tokens(pairs: DataFrame) -> DataFrame:
    """(session, input_tokens, output_tokens) of the cursor layout, over all bubbles.

    A bubble counts by the first it has of a token count, a usage, and the size
    of its context; numbers that are missing or of another kind count nothing."""
    v = F.col("v")
    rows = pairs.filter(F.col("key").startswith("bubbleId:")).select(F.split("key", ":")[1].alias("session"), F.try_parse_json("value").alias("v"))
    has = lambda path: F.coalesce(F.schema_of_variant(_get(v, path, "variant")).startswith("OBJECT"), F.lit(False))
    number = lambda path: F.coalesce(_get(v, path, "bigint"), F.lit(0))
    given = F.when(has("$.tokenCount"), number("$.tokenCount.inputTokens")).when(has("$.usage"), number("$.usage.input_tokens")).otherwise(number("$.contextWindowStatusAtCreation.tokensUsed"))
    made = F.when(has("$.tokenCount"), number("$.tokenCount.outputTokens")).when(has("$.usage"), number("$.usage.output_tokens")).otherwise(0)
    return rows.groupBy("session").agg(F.sum(given).alias("input_tokens"), F.sum(made).alias("output_tokens"))


def keyed_messages(pairs: DataFrame) -> DataFrame:
    """Messages of the cursor layout in order of time.

    A tool joins the message of an earlier parent bubble, else it is a message
    of role ``tool``.  A subagent's call is followed by one message with the
    texts of that subagent, in order of time; texts of the subagents it called
    stand together at the time of their last one, calls that lead back are left
    out (``subagents.completions``).
    """
    rows = _bubbles(pairs)
    none = F.lit(None).cast("string")
    part = lambda kind, text, rank: F.struct(F.col("row"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), text.alias("text"))
    said = F.when(F.col("text").isNotNull(), part("text", F.col("text"), 0))
    plan = F.when(F.col("plan").isNotNull(), part("plan", F.col("plan"), 1))
    tool = F.when(F.col("tool").isNotNull(), part("tool", none, 2))
    hosts = rows.filter("text is not null").select("session", F.col("bubble").alias("parent"), F.col("row").alias("host"))
    rows = rows.join(hosts, ["session", "parent"], "left").withColumn("host", F.when((F.col("host") <= F.col("row")) & F.col("tool").isNotNull(), F.col("host")))
    own = rows.withColumn("p", F.explode(F.filter(F.array(said, plan, tool), lambda x: x.isNotNull())))
    lone = (F.col("p.kind") == "tool") & F.col("host").isNull()
    own = own.withColumns({"home": F.when((F.col("p.kind") == "tool") & ~lone, F.col("host")).otherwise(F.col("row")), "place": F.when(lone, 1).otherwise(0)})
    is_tool, is_plan = F.col("p.kind") == "tool", F.col("p.kind") == "plan"
    asks = F.try_parse_json("arguments")
    asked = F.coalesce(_filled(asks, "$.prompt"), _filled(asks, "$.description"), "arguments")
    detail = F.struct(
        "p.row", "p.rank", "p.kind", "p.text", F.when(is_tool, F.col("tool")).alias("tool"), F.when(is_tool, F.col("call_id")).alias("call_id"), F.when(is_tool, F.col("title")).alias("title"), F.when(is_tool, F.col("arguments")).alias("arguments"),
        F.when(is_tool & F.col("child").isNull(), F.col("result")).when(is_plan, F.col("refused")).alias("output"), F.when(is_tool, F.col("status")).when(is_plan, F.when(F.col("accepted"), "success").otherwise("fail")).alias("status"), F.when(is_tool, F.col("child")).alias("subagent"), F.when(is_tool & (F.col("tool") == "subagent"), asked).alias("prompt"), "at")
    first = lambda c: F.min_by(c, F.struct("p.row", "p.rank"))
    packed = own.groupBy("session", "home", "place").agg(
        first(F.when(F.col("place") == 1, "tool").when(is_plan, "assistant").otherwise(F.col("role"))).alias("role"), F.when(F.max("place") == 1, "tool").alias("mode"), first(F.when(F.col("place") == 1, F.concat("bubble", F.lit(":tool"))).otherwise(F.col("bubble"))).alias("message_id"),
        first(F.col("at")).alias("at"), first(F.col("model")).alias("model"), F.array_sort(F.collect_list(detail)).alias("parts"))
    packed = packed.unionByName(_completions(pairs, rows, packed), allowMissingColumns=True)
    order = Window.partitionBy("session").orderBy("at", "home", "place", "message_id")
    return packed.withColumn("seq", F.row_number().over(order).cast("long")).drop("home", "place")


def _completions(pairs: DataFrame, rows: DataFrame, packed: DataFrame) -> DataFrame:
    """One message for each subagent call that is answered: what the assistant said below it."""
    c = F.col("c")
    composers = pairs.filter(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("session"), F.try_parse_json("value").alias("c"))
    composers = composers.filter(F.schema_of_variant(c).startswith("OBJECT") & (F.to_json(c) != "{}")).select("session", _filled(c, "$.modelConfig.modelName").alias("own"), _filled(c, "$.subagentInfo.subagentTypeName").alias("kind"))
    own = F.when(F.col("role") == "assistant", F.filter("parts", lambda p: (p["kind"] == "text") & ~p["text"].isin(*NO_TEXT)))
    messages = packed.select("session", "at", "home", "place", "model", F.coalesce(own, F.slice("parts", 1, 0)).alias("said"))
    told = completions(messages, rows.filter("child is not null").select("session", "row", "child"), composers)
    return told.select("session", F.col("row").alias("home"), F.lit(2).alias("place"), F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("mode"), F.concat("child", F.lit(":subagent-output")).alias("message_id"), "at", "model", F.col("said").alias("parts"), F.col("child").alias("subagent_id"), F.col("kind").alias("subagent_type"))
