"""Session heads of the JSON-lines layouts: one row of ``HEAD`` a file.

A head is one aggregation over a file's records: all of them
(``jsonl.records``), or those at the ends of files (``jsonl.ends``, with
``bounded``), when the number of messages of a file above 256 KiB is unknown.
Without a readable first timestamp a session was created when its file was last
modified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import basename, title
from tidemark.operators.filters import PROVIDERS
from tidemark.sources.jsonl import TAIL, WHOLE_BYTES, files

HEAD = "provider string, session_id string, title string, created_at timestamp, updated_at timestamp, source_path string, working_directory string, model string, model_provider string, version string, message_count long, uri string"
# fixed values: first records that may give a title
CLAUDE_HEAD, CODEX_HEAD = 20, 10
SCHEMES = {"claudecode": "claude"}


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _filled(value: Column, path: str) -> Column:
    return F.nullif(F.trim(_get(value, path)), F.lit(""))


def _all_texts(content: Column, path: str) -> Column:
    """Texts of a list's strings and objects, joined by spaces; a string itself."""
    listed = F.transform(_get(content, path, "array<variant>"), lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", _get(x, "$")), _get(x, "$.text"), F.lit("")))
    return F.coalesce(F.array_join(listed, " "), _get(content, path))


def _records(records: DataFrame) -> DataFrame:
    rows = records.filter("record is not null").select("path", "line", F.try_parse_json("record").alias("v"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return rows.withColumn("n", F.when(F.col("line") == TAIL, F.col("line")).otherwise(place))


def _head(provider: str, rows: DataFrame, of: DataFrame, session_id: Column, message_title: Column, titles: DataFrame | None, bounded: bool) -> DataFrame:
    rows = rows.join(of, "path").withColumn("session_id", session_id)
    if titles is not None:
        rows = rows.join(titles.select("session_id", F.col("title").alias("given")), "session_id", "left")
    else:
        rows = rows.withColumn("given", F.lit(None).cast("string"))
    folder = F.element_at(F.split("path", "/"), -2)
    created = F.coalesce("first_at", "modified")
    return rows.select(
        F.lit(provider).alias("provider"), "session_id", title(F.col("given"), message_title, F.coalesce(basename(F.col("cwd")), folder)).alias("title"), created.alias("created_at"), F.coalesce("last_at", created).alias("updated_at"), F.col("path").alias("source_path"),
        F.nullif(F.trim("cwd"), F.lit("")).alias("working_directory"), "model", "model_provider", "version", F.when((F.col("size") <= WHOLE_BYTES) | F.lit(not bounded), F.col("messages")).alias("message_count"), F.concat(F.lit(SCHEMES.get(provider, provider) + "://"), "session_id").alias("uri"))


def claude_sessions(records: DataFrame, of: DataFrame, titles: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """Heads of the claudecode layout; ``titles`` (session_id, title) come from the side index."""
    v = F.col("v")
    at = F.try_to_timestamp(_get(v, "$.timestamp"))
    said = F.nullif(_all_texts(v, "$.message.content"), F.lit(""))
    asks = (_get(v, "$.message.role") == "user") & said.isNotNull() & (F.col("n") <= CLAUDE_HEAD)
    rows = _records(records).groupBy("path").agg(
        F.min_by(at, "n").alias("first_at"), F.max_by(at, F.when(at.isNotNull(), F.col("n"))).alias("last_at"), F.min_by(_get(v, "$.cwd"), "n").alias("cwd"), F.min_by(_get(v, "$.version"), "n").alias("version"),
        F.min_by(_filled(v, "$.message.model"), F.when(_filled(v, "$.message.model").isNotNull(), F.col("n"))).alias("model"), F.lit(None).cast("string").alias("model_provider"),
        F.count_if(_filled(v, "$.message.role").isNotNull()).alias("messages"), F.min_by(said, F.when(asks, F.col("n"))).alias("asked"))
    return _head("claudecode", rows, of, F.regexp_extract("path", r"([^/]+)\.jsonl$", 1), F.col("asked"), titles, bounded)


def codex_sessions(records: DataFrame, of: DataFrame, titles: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """Heads of the codex layout: the title is the second or a later user message of the first records."""
    from pyspark.sql import Window

    v = F.col("v")
    p = lambda path: _get(v, f"$.payload.{path}")
    at = F.try_to_timestamp(_get(v, "$.timestamp"))
    user = F.coalesce((p("type") == "message") & (p("role") == "user"), F.lit(False))
    nth = F.sum(user.cast("int")).over(Window.partitionBy("path").orderBy("n"))
    texts = F.when(_get(v, "$.payload.content", "array<variant>").isNotNull(), F.nullif(F.trim(_all_texts(v, "$.payload.content")), F.lit("")))
    model = F.coalesce(_filled(v, "$.payload.model"), _filled(v, "$.payload.arguments.model"))
    rows = _records(records).withColumn("nth", nth)
    rows = rows.groupBy("path").agg(
        F.min_by(F.try_to_timestamp(p("timestamp")), "n").alias("first_at"), F.max_by(at, F.when(at.isNotNull(), F.col("n"))).alias("last_at"), F.min_by(p("id"), "n").alias("id"), F.min_by(p("cwd"), "n").alias("cwd"), F.min_by(p("cli_version"), "n").alias("version"),
        F.min_by(p("model_provider"), "n").alias("model_provider"), F.min_by(model, F.when(model.isNotNull(), F.col("n"))).alias("model"), F.count_if(p("type").isin("message", "function_call", "function_call_output")).alias("messages"),
        F.min_by(texts, F.when(user & (F.col("nth") >= 2) & texts.isNotNull() & (F.col("n") <= CODEX_HEAD), F.col("n"))).alias("asked"))
    rows = rows.withColumn("model", F.coalesce("model", "model_provider"))
    stem = F.split(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1), "-")
    from_name = F.array_join(F.slice(stem, F.greatest(F.size(stem) - 4, F.lit(1)), F.lit(5)), "-")
    return _head("codex", rows, of, F.coalesce(F.nullif("id", F.lit("")), from_name), F.col("asked"), titles, bounded)


def index_titles(spark: SparkSession, root: str, name: str = "sessions-index.json") -> DataFrame:
    """(session_id, title) of side indexes ``{"entries": [{sessionId, summary, ...}]}`` below ``root``; bad files give none."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    rows = whole.select(F.explode(_get(F.try_parse_json("value"), "$.entries", "array<variant>")).alias("x"))
    named = rows.select(_filled(F.col("x"), "$.sessionId").alias("session_id"), _filled(F.col("x"), "$.summary").alias("title"), _get(F.col("x"), "$.modified").alias("at"))
    return named.filter("session_id is not null and title is not null").groupBy("session_id").agg(F.max_by("title", F.struct(F.coalesce("at", F.lit("")), "title")).alias("title"))


def side_titles(records: DataFrame) -> DataFrame:
    """(session_id, title) of a side index of ``{id, thread_name}`` lines: the last one of an id."""
    name = F.nullif(F.trim(F.get_json_object("record", "$.thread_name")), F.lit(""))
    rows = records.select(F.get_json_object("record", "$.id").alias("session_id"), "line", name.alias("title")).filter("session_id is not null and title is not null")
    return rows.groupBy("session_id").agg(F.max_by("title", "line").alias("title"))


def token_totals(records: DataFrame, provider: str) -> DataFrame:
    """(path, input_tokens, output_tokens, total_tokens) as a layout's records give them.

    codex adds every running total as it stands; kimi adds the usage of wire
    messages and takes the last ``_usage`` count as the total.
    """
    if provider not in ("codex", "kimi"):
        raise ValueError(f"no token records in layout: {provider}")
    v = F.col("v")
    base = "$.payload.info.total_token_usage" if provider == "codex" else "$.message.usage"
    total = F.when(_get(v, "$.role") == "_usage", _get(v, "$.token_count", "bigint"))
    rows = records.filter("record is not null").select("path", "line", F.try_parse_json("record").alias("v"))
    add = lambda name: F.coalesce(F.sum(_get(v, f"{base}.{name}", "bigint")), F.lit(0)).alias(name)
    return rows.groupBy("path").agg(add("input_tokens"), add("output_tokens"), F.max_by(total, F.when(total.isNotNull(), F.col("line"))).alias("total_tokens"))


def assembled_tokens(messages: DataFrame) -> DataFrame:
    """(session, input_tokens, output_tokens): usage once for each assembled message."""
    usage = F.try_parse_json("usage")
    add = lambda name: F.coalesce(F.sum(_get(usage, f"$.{name}", "bigint")), F.lit(0)).alias(name)
    return messages.groupBy("session").agg(add("input_tokens"), add("output_tokens"))


def union(heads: dict[str, DataFrame]) -> DataFrame:
    """Heads of several providers with their place in registration order, ``provider_order``."""
    out = None
    for name in (x for x in PROVIDERS if x in heads):
        rows = heads[name].withColumn("provider_order", F.lit(PROVIDERS.index(name)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no known provider")
    return out


def _epoch_ms(value: Column) -> Column:
    return F.when(value.between(0, 32_503_680_000_000), F.timestamp_millis(value))


def relational_sessions(sessions: DataFrame, messages: DataFrame, provider: str = "opencode") -> DataFrame:
    """Heads of the opencode and zcode layouts: messages counted, the model of the latest message that names one."""
    v = F.try_parse_json("data")
    named = F.col("data").contains('"modelID"')
    facts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max_by(_filled(v, "$.modelID"), F.when(named, F.col("time_created"))).alias("model"))
    rows = sessions.join(facts, "id", "left")
    return rows.select(
        F.lit(provider).alias("provider"), F.col("id").alias("session_id"), title(F.col("title"), basename(F.col("directory"))).alias("title"), _epoch_ms(F.col("time_created")).alias("created_at"), _epoch_ms(F.col("time_updated")).alias("updated_at"), F.lit(None).cast("string").alias("source_path"),
        F.nullif(F.trim("directory"), F.lit("")).alias("working_directory"), "model", F.lit(None).cast("string").alias("model_provider"), "version", F.coalesce("n", F.lit(0)).alias("message_count"), F.concat(F.lit(f"{provider}://"), "id").alias("uri"))


def keyed_sessions(pairs: DataFrame, prefix: int = 20) -> DataFrame:
    """Heads of the cursor layout: the first request id and model of a composer's first bubbles by key; user and assistant bubbles counted."""
    from pyspark.sql import Window

    v = F.try_parse_json("value")
    bubbles = pairs.filter(F.col("key").startswith("bubbleId:")).select(F.split("key", ":")[1].alias("id"), "key", v.alias("v"))
    bubbles = bubbles.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("key")))
    early = lambda value: F.min_by(value, F.when(value.isNotNull() & (F.col("n") <= prefix), F.col("n")))
    facts = bubbles.groupBy("id").agg(F.count_if(_get(F.col("v"), "$.type", "int").isin(1, 2)).alias("messages"), early(_filled(F.col("v"), "$.requestId")).alias("request"), early(_filled(F.col("v"), "$.modelInfo.modelName")).alias("spoken"))
    c = F.col("c")
    rows = pairs.filter(F.col("key").startswith("composerData:")).select(F.substring("key", len("composerData:") + 1, 10_000).alias("id"), v.alias("c")).filter(F.schema_of_variant("c").startswith("OBJECT")).join(facts, "id", "left")
    stamp = lambda name: F.coalesce(_epoch_ms(_get(c, f"$.{name}", "bigint")), F.try_to_timestamp(_get(c, f"$.{name}")))
    request = F.coalesce("request", "id")
    return rows.select(
        F.lit("cursor").alias("provider"), request.alias("session_id"), F.coalesce(_filled(c, "$.name"), _filled(c, "$.title"), F.concat(F.lit("Cursor Session "), F.substring("id", 1, 8))).alias("title"), stamp("createdAt").alias("created_at"), F.coalesce(stamp("updatedAt"), stamp("lastUpdatedAt"), stamp("createdAt")).alias("updated_at"),
        F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("working_directory"), F.coalesce(_filled(c, "$.modelConfig.modelName"), F.col("spoken")).alias("model"), F.lit(None).cast("string").alias("model_provider"), F.lit(None).cast("string").alias("version"),
        F.coalesce("messages", F.lit(0)).alias("message_count"), F.concat(F.lit("cursor://"), request).alias("uri"))


def kimi_sessions(spark: SparkSession, root: str, settings: str | None = None, since: Column | None = None, count=None) -> DataFrame:
    """Heads of the kimi layout, a folder a session: ``settings`` is the file that lists the working folders.

    A folder needs a context or a wire file.  Messages are those assembled
    from a context file; without one they are unknown.  With ``since`` folders
    whose header gives an earlier time are left out and their files not opened;
    ``count`` is an accumulator of the bytes read from context files.
    """
    from tidemark.sources import jsonl, transcripts

    whole = lambda path, name: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
    folder = lambda path: F.regexp_extract(path, r"^(?:file:)?/*(.*)/[^/]+$", 1)
    v = F.col("v")
    every = files(spark, root, "*").select("path", "modified", "size", folder(F.col("path")).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
    meta = jsonl.texts_of(every.filter("name = 'metadata.json'").select("path", "folder", "modified")).select("folder", "modified", F.try_parse_json("value").alias("v"))
    made = F.coalesce(_epoch_ms((_get(v, "$.wire_mtime", "double") * 1000).cast("bigint")), "modified")
    if since is not None:
        meta = meta.filter(made >= since)
    listed = every.filter(F.col("name").isin("context.jsonl", "wire.jsonl"))
    held = listed.groupBy("folder").agg(F.max(F.when(F.col("name") == "context.jsonl", F.col("size"))).alias("size"))
    context = listed.filter("name = 'context.jsonl'")
    if since is not None:
        context = context.join(meta.select("folder"), "folder", "left_semi")
    records = jsonl.records_in(context.select("path", "size"), count)
    counted = transcripts.kimi_messages(records).groupBy(folder(F.col("session")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    rows = meta.join(held, "folder").join(counted, "folder", "left").withColumn("hash", F.element_at(F.split("folder", "/"), -2))
    if settings:
        dirs = whole(settings, "*").select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.work_dirs", "array<variant>")).alias("x")).select(_get(F.col("x"), "$.path").alias("cwd")).filter("cwd is not null").distinct()
        rows = rows.join(dirs.withColumn("hash", F.md5(F.encode("cwd", "utf-8"))), "hash", "left")
    else:
        rows = rows.withColumn("cwd", F.lit(None).cast("string"))
    name = F.coalesce(_filled(v, "$.session_id"), F.element_at(F.split("folder", "/"), -1))
    null = F.lit(None).cast("string")
    return rows.select(
        F.lit("kimi").alias("provider"), name.alias("session_id"), title(_get(v, "$.title"), basename(F.col("cwd"))).alias("title"), made.alias("created_at"), made.alias("updated_at"), F.concat(F.lit("/"), "folder").alias("source_path"), F.nullif(F.trim("cwd"), F.lit("")).alias("working_directory"),
        null.alias("model"), null.alias("model_provider"), null.alias("version"), F.when(F.col("size").isNotNull(), F.coalesce("n", F.lit(0))).alias("message_count"), F.concat(F.lit("kimi://"), name).alias("uri"))


def look_up(spark: SparkSession, root: str, provider: str, session_id: str, titles: DataFrame | None = None, count=None) -> DataFrame:
    """The head of one session of the codex, claudecode or pi layout.

    Files whose name holds the id are the only ones read; where none of them is
    the session's, all are.  ``count`` is an accumulator of the bytes read."""
    from tidemark.sources import jsonl

    def heads(held: DataFrame) -> DataFrame:
        records = jsonl.records_in(held.select("path", "size"), count)
        if provider == "pi":
            rows = jsonl.pi_sessions(records)
        else:
            rows = {"codex": codex_sessions, "claudecode": claude_sessions}[provider](records, held, titles)
        return rows.filter(F.col("session_id") == session_id)

    listed = jsonl.files(spark, root)
    near = heads(listed.filter(F.element_at(F.split("path", "/"), -1).contains(session_id)))
    # one row at most decides which branch is the answer
    return near if near.head(1) else heads(listed)
