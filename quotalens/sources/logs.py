"""Usage logs of coding agents as typed usage events.

Every function takes lines or documents with their source path and gives EVENT columns. Keys have several spellings;
the first present one counts. Nothing reads the clock: a record without a time has a null one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = ["source", "provider", "session_id", "request_id", "model", "reasoning_effort", "mode", "speed_mode", "us", "input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "cache_creation_1h_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens", "cost_usd", "source_path"]


def text(json: str, *paths: str) -> Column:
    """The first non-blank value among ``paths``."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, f"$.{p}")), F.lit("")) for p in paths])


def number(json: str, *paths: str) -> Column:
    """The first value among ``paths`` that is a number, as a whole one; 0 if none is."""
    return F.coalesce(*[F.get_json_object(json, f"$.{p}").try_cast("double").cast("bigint") for p in paths], F.lit(0).cast("bigint"))


def moment(json: str, *paths: str) -> Column:
    """Epoch microseconds of an ISO time, or of epoch seconds or milliseconds."""
    return _moment(text(json, *paths))


def _moment(raw: Column) -> Column:
    n = raw.try_cast("double")
    return F.coalesce(F.unix_micros(F.try_to_timestamp(raw)), F.when(n > 1e11, n * 1000).otherwise(n * 1_000_000).cast("bigint"))


def _stem(path: str, suffix: str = r"\.[^.]*") -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), suffix + "$", "")


def _events(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"us": "bigint", "cost_usd": "double"} | {c: "bigint" for c in EVENT if c.endswith("tokens")}
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in EVENT])


def claude_lines(lines: DataFrame, value: str = "value", path: str = "source_path") -> DataFrame:
    """Transcript lines with a usage object (of the message, else of the line) or a cost; other lines give nothing."""
    usage = F.coalesce(F.get_json_object(value, "$.message.usage"), F.get_json_object(value, "$.usage"))
    df = lines.withColumn("_u", usage).withColumn("_cost", F.coalesce(F.get_json_object(value, "$.costUSD").try_cast("double"), F.get_json_object(value, "$.cost_usd").try_cast("double")))
    df = df.where((F.col("_u").isNotNull() & (F.col("_u") != "{}")) | (F.col("_cost") > 0))
    counts = {
        "input_tokens": number("_u", "input_tokens", "input"), "cached_input_tokens": number("_u", "cache_read_input_tokens", "cached_input_tokens", "cached"),
        "cache_creation_input_tokens": number("_u", "cache_creation_input_tokens", "cache_creation_tokens"), "output_tokens": number("_u", "output_tokens", "output"),
        "reasoning_output_tokens": number("_u", "reasoning_output_tokens", "reasoning_tokens", "thinking_tokens"),
    }
    total, own = number("_u", "total_tokens", "total"), sum(counts.values(), F.lit(0))
    counts["cache_creation_1h_input_tokens"] = number("_u", "cache_creation.ephemeral_1h_input_tokens")  # a part of cache creation
    speed, tier = F.lower(text("_u", "speed")), F.lower(text("_u", "service_tier"))
    mode = F.when(speed.isin("fast", "priority"), "fast").when(speed == "standard", "standard").when(tier == "priority", "fast").when(tier == "standard", "standard")
    return _events(
        df, source=F.lit("claude"), provider=F.lit("anthropic"), session_id=F.coalesce(text(value, "sessionId", "session_id"), _stem(path)),
        request_id=text(value, "requestId", "request_id", "message.id"), model=text(value, "message.model", "message.model_name", "model", "model_name"),
        reasoning_effort=text(value, "effort", "reasoning_effort", "message.effort", "message.reasoning_effort"), speed_mode=mode, us=moment(value, "timestamp", "ts"),
        total_tokens=F.when(total > 0, total).otherwise(own), cost_usd=F.when(F.col("_cost") > 0, F.col("_cost")), source_path=F.col(path), **counts,
    )


def codex_lines(lines: DataFrame, value: str = "value", path: str = "source_path", place: str = "line_no") -> DataFrame:
    """Rollout lines; model, effort, mode and speed carry on from earlier lines of the file, and a repeated usage counts once.

    A window over the file's lines carries the last known settings forward; a usage that its file has shown before, with
    the same settings, is dropped by its place among its likes.
    """
    kind, inner = text(value, "type"), text(value, "payload.type")
    turn, settings, count = kind == "turn_context", (kind == "event_msg") & (inner == "thread_settings_applied"), (kind == "event_msg") & (inner == "token_count")
    usage = F.coalesce(
        F.when(count, F.coalesce(F.get_json_object(value, "$.payload.info.last_token_usage"), F.get_json_object(value, "$.payload.info.total_token_usage"))),
        *[F.get_json_object(value, f"$.{p}usage") for p in ("", "data.", "result.", "response.")],
    )
    nested = text(value, "data.model", "result.model", "response.model")
    model = F.when(turn, text(value, "payload.model", "payload.model_name")).otherwise(F.coalesce(text(value, "model", "model_name"), nested))
    fast = F.when(turn, F.lower(text(value, "payload.fast_mode", "payload.fastMode", "payload.use_fast_model"))).when(
        settings, F.when(text(value, "payload.thread_settings.service_tier").isin("fast", "priority"), "true").when(text(value, "payload.thread_settings.service_tier") == "default", "false").otherwise("unknown")
    )
    w = Window.partitionBy(path).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    carried = {
        "_model": F.last(model, ignorenulls=True).over(w), "_effort": F.last(F.when(turn, text(value, "payload.effort", "payload.reasoning_effort", "payload.model_reasoning_effort")), ignorenulls=True).over(w),
        "_mode": F.last(F.when(turn, text(value, "payload.mode", "payload.collaboration_mode.mode")), ignorenulls=True).over(w), "_fast": F.last(fast, ignorenulls=True).over(w),
    }
    df = lines.withColumns(carried).withColumn("_u", F.when(~turn & ~settings, usage)).where(F.col("_u").isNotNull() & (F.col("_u") != "{}") & F.col("_model").isNotNull())
    again = F.row_number().over(Window.partitionBy(path, "_model", "_effort", "_mode", "_u").orderBy(place))
    df = df.withColumn("_again", again).where("_again = 1")
    raw, cached = number("_u", "input_tokens", "input"), number("_u", "cached_input_tokens", "cache_read_input_tokens", "cached")
    made, out = number("_u", "cache_write_input_tokens", "cache_creation_input_tokens", "cache_creation_tokens"), number("_u", "output_tokens", "output")
    total = number("_u", "total_tokens", "total")
    return _events(
        df, source=F.lit("codex"), provider=F.lit("openai"), session_id=_stem(path), request_id=text(value, "request_id", "id"), model=F.col("_model"), reasoning_effort=F.col("_effort"), mode=F.col("_mode"),
        speed_mode=F.when(F.col("_fast") == "true", "fast").when(F.col("_fast") == "false", "standard"), us=moment(value, "timestamp", "ts"), input_tokens=F.greatest(raw - cached - made, F.lit(0)), cached_input_tokens=cached,
        cache_creation_input_tokens=made, output_tokens=out, reasoning_output_tokens=number("_u", "reasoning_output_tokens", "reasoning_tokens"), total_tokens=F.when(total > 0, total).otherwise(raw + out), source_path=F.col(path),
    )


def gemini_documents(docs: DataFrame, value: str = "value", path: str = "source_path") -> DataFrame:
    """One JSON document (or line) a row; those without a model or tokens give nothing."""
    df = docs.withColumn("_u", F.coalesce(F.get_json_object(value, "$.tokens"), F.get_json_object(value, "$.usage"), F.get_json_object(value, "$.usageMetadata")))
    raw, cached = number("_u", "input", "input_tokens", "prompt", "prompt_tokens"), number("_u", "cached", "cached_tokens", "cached_input_tokens")
    made, out = number("_u", "cache_creation", "cache_creation_tokens", "cache_creation_input_tokens"), number("_u", "output", "output_tokens", "candidates", "candidates_tokens")
    thought, total = number("_u", "thoughts", "thoughts_tokens", "reasoning", "reasoning_tokens", "reasoning_output_tokens"), number("_u", "total", "total_tokens")
    found = _events(
        df, source=F.lit("gemini"), provider=F.lit("gemini"), session_id=F.coalesce(text(value, "sessionId", "session_id"), _stem(path)), request_id=text(value, "id", "request_id"), model=text(value, "model", "model_name"),
        us=moment(value, "timestamp", "ts"), input_tokens=F.greatest(raw - cached, F.lit(0)), cached_input_tokens=cached, cache_creation_input_tokens=made, output_tokens=out, reasoning_output_tokens=thought,
        total_tokens=F.when(total > 0, total).otherwise(raw + made + out + thought), source_path=F.col(path),
    )
    return found.where(F.col("model").isNotNull() & (F.col("total_tokens") > 0))


def antigravity_settings(docs: DataFrame, value: str = "value", path: str = "source_path") -> DataFrame:
    """Cumulative counters of a settings document; changes of them are ``boundaries.cumulative_delta``'s work."""
    df = docs.withColumn("_u", F.get_json_object(value, "$.tokenUsage")).where(F.col("_u").isNotNull() & (F.col("_u") != "{}"))
    # each in a column of its own, as what is used twice in one projection is looked up twice
    df = df.withColumns({
        "_raw": number("_u", "inputTokens", "input_tokens", "input"), "_cached": number("_u", "cacheReadTokens", "cache_read_input_tokens", "cached_input_tokens", "cached"),
        "_made": number("_u", "cacheCreationTokens", "cache_creation_input_tokens", "cache_creation_tokens"), "_out": number("_u", "outputTokens", "output_tokens", "output"),
        "_thought": number("_u", "thinkingTokens", "reasoning_output_tokens", "reasoning_tokens", "thoughts"), "_total": number("_u", "totalTokens", "total_tokens", "total"),
        "_lock": F.lower(text(value, "providerLock")), "_at": text(value, "providerLockTimestamp", "timestamp", "ts"),
    })
    raw, cached, made, out, thought, total, lock = (F.col(c) for c in ("_raw", "_cached", "_made", "_out", "_thought", "_total", "_lock"))
    return _events(
        df, source=F.lit("antigravity"), provider=F.when(lock.contains("claude") | lock.contains("anthropic"), "anthropic").when(lock.contains("gpt") | lock.contains("openai"), "openai").otherwise("google"),
        session_id=_stem(path, r"\.settings\.json"), model=F.lower(text(value, "model")), us=_moment(F.col("_at")), input_tokens=F.greatest(raw - cached, F.lit(0)), cached_input_tokens=cached,
        cache_creation_input_tokens=made, output_tokens=out, reasoning_output_tokens=thought, total_tokens=F.when(total > 0, total).otherwise(raw + cached + made + out + thought), source_path=F.col(path),
    )


def cursor_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV exports; headers are matched by their letters and digits alone, in lower case."""
    df = spark.read.option("header", True).csv(path).withColumn("_path", F.col("_metadata.file_path"))
    names = {"".join(c for c in n.lower() if c.isalnum()): n for n in df.columns if n != "_path"}

    def of(*keys: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{names[k]}`")), F.lit("")) for k in keys if k in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def whole(*keys: str) -> Column:
        return F.coalesce(F.regexp_replace(of(*keys), ",", "").try_cast("bigint"), F.lit(0).cast("bigint"))

    raw, cached, out, thought, total = whole("inputtokens", "input"), whole("cachedinputtokens", "cachedtokens", "cached"), whole("outputtokens", "output"), whole("reasoningoutputtokens", "reasoningtokens"), whole("totaltokens", "total")
    found = _events(
        df, source=F.lit("cursor"), provider=F.lit("cursor"), model=of("model", "modelname"), us=F.unix_micros(F.try_to_timestamp(of("date", "timestamp", "time"))), input_tokens=F.greatest(raw - cached, F.lit(0)), cached_input_tokens=cached,
        output_tokens=out, reasoning_output_tokens=thought, total_tokens=F.when(total > 0, total).otherwise(raw + out + thought), cost_usd=F.regexp_replace(of("usagebasedprice", "cost", "costusd", "price"), r"[$,]", "").try_cast("double"), source_path=F.col("_path"),
    )
    return found.where(F.col("model").isNotNull() & (F.col("total_tokens") > 0))


def cursor_state(pairs: DataFrame, path: str = "state") -> DataFrame:
    """Exported (key, value) pairs: bubbles with tokens, their model from the bubble, else from its composer."""
    composers = pairs.where(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("session_id"), text("value", "modelConfig.modelName", "modelConfig.model", "modelConfig.name").alias("_composer"))
    b = pairs.where(F.col("key").startswith("bubbleId:") & F.col("value").isNotNull()).withColumn("session_id", F.split("key", ":")[1]).join(composers, "session_id", "left")
    b = b.withColumn("_u", F.get_json_object("value", "$.tokenCount"))
    inputs, out = number("_u", "inputTokens", "input_tokens"), number("_u", "outputTokens", "output_tokens")
    found = _events(
        b, source=F.lit("cursor"), provider=F.lit("cursor"), session_id=F.col("session_id"), request_id=text("value", "requestId", "request_id", "bubbleId"), us=moment("value", "createdAt", "timestamp"),
        model=F.lower(F.coalesce(text("value", "modelInfo.modelName", "modelInfo.model", "modelInfo.name"), F.col("_composer"), F.lit("cursor-unknown"))), input_tokens=inputs, cached_input_tokens=F.lit(0), cache_creation_input_tokens=F.lit(0),
        output_tokens=out, reasoning_output_tokens=F.lit(0), total_tokens=inputs + out, source_path=F.lit(path),
    )
    return found.where("total_tokens > 0")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their path and their order in it (the order of a file's own lines, not their number).

    A file may be read in several splits, which Spark packs into tasks by size, not by place. So ``line_no`` (a struct) orders
    first by the split's place in the file, then by the order in which a task reads lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    return lines.select("value", "source_path", F.struct("_block", "_at").alias("line_no"))


def write_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines, one folder a UTC day."""
    events.withColumn("day", F.to_date(F.timestamp_micros("us"))).write.mode("append").partitionBy("day").json(path)
