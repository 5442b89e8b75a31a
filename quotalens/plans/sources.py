"""Log and payload decoders over documents written from the test tables; the SQL tells from the tables what they must find."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotalens.operators import analytics as an
from quotalens.sources import logs, payloads
from quotalens.sources.projection import SAMPLES, USAGE, quota_samples, usage_events

from .insights import DAY, NOW_US

_TS = "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ')"
_SEC = "us // 1000000 * 1000000"


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _str(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _iso(c="us"):
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _events(s, d):
    return usage_events(s, d).withColumns({"n": F.col("event_id"), "ts": _iso(), "model": F.trim("model")})


def _claude(s, d):
    """Transcript lines: some without usage, some with their usage outside the message, some with a cost alone."""
    e, n = _events(s, d), F.col("n")
    usage = _text('{"input_tokens":', _str("input_tokens"), ',"cache_read_input_tokens":', _str("cached_input_tokens"), ',"cache_creation_input_tokens":', _str("cache_creation_input_tokens"), ',"cache_creation":{"ephemeral_1h_input_tokens":', _str("cache_creation_1h_input_tokens"), '},"output_tokens":', _str("output_tokens"), ',"service_tier":"', F.when(n % 2 == 0, "priority").otherwise("standard"), '"}')
    line = (
        F.when(n % 7 == 0, _text('{"type":"user","timestamp":"', F.col("ts"), '"}')).when(n % 7 == 1, "not json")
        .when(n % 7 == 2, _text('{"timestamp":"', F.col("ts"), '","model":"', F.col("model"), '","usage":', usage, "}")).when(n % 7 == 3, _text('{"timestamp":"', F.col("ts"), '","model":"', F.col("model"), '","costUSD":0.25}'))
        .otherwise(_text('{"timestamp":"', F.col("ts"), '","sessionId":"', F.col("session_id"), '","requestId":"r', _str("n"), '","message":{"model":"', F.col("model"), '","usage":', usage, "}}"))
    )
    lines = e.select(line.alias("value"), _text("/logs/", F.col("source_path"), ".jsonl").alias("source_path"))
    return logs.claude_lines(lines).select("session_id", "request_id", "model", "speed_mode", "us", "input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "cache_creation_1h_input_tokens", "output_tokens", "total_tokens", "cost_usd")


_COUNTS = ("input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "cache_creation_1h_input_tokens", "output_tokens")


def _codex(s, d):
    """Rollout files: every fifth line sets the model and effort, the others tell usage; a file's first lines have no model."""
    e, n = _events(s, d), F.col("n")
    turn = _text('{"type":"turn_context","payload":{"model":"', F.col("model"), '","effort":"', F.col("reasoning_effort"), '"}}')
    count = _text('{"type":"event_msg","timestamp":"', F.col("ts"), '","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":', _str("input_tokens"), ',"cached_input_tokens":', _str("cached_input_tokens"), ',"output_tokens":', _str("output_tokens"), ',"id":', _str(n % 400), "}}}}")
    lines = e.select(F.when(n % 5 == 0, turn).otherwise(count).alias("value"), _text("/r/", F.col("source_path"), ".jsonl").alias("source_path"), n.alias("line_no"))
    return logs.codex_lines(lines).select("session_id", "model", "reasoning_effort", "us", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")


def _gemini(s, d):
    e, n = _events(s, d), F.col("n")
    line = _text('{"timestamp":"', F.col("ts"), '","id":"g', _str("n"), '",', F.when(n % 4 == 0, F.lit("")).otherwise(_text('"model":"', F.col("model"), '",')), '"tokens":{"input":', _str("input_tokens"), ',"cached":', _str("cached_input_tokens"), ',"output":', _str("output_tokens"), ',"thoughts":', _str("reasoning_output_tokens"), "}}")
    return logs.gemini_documents(e.select(line.alias("value"), F.col("source_path"))).select("request_id", "model", "us", "input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def _antigravity(s, d):
    e, n = _events(s, d), F.col("n")
    lock = F.when(n % 3 == 0, "claude-x").when(n % 3 == 1, "OpenAI").otherwise("")
    line = _text('{"model":"', F.upper("model"), '","providerLock":"', lock, '","timestamp":"', F.col("ts"), '","tokenUsage":', F.when(n % 6 == 5, "{}").otherwise(_text('{"inputTokens":', _str("input_tokens"), ',"cacheReadTokens":', _str("cached_input_tokens"), ',"outputTokens":', _str("output_tokens"), "}")), "}")
    return logs.antigravity_settings(e.select(line.alias("value"), _text("/x/", F.col("source_path"), "-", _str("n"), ".settings.json").alias("source_path"))).select("session_id", "provider", "model", "us", "input_tokens", "output_tokens", "total_tokens")


def _cursor(s, d):
    e, n = _events(s, d), F.col("n")
    composer = _text("c", _str(n % 40))
    bubbles = e.select(_text("bubbleId:", composer, ":b", _str("n")).alias("key"), _text('{"bubbleId":"b', _str("n"), '","createdAt":"', F.col("ts"), '","tokenCount":{"inputTokens":', _str("input_tokens"), ',"outputTokens":', _str("output_tokens"), "}", F.when(n % 3 == 0, _text(',"modelInfo":{"modelName":"', F.upper("model"), '"}')).otherwise(""), "}").alias("value"))
    composers = s.range(30).select(_text("composerData:c", _str("id")).alias("key"), _text('{"modelConfig":{"modelName":"M', _str("id"), '"}}').alias("value"))
    return logs.cursor_state(bubbles.unionByName(composers)).select("session_id", "request_id", "model", "us", "input_tokens", "output_tokens", "total_tokens")


def _payloads(decoder, payload):
    def query(s, d):
        q = quota_samples(s, d)
        return decoder(q.select("snapshot_id", "us", payload().alias("payload"))).select("snapshot_id", "quota_name", F.round("used_percent", 6).alias("used_percent"), F.round("value", 6).alias("value"), F.round("limit_value", 6).alias("limit_value"), "resets_us", "plan")

    return query


def _codex_payload():
    i = F.col("snapshot_id")
    second = F.when(i % 3 == 0, "null").otherwise(_text('{"used_percent":', _str(i % 100), ',"reset_at":', _str(F.expr("us DIV 1000000 + 60")), "}"))
    return F.when(i % 50 == 0, "oops").otherwise(_text('{"plan_type":"', F.when(i % 2 == 0, "Free").otherwise("pro"), '","rate_limit":{"primary_window":{"used_percent":', _str(F.expr("used_bp / 100")), ',"reset_at":', _str(i % 4), '},"secondary_window":', second, "}}"))


def _zai_payload():
    i = F.col("snapshot_id")
    return _text('{"data":{"limits":[{"type":"TOKENS_LIMIT","usage":', _str(i % 3 * 100), ',"currentValue":', _str(F.expr("used_bp DIV 100")), ',"percentage":7,"nextResetTime":', _str(F.expr("us DIV 1000")), '},{"type":"OTHER"}]}}')


def _gemini_payload():
    return _text('{"buckets":[{"remainingFraction":', _str(F.expr("1 - used_bp DIV 100 * 0.01D")), ',"modelId":"gemini-pro","resetTime":"', _iso(), '"}]}')


def _minimax_payload():
    i = F.col("snapshot_id")
    return _text('{"model_remains":[{"model_name":"m', _str(i % 2), '","remains_time":', _str(i % 3 * 1000), ',"current_interval_total_count":', _str(i % 5 * 100), ',"current_interval_usage_count":', _str(i % 300), "}]}")


def _cursor_payload():
    i = F.col("snapshot_id")
    return F.when(i % 9 == 0, "{}").otherwise(_text('{"billingCycleEnd":"', _str(F.expr("us DIV 1000")), '","planUsage":{"totalPercentUsed":', _str(i % 100), ',"totalSpend":', _str(i % 70), ',"limit":70', F.when(i % 2 == 0, ',"apiPercentUsed":5').otherwise(""), "}}"))


def _openrouter_payload():
    i = F.col("snapshot_id")
    return _text(F.when(i % 2 == 0, '{"data":').otherwise(""), '{"usage":', _str(i % 50), ',"limit":', F.when(i % 3 == 0, "null").otherwise(_str(i % 3 * 40)), "}", F.when(i % 2 == 0, "}").otherwise(""))


def _copilot_payload():
    i = F.col("snapshot_id")
    return _text('{"copilot_plan":"business","quota_reset_date_utc":"', _iso(), '","quota_snapshots":{"chat":{"unlimited":', F.when(i % 2 == 0, "true").otherwise("false"), ',"entitlement":300,"remaining":', _str(i % 300), ',"percent_remaining":', _str(i % 100), "}}}")


def _anthropic_payload():
    """Known and unknown quotas, some disabled; a model's weekly limit that a quota of its own tells, and one that none does."""
    i = F.col("snapshot_id")
    quota = lambda used, more: _text('{"utilization":', used, ',"resets_at":"', _iso(), '"', more, "}")
    limit = lambda name, used: _text('{"kind":"weekly_scoped","percent":', used, ',"resets_at":"', _iso(), '","scope":{"model":{"display_name":"', name, '"}}}')
    return F.when(i % 50 == 0, "oops").otherwise(_text(
        '{"five_hour":', quota(_str(i % 100), F.when(i % 3 == 0, ',"is_enabled":false').otherwise("")), ',"unknown":', quota(F.lit("1"), F.lit("")), F.when(i % 2 == 0, ',"seven_day_sonnet":').otherwise(',"none":'), quota(F.lit("7.5"), F.lit("")),
        ',"limits":[', limit(F.lit("Sonnet"), _str(i % 90)), ",", limit(F.lit("New Model"), F.when(i % 4 == 0, "null").otherwise(_str(i % 80))), "]}",
    ))


def _antigravity_payload():
    i = F.col("snapshot_id")
    model = lambda own, quota: _text('{"label":"L', _str(i % 3), '"', own, quota, "}")
    quota = _text(',"quotaInfo":{', F.when(i % 4 != 0, _text('"remainingFraction":', F.when(i % 4 == 1, "0.25").otherwise("0.5"), ",")).otherwise(""), '"resetTime":"', _iso(), '"}')
    return _text('{"userStatus":{"cascadeModelConfigData":{"clientModelConfigs":[', model(F.when(i % 2 == 0, _text(',"modelOrAlias":{"model":"m', _str(i % 5), '"}')).otherwise(""), quota), ',{"label":"free"}]}}}')


_ALL = f"{SAMPLES}, q AS (SELECT *, snapshot_id AS i FROM qs)"


def _batches(s, d):
    i = F.col("snapshot_id")
    at = F.when(i % 8 == 1, F.lit(NOW_US + DAY)).when(i % 8 == 2, F.lit(NOW_US - 100 * DAY)).otherwise(F.lit(NOW_US - DAY))
    body = F.when(i % 8 == 3, "nothing").otherwise(_text('{"schema_version":', F.when(i % 8 == 4, "2").otherwise("1"), ',"device_id":"', F.when(i % 8 == 5, "").otherwise("d1"), '","events":[{"event_id":"', F.when(i % 8 == 6, "x").otherwise("evt_1"), '","captured_at":"', F.date_format(F.timestamp_micros(at), "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","payload":{', F.when(i % 8 == 7, '"deep":{"api_key":1}').otherwise(""), "}}]}"))
    return payloads.validate_batches(quota_samples(s, d).select("snapshot_id", body.alias("body")), NOW_US).select("snapshot_id", "error")


QUERIES = {
    "claude_lines": (
        _claude,
        f"""WITH {USAGE}, e AS (SELECT *, event_id % 7 AS k FROM ue WHERE event_id % 7 > 1) SELECT CASE WHEN k > 3 AND session_id <> '' THEN session_id ELSE source_path END AS session_id, CASE WHEN k > 3 THEN 'r' || event_id END AS request_id, trim(model) AS model,
        CASE WHEN k = 3 THEN NULL WHEN event_id % 2 = 0 THEN 'fast' ELSE 'standard' END AS speed_mode, {_SEC} AS us, {', '.join(f'CASE WHEN k = 3 THEN 0 ELSE {c} END AS {c}' for c in _COUNTS)},
        CASE WHEN k = 3 THEN 0 ELSE input_tokens + cached_input_tokens + cache_creation_input_tokens + output_tokens END AS total_tokens, CASE WHEN k = 3 THEN CAST(0.25 AS DOUBLE) END AS cost_usd FROM e""",
    ),
    "codex_lines": (
        _codex,
        f"""WITH {USAGE}, c AS (SELECT *, last_value(CASE WHEN event_id % 5 = 0 THEN trim(model) END IGNORE NULLS) OVER w AS m, last_value(CASE WHEN event_id % 5 = 0 THEN reasoning_effort END IGNORE NULLS) OVER w AS ef FROM ue WINDOW w AS (PARTITION BY source_path ORDER BY event_id)),
        u AS (SELECT * FROM c WHERE event_id % 5 <> 0 AND m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path, m, ef, input_tokens, cached_input_tokens, output_tokens, event_id % 400 ORDER BY event_id) = 1)
        SELECT source_path AS session_id, m AS model, ef AS reasoning_effort, {_SEC} AS us, greatest(input_tokens - cached_input_tokens, 0) AS input_tokens, cached_input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens FROM u""",
    ),
    "gemini_documents": (
        _gemini,
        f"""WITH {USAGE} SELECT 'g' || event_id AS request_id, trim(model) AS model, {_SEC} AS us, greatest(input_tokens - cached_input_tokens, 0) AS input_tokens, output_tokens, reasoning_output_tokens, input_tokens + output_tokens + reasoning_output_tokens AS total_tokens
        FROM ue WHERE event_id % 4 <> 0 AND input_tokens + output_tokens + reasoning_output_tokens > 0""",
    ),
    "antigravity_settings": (
        _antigravity,
        f"""WITH {USAGE} SELECT source_path || '-' || event_id AS session_id, CASE event_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'google' END AS provider, lower(trim(model)) AS model, {_SEC} AS us, greatest(input_tokens - cached_input_tokens, 0) AS input_tokens, output_tokens,
        input_tokens + cached_input_tokens + output_tokens AS total_tokens FROM ue WHERE event_id % 6 <> 5""",
    ),
    "cursor_state": (
        _cursor,
        f"""WITH {USAGE} SELECT 'c' || event_id % 40 AS session_id, 'b' || event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN lower(trim(model)) WHEN event_id % 40 < 30 THEN 'm' || event_id % 40 ELSE 'cursor-unknown' END AS model, {_SEC} AS us, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens
        FROM ue WHERE input_tokens + output_tokens > 0""",
    ),
    "payload_codex": (
        _payloads(payloads.codex, _codex_payload),
        f"""WITH {_ALL} SELECT i AS snapshot_id, CASE WHEN i % 3 = 0 AND i % 2 = 0 THEN 'seven_day' ELSE 'five_hour' END AS quota_name, round(used_bp / CAST(100 AS DOUBLE), 6) AS used_percent, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS limit_value, CASE WHEN i % 4 > 0 THEN i % 4 * 1000000 END AS resets_us, CASE WHEN i % 2 = 0 THEN 'Free' ELSE 'pro' END AS plan FROM q WHERE i % 50 <> 0
        UNION ALL SELECT i, 'seven_day', CAST(i % 100 AS DOUBLE), NULL, NULL, {_SEC} + 60000000, CASE WHEN i % 2 = 0 THEN 'Free' ELSE 'pro' END FROM q WHERE i % 50 <> 0 AND i % 3 <> 0""",
    ),
    "payload_zai": (_payloads(payloads.zai, _zai_payload), f"WITH {_ALL} SELECT i AS snapshot_id, 'tokens' AS quota_name, round(CASE WHEN i % 3 > 0 THEN used_bp // 100 * CAST(100 AS DOUBLE) / (i % 3 * 100) ELSE 7 END, 6) AS used_percent, CAST(used_bp // 100 AS DOUBLE) AS value, CAST(i % 3 * 100 AS DOUBLE) AS limit_value, us // 1000 * 1000 AS resets_us, CAST(NULL AS VARCHAR) AS plan FROM q"),
    "payload_gemini": (_payloads(payloads.gemini, _gemini_payload), f"WITH {_ALL} SELECT i AS snapshot_id, 'gemini-pro' AS quota_name, round(used_bp // 100 * CAST(1 AS DOUBLE), 6) AS used_percent, round(1 - used_bp // 100 * CAST(0.01 AS DOUBLE), 6) AS value, CAST(NULL AS DOUBLE) AS limit_value, {_SEC} AS resets_us, CAST(NULL AS VARCHAR) AS plan FROM q"),
    "payload_minimax": (
        _payloads(payloads.minimax, _minimax_payload),
        f"WITH {_ALL}, m AS (SELECT *, i % 5 * 100 AS total, greatest(i % 5 * 100 - i % 300, 0) AS u FROM q) SELECT i AS snapshot_id, 'm' || i % 2 AS quota_name, round(CASE WHEN total > 0 THEN u * CAST(100 AS DOUBLE) / total ELSE 0 END, 6) AS used_percent, CAST(u AS DOUBLE) AS value, CAST(total AS DOUBLE) AS limit_value, CASE WHEN i % 3 > 0 THEN us + i % 3 * 1000000 END AS resets_us, CAST(NULL AS VARCHAR) AS plan FROM m",
    ),
    "payload_cursor": (
        _payloads(payloads.cursor, _cursor_payload),
        f"""WITH {_ALL} SELECT i AS snapshot_id, 'total_usage' AS quota_name, CAST(i % 100 AS DOUBLE) AS used_percent, CAST(i % 70 AS DOUBLE) AS value, CAST(70 AS DOUBLE) AS limit_value, us // 1000 * 1000 AS resets_us, CAST(NULL AS VARCHAR) AS plan FROM q WHERE i % 9 <> 0
        UNION ALL SELECT i, 'api_usage', 5, NULL, NULL, us // 1000 * 1000, NULL FROM q WHERE i % 9 <> 0 AND i % 2 = 0""",
    ),
    "payload_openrouter": (_payloads(payloads.openrouter, _openrouter_payload), f"WITH {_ALL} SELECT i AS snapshot_id, 'credits' AS quota_name, round(CASE WHEN i % 3 > 0 THEN i % 50 * CAST(100 AS DOUBLE) / (i % 3 * 40) END, 6) AS used_percent, CAST(i % 50 AS DOUBLE) AS value, CASE WHEN i % 3 > 0 THEN CAST(i % 3 * 40 AS DOUBLE) END AS limit_value, CAST(NULL AS BIGINT) AS resets_us, CAST(NULL AS VARCHAR) AS plan FROM q"),
    "payload_copilot": (_payloads(payloads.copilot, _copilot_payload), f"WITH {_ALL} SELECT i AS snapshot_id, 'chat' AS quota_name, CAST(CASE WHEN i % 2 = 0 THEN 0 ELSE 100 - i % 100 END AS DOUBLE) AS used_percent, CAST(300 - i % 300 AS DOUBLE) AS value, CAST(300 AS DOUBLE) AS limit_value, {_SEC} AS resets_us, 'business' AS plan FROM q"),
    "payload_anthropic": (
        _payloads(payloads.anthropic, _anthropic_payload),
        f"""WITH {_ALL}, o AS (SELECT * FROM q WHERE i % 50 <> 0), e AS (SELECT i, us, 'five_hour' AS n, CAST(i % 100 AS DOUBLE) AS u FROM o WHERE i % 3 <> 0 UNION ALL SELECT i, us, 'seven_day_sonnet', 7.5 FROM o WHERE i % 2 = 0
            UNION ALL SELECT i, us, 'seven_day_scoped_sonnet', i % 90 FROM o WHERE i % 2 = 1 UNION ALL SELECT i, us, 'seven_day_scoped_new_model', i % 80 FROM o WHERE i % 4 <> 0)
        SELECT i AS snapshot_id, n AS quota_name, u AS used_percent, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS limit_value, {_SEC} AS resets_us, CAST(NULL AS VARCHAR) AS plan FROM e""",
    ),
    "payload_antigravity": (
        _payloads(payloads.antigravity, _antigravity_payload),
        f"""WITH {_ALL} SELECT i AS snapshot_id, CASE WHEN i % 2 = 0 THEN 'm' || i % 5 ELSE 'L' || i % 3 END AS quota_name, CAST(CASE i % 4 WHEN 0 THEN 100 WHEN 1 THEN 75 ELSE 50 END AS DOUBLE) AS used_percent, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS limit_value, {_SEC} AS resets_us, CAST(NULL AS VARCHAR) AS plan FROM q""",
    ),
    "ingest_batches": (
        _batches,
        f"WITH {SAMPLES} SELECT snapshot_id, CASE snapshot_id % 8 WHEN 1 THEN 'clock_skew' WHEN 2 THEN 'too_old' WHEN 3 THEN 'bad_json' WHEN 4 THEN 'schema_version' WHEN 5 THEN 'device' WHEN 6 THEN 'event_id' WHEN 7 THEN 'forbidden_key' END AS error FROM qs",
    ),
    "percent_of_limit": (
        lambda s, d: quota_samples(s, d).select("snapshot_id", F.round(an.percent_of_limit(F.col("used_bp"), F.col("snapshot_id") % 4 * 1000), 6).alias("percent"), F.round(an.percent_of_limit(F.col("used_bp"), F.col("snapshot_id") % 4 * 1000, clamp=True), 6).alias("clamped")),
        f"WITH {SAMPLES}, p AS (SELECT snapshot_id, CASE WHEN snapshot_id % 4 > 0 THEN used_bp * CAST(100 AS DOUBLE) / (snapshot_id % 4 * 1000) ELSE 0 END AS p FROM qs) SELECT snapshot_id, round(p, 6) AS percent, round(least(p, 100), 6) AS clamped FROM p",
    ),
    "known_quotas": (
        lambda s, d: quota_samples(s, d).select("snapshot_id", payloads.is_known_quota(F.when(F.col("snapshot_id") % 3 == 0, F.concat(F.lit("seven_day_scoped_"), "quota_name")).otherwise(F.col("quota_name"))).alias("known")),
        f"WITH {SAMPLES} SELECT snapshot_id, snapshot_id % 3 = 0 OR quota_name IN ('five_hour', 'seven_day', 'seven_day_sonnet', 'seven_day_opus', 'extra_usage', 'monthly') AS known FROM qs",
    ),
}
