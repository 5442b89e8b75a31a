"""The test tables seen as usage events, quota samples, meters and prices, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.session import prepare

DAY, HOUR, MINUTE = 86_400, 3_600, 60
#: Quota of an event type and the seconds of its window.
QUOTAS = {"view": ("seven_day", 7 * DAY), "click": ("five_hour", 5 * HOUR), "purchase": ("seven_day_sonnet", 7 * DAY), "signup": ("monthly", 30 * DAY), "error": ("daily", DAY)}
MODELS = ("claude-sonnet", " GPT-Codex", "gemini-pro", "unlisted-model", "gpt-6-astra", "gpt-5.6-sol", "gpt-5.4", "claude-opus-4-7")


def _case(of: str, values: dict) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items()) + " END"


_PROVIDER = "CASE user_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'gemini' END"
_MODEL = _case("k % 8", dict(enumerate(MODELS)))
_WINDOW = _case("event_type", {t: w for t, (_, w) in QUOTAS.items()})
_QUOTA = _case("event_type", {t: q for t, (q, _) in QUOTAS.items()})

#: name: select list over ``ev`` (event_id, us, user_id, event_type, value, k), the same text for both engines; DIV is integer division.
_USAGE = f"""event_id, us, event_type AS integration_name, {_PROVIDER} AS provider, concat('acct-', CAST(user_id % 10 AS STRING)) AS account_name,
    {_MODEL} AS model, CASE WHEN k % 5 = 0 THEN '' ELSE concat('s', CAST(user_id AS STRING)) END AS session_id, concat('p', CAST(user_id % 7 AS STRING)) AS source_path,
    CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'unknown' END AS reasoning_effort, CASE WHEN k % 2 = 0 THEN 'chat' ELSE 'agent' END AS mode,
    CASE k % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'standard' ELSE 'unknown' END AS speed_mode,
    CAST(k * 10 + CASE WHEN k % 13 = 0 THEN 272000 ELSE 0 END AS BIGINT) AS input_tokens, CAST(k * 3 AS BIGINT) AS cached_input_tokens, CAST(k % 7 AS BIGINT) AS cache_creation_input_tokens, CAST(k % 3 AS BIGINT) AS cache_creation_1h_input_tokens,
    CAST(floor(value) AS BIGINT) AS output_tokens, CAST(k % 11 AS BIGINT) AS reasoning_output_tokens,
    CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS cost_cents"""
_SAMPLES = f"""event_id AS snapshot_id, us, {_PROVIDER} AS provider, CASE WHEN user_id % 50 = 7 THEN NULL ELSE user_id END AS account_id, {_QUOTA} AS quota_name,
    CAST(((us DIV 1000000) % {_WINDOW}) * 10000 DIV {_WINDOW} + (k % 7) * 10 AS BIGINT) AS used_bp,
    CASE WHEN k % 20 = 0 THEN NULL ELSE (((us DIV 1000000) DIV {_WINDOW}) + 1) * {_WINDOW} * 1000000 + (k % 3 - 1) * 1000000 END AS reset_us"""


def _duck(text: str) -> str:
    return text.replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us (epoch microseconds), user_id, event_type, value, k (from props)."""
    prepare(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per API request: dimensions, token counts, cost in cents (null: unknown price)."""
    return events(spark, sf_dir).selectExpr(*_split(_USAGE))


def quota_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per snapshot and quota; used_bp is utilisation in hundredths of a percent, reset_us may be null."""
    return events(spark, sf_dir).selectExpr(*_split(_SAMPLES))


def _split(select: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(select[start:i])
            start = i + 1
    return [*parts, select[start:]]


EV = "ev AS (SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
USAGE = f"{EV}, ue AS (SELECT {_duck(_USAGE)} FROM ev)"
SAMPLES = f"{EV}, qs AS (SELECT {_duck(_SAMPLES)} FROM ev)"

#: Public list prices are not copied here; these are test values: (model, effective from, input, output, cache read, cache write, one-hour cache write, dollars a million tokens).
PRICES = (
    ("claude-sonnet", None, 3.0, 15.0, 0.3, 3.75, 6.0),
    ("claude-sonnet", "2024-01-15", 2.5, 12.0, 0.25, 3.0, None),
    ("openai/gpt-codex", None, 1.25, 10.0, 0.125, 1.25, None),
    ("google/gemini-pro", "2024-01-10", 1.0, 5.0, 0.1, 1.0, 0.0),
    ("google/gemini-pro", "2024-01-20", 0.5, 4.0, 0.05, 0.5, 0.75),
    ("gpt-6-astra", None, 10.0, 50.0, 1.0, 12.5, None),
    ("GPT-5.6-sol", None, 5.0, 30.0, 0.5, 6.25, 8.0),
    ("openai/gpt-5.4", None, 2.0, 12.0, 0.2, 2.5, None),
    ("anthropic/claude-opus-4-7", None, 5.0, 25.0, 0.5, 6.25, 10.0),
)


def prices(spark: SparkSession) -> DataFrame:
    rows = [(m, f, *r) for m, f, *r in PRICES]
    df = spark.createDataFrame(rows, "model string, effective string, input_cost double, output_cost double, cache_read_cost double, cache_write_cost double, cache_write_1h_cost double")
    return df.withColumn("from_us", F.unix_micros(F.to_timestamp("effective"))).drop("effective")


PRICES_SQL = "prices AS (SELECT model, epoch_us(CAST(effective AS TIMESTAMP)) AS from_us, input_cost, output_cost, cache_read_cost, cache_write_cost, cache_write_1h_cost FROM (VALUES " + ", ".join(
    f"('{m}', {repr(f) if f else 'NULL'}, {', '.join('CAST(NULL AS DOUBLE)' if x is None else f'CAST({x} AS DOUBLE)' for x in r)})" for m, f, *r in PRICES
) + ") AS t(model, effective, input_cost, output_cost, cache_read_cost, cache_write_cost, cache_write_1h_cost))"
