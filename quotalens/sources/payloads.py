"""Provider payloads (JSON text) as quota samples in long form.

Input: rows with ``payload`` (JSON) and ``us`` (epoch microseconds of the capture). Output adds, for each quota that the
payload names: quota_name, used_percent, value, limit_value, resets_us, plan. Unreadable payloads give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPED = "seven_day_scoped_"
SEVEN_DAYS_S = 604_800
ANTHROPIC = ("five_hour", "seven_day", "seven_day_sonnet", "seven_day_opus", "extra_usage", "monthly")


def _iso(c: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(c))


def _long(df: DataFrame, entries: Column) -> DataFrame:
    """Explodes an array of (quota_name, used_percent, value, limit_value, resets_us, plan).

    An outer explode, whose row of nulls the names drop: for a plain one Spark filters by the array's size first, and so makes it twice more.
    """
    keep = [c for c in df.columns if c not in ("payload", "_p")]
    return df.select(*keep, F.explode_outer(entries).alias("q")).select(*keep, "q.*").where(F.col("quota_name").isNotNull())


_ENTRIES = "array<struct<quota_name:string,used_percent:double,value:double,limit_value:double,resets_us:bigint,plan:string>>"


def _entry(name: Column, used: Column, value: Column | None = None, limit: Column | None = None, resets: Column | None = None, plan: Column | None = None) -> Column:
    none = F.lit(None)
    parts = [(name, "string", "quota_name"), (used, "double", "used_percent"), (value, "double", "value"), (limit, "double", "limit_value"), (resets, "bigint", "resets_us"), (plan, "string", "plan")]
    return F.struct(*[(none if c is None else c).cast(t).alias(n) for c, t, n in parts])


def is_known_quota(name: Column) -> Column:
    """A quota with a display name of its own, or a weekly limit of one model."""
    return F.coalesce(name.isin(*ANTHROPIC) | name.startswith(SCOPED), F.lit(False))


def slug(name: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(""))


def anthropic(df: DataFrame) -> DataFrame:
    """Known quota objects that are not disabled, and weekly limits of one model where no quota of its own tells them."""
    entry = "struct<utilization:double,resets_at:string,is_enabled:boolean>"
    limits = F.from_json(F.get_json_object("payload", "$.limits"), "array<struct<kind:string,percent:double,resets_at:string,scope:struct<model:struct<display_name:string>>>>")
    df = df.withColumns({"_p": F.from_json("payload", "map<string,string>"), "_limits": limits})
    # each name asks the map by itself: inside a lambda the payload would be parsed anew for each name
    own = F.array(*[F.struct(F.lit(n).alias("name"), F.from_json(F.try_element_at("_p", F.lit(n)), entry).alias("e")) for n in ANTHROPIC])
    df = df.withColumn("_own", F.filter(own, lambda x: x["e"]["utilization"].isNotNull() & F.coalesce(x["e"]["is_enabled"], F.lit(True))))
    weekly = F.filter("_limits", lambda x: (x["kind"] == "weekly_scoped") & x["percent"].isNotNull())
    scoped = F.transform(weekly, lambda x: F.struct(slug(x["scope"]["model"]["display_name"]).alias("name"), x["percent"].alias("percent"), x["resets_at"].alias("resets_at")))
    scoped = F.filter(scoped, lambda x: x["name"].isNotNull() & ~F.exists("_own", lambda o: o["name"] == F.concat(F.lit("seven_day_"), x["name"])))
    entries = F.concat(
        F.transform("_own", lambda x: _entry(x["name"], x["e"]["utilization"], resets=_iso(x["e"]["resets_at"]))),
        F.coalesce(F.transform(scoped, lambda x: _entry(F.concat(F.lit(SCOPED), x["name"]), x["percent"], resets=_iso(x["resets_at"]))), F.array().cast(_ENTRIES)),
    )
    return _long(df, entries).drop("_own", "_limits")


def codex(df: DataFrame) -> DataFrame:
    """Primary, secondary and code-review windows; a lone primary window is weekly on the free plan or if it is a week long."""
    window = "struct<used_percent:double,reset_at:bigint,limit_window_seconds:bigint>"
    limit = f"struct<primary_window:{window},secondary_window:{window}>"
    df = df.withColumn("_p", F.from_json("payload", f"plan_type string, rate_limit {limit}, code_review_rate_limit {limit}"))
    first, second, plan = F.col("_p.rate_limit.primary_window"), F.col("_p.rate_limit.secondary_window"), F.col("_p.plan_type")
    weekly = second.isNull() & ((F.lower(F.trim(plan)) == "free") | (first["limit_window_seconds"] >= SEVEN_DAYS_S))
    made = lambda name, w: _entry(F.when(w.isNotNull(), name), w["used_percent"], resets=F.when(w["reset_at"] > 0, w["reset_at"] * 1_000_000), plan=plan)
    review = F.col("_p.code_review_rate_limit.primary_window")
    return _long(df, F.array(made(F.when(weekly, "seven_day").otherwise("five_hour"), first), made(F.lit("seven_day"), second), made(F.lit("code_review"), review)))


def copilot(df: DataFrame) -> DataFrame:
    """Quota snapshots by name; an unlimited one is 0 % used."""
    snap = "struct<entitlement:double,percent_remaining:double,remaining:double,unlimited:boolean>"
    df = df.withColumn("_p", F.from_json("payload", f"copilot_plan string, quota_reset_date_utc string, quota_reset_date string, quota_snapshots map<string,{snap}>"))
    resets = F.coalesce(_iso(F.col("_p.quota_reset_date_utc")), _iso(F.col("_p.quota_reset_date")))
    used = lambda v: F.when(F.coalesce(v["unlimited"], F.lit(False)), 0.0).otherwise(100 - v["percent_remaining"])
    return _long(df, F.transform(F.map_entries("_p.quota_snapshots"), lambda e: _entry(e["key"], used(e["value"]), e["value"]["entitlement"] - e["value"]["remaining"], e["value"]["entitlement"], resets, F.col("_p.copilot_plan"))))


def zai(df: DataFrame) -> DataFrame:
    """Token and time limits; ``usage`` is the budget and ``currentValue`` what is consumed."""
    df = df.withColumn("_p", F.from_json(F.get_json_object("payload", "$.data.limits"), "array<struct<type:string,usage:double,currentValue:double,percentage:double,nextResetTime:bigint>>"))
    name = lambda t: F.when(t == "TOKENS_LIMIT", "tokens").when(t == "TIME_LIMIT", "time")
    used = lambda x: F.when(x["usage"] > 0, x["currentValue"] * 100 / x["usage"]).otherwise(x["percentage"])
    return _long(df, F.transform("_p", lambda x: _entry(name(x["type"]), used(x), x["currentValue"], x["usage"], x["nextResetTime"] * 1000)))


def gemini(df: DataFrame) -> DataFrame:
    """Buckets by model; use is one less the remaining fraction."""
    df = df.withColumn("_p", F.from_json(F.get_json_object("payload", "$.buckets"), "array<struct<remainingFraction:double,resetTime:string,modelId:string>>"))
    return _long(df, F.transform("_p", lambda x: _entry(x["modelId"], (1 - x["remainingFraction"]) * 100, x["remainingFraction"], resets=_iso(x["resetTime"]))))


def minimax(df: DataFrame) -> DataFrame:
    """Requests by model; the field named usage count holds what remains, and the reset is that much after the capture."""
    item = "struct<model_name:string,remains_time:bigint,current_interval_total_count:double,current_interval_usage_count:double>"
    df = df.withColumn("_p", F.from_json(F.get_json_object("payload", "$.model_remains"), f"array<{item}>"))
    total = lambda x: x["current_interval_total_count"]
    used = lambda x: F.greatest(total(x) - x["current_interval_usage_count"], F.lit(0.0))
    percent = lambda x: F.when(total(x) > 0, used(x) * 100 / total(x)).otherwise(0.0)
    return _long(df, F.transform("_p", lambda x: _entry(x["model_name"], percent(x), used(x), total(x), F.when(x["remains_time"] > 0, F.col("us") + x["remains_time"] * 1000))))


def antigravity(df: DataFrame) -> DataFrame:
    """Models with quota information; use is one less the remaining fraction."""
    path = "$.userStatus.cascadeModelConfigData.clientModelConfigs"
    item = "struct<label:string,modelOrAlias:struct<model:string>,quotaInfo:struct<remainingFraction:double,resetTime:string>>"
    df = df.withColumn("_p", F.from_json(F.get_json_object("payload", path), f"array<{item}>"))
    some = F.filter("_p", lambda x: x["quotaInfo"].isNotNull())
    return _long(df, F.transform(some, lambda x: _entry(F.coalesce(x["modelOrAlias"]["model"], x["label"]), (1 - F.coalesce(x["quotaInfo"]["remainingFraction"], F.lit(0.0))) * 100, resets=_iso(x["quotaInfo"]["resetTime"]))))


def cursor(df: DataFrame) -> DataFrame:
    """Total, auto and API use of the plan in percent; the cycle's end (epoch milliseconds) is the reset."""
    plan = "struct<totalSpend:double,limit:double,autoPercentUsed:double,apiPercentUsed:double,totalPercentUsed:double>"
    df = df.withColumn("_p", F.from_json("payload", f"billingCycleEnd string, planUsage {plan}"))
    p, resets = F.col("_p.planUsage"), F.col("_p.billingCycleEnd").try_cast("bigint") * 1000
    made = lambda name, used, value=None, limit=None: _entry(F.when(p.isNotNull() & used.isNotNull(), F.lit(name)), used, value, limit, resets)
    return _long(df, F.array(made("total_usage", p["totalPercentUsed"], p["totalSpend"], p["limit"]), made("auto_usage", p["autoPercentUsed"]), made("api_usage", p["apiPercentUsed"])))


def openrouter(df: DataFrame) -> DataFrame:
    """Credits used, against the limit where there is one."""
    df = df.withColumn("_p", F.from_json(F.coalesce(F.get_json_object("payload", "$.data"), F.col("payload")), "usage double, `limit` double, limit_remaining double"))
    used, limit = F.col("_p.usage"), F.col("_p.limit")
    return _long(df, F.array(_entry(F.when(used.isNotNull(), F.lit("credits")), F.when(limit > 0, used * 100 / limit), used, limit)))


DECODERS = {"anthropic": anthropic, "codex": codex, "copilot": copilot, "zai": zai, "gemini": gemini, "minimax": minimax, "antigravity": antigravity, "cursor": cursor, "openrouter": openrouter}

#: Fixed limits of an ingest batch.
SKEW_US, AGE_US, BATCH_EVENTS, BATCH_BYTES, SCHEMA_VERSION = 600_000_000, 90 * 86_400_000_000, 500, 1 << 20, 1
FORBIDDEN = "password|authorization|cookie|api_?key|access_?token|refresh_?token|secret"


def validate_batches(batches: DataFrame, now_us: int) -> DataFrame:
    """Batches (column body: JSON) with ``error``: size, version, device, number, clock, age or a forbidden key at any depth."""
    item = "struct<event_id:string,kind:string,captured_at:string,payload:string>"
    b = batches.withColumn("_b", F.from_json("body", f"schema_version int, device_id string, events array<{item}>"))
    events = F.col("_b.events")
    at = lambda e: _iso(e["captured_at"])
    error = (
        F.when(F.octet_length("body") > BATCH_BYTES, "too_large").when(events.isNull(), "bad_json").when(F.coalesce(F.col("_b.schema_version"), F.lit(0)) != SCHEMA_VERSION, "schema_version")
        .when(F.coalesce(F.col("_b.device_id"), F.lit("")) == "", "device").when((F.size(events) == 0) | (F.size(events) > BATCH_EVENTS), "events")
        .when(F.exists(events, lambda e: ~F.coalesce(e["event_id"], F.lit("")).startswith("evt_")), "event_id").when(F.exists(events, lambda e: at(e).isNull()), "captured_at")
        .when(F.exists(events, lambda e: at(e) > now_us + SKEW_US), "clock_skew").when(F.exists(events, lambda e: at(e) < now_us - AGE_US), "too_old")
        .when(F.col("body").rlike(rf'(?i)"({FORBIDDEN})"\s*:'), "forbidden_key")
    )
    return b.withColumn("error", error).drop("_b")
