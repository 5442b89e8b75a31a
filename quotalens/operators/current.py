"""Current state and provider insights (I2b, I7, I8a-I8g, I10, I14, I15, L8, P14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import burn_rate, gemini_family, is_weekly_pace_quota, pace_tier, status
from .samples import KEY, latest_per_quota

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
#: The order in which a provider's quotas are shown; others follow, by name.
DISPLAY = {
    "anthropic": ("five_hour", "seven_day", "seven_day_sonnet", "monthly_limit", "extra_usage"),
    "openai": ("five_hour", "seven_day", "code_review"),
}
UNRANKED = 100
#: What a weekly pace makes of a quota's status.
PACE_STATUS = {"very_over": "critical", "over": "warning", "very_under": "very_underuse", "under": "underuse"}


def display_rank(provider: Column, quota: Column) -> Column:
    """A quota's place among those shown of its provider."""
    made = F.lit(UNRANKED)
    for p, names in DISPLAY.items():
        for k, name in enumerate(names):
            made = F.when((provider == p) & (quota == name), k).otherwise(made)
    return made


def _null_safe(a: str, b: str, on: list[str]) -> Column:
    return F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" for k in on))


def current_state(rows: DataFrame, now_us: int, window_us: int = HOUR_US // 2, least_us: int = HOUR_US // 12, cycles: DataFrame | None = None) -> DataFrame:
    """Of every quota its newest sample, its age, rate and forecast (I1), status (F17), pace (I3) and place.

    A weekly quota with a reset has the status of its pace, healthy while it is on it. A quota without samples in the
    rate's window has no rate. Samples after ``now_us`` do not count.
    """
    latest = latest_per_quota(rows.where(F.col("us") <= now_us))
    rates = burn_rate(rows, now_us, window_us, least_us, cycles)
    s = latest.alias("l").join(rates.alias("r"), _null_safe("l", "r", KEY), "left").select("l.*", "r.rate", "r.hours_left", "r.exhaust_hours", "r.projected_bp", "r.exhausts_first")
    left = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("reset_us") - now_us) * 100.0 / (7 * DAY_US)))
    s = s.withColumn("pace", F.when(is_weekly_pace_quota(F.col("quota_name")) & F.col("reset_us").isNotNull(), pace_tier(F.col("used_bp") / 100.0, F.round(left, 6))["tier"]))
    of_pace = F.lit("healthy")
    for tier, name in PACE_STATUS.items():
        of_pace = F.when(F.col("pace") == tier, name).otherwise(of_pace)
    s = s.withColumn("status", F.when(F.col("pace").isNotNull(), of_pace).otherwise(status(F.col("used_bp"))))
    place = F.row_number().over(Window.partitionBy("provider", "account_id").orderBy(display_rank(F.col("provider"), F.col("quota_name")), "quota_name"))
    return s.select(*KEY, "snapshot_id", "us", (F.lit(now_us) - F.col("us")).alias("age_us"), "used_bp", "reset_us", "rate", "hours_left", "exhaust_hours", "projected_bp", "exhausts_first", "pace", "status", place.cast("bigint").alias("place"))


def current_window(samples: DataFrame, tolerance_us: int = 1_000_000) -> DataFrame:
    """Of every key the samples of its newest one's window: not before ``window_start_us``, the reset the same to a
    second (if the newest has one); where none is, all of the key's samples."""
    last = Window.partitionBy(*KEY).orderBy("us", "snapshot_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = samples.withColumns({"_start": F.last("window_start_us").over(last), "_reset": F.last("reset_us").over(last)})
    inside = F.coalesce(F.col("us") >= F.col("_start"), F.lit(True)) & F.when(F.col("_reset").isNull(), True).otherwise(F.coalesce(F.abs(F.col("_reset") - F.col("reset_us")) <= tolerance_us, F.lit(False)))
    s = s.withColumn("_in", inside).withColumn("_any", F.max("_in").over(Window.partitionBy(*KEY)))
    return s.where("_in OR NOT _any").select(*samples.columns)


def hide_insights(items: DataFrame, hidden: DataFrame, correlated: DataFrame) -> DataFrame:
    """Insights whose key is hidden, or is grouped (``correlated``: key, other) with a hidden one, go."""
    gone = hidden.select("key").unionByName(hidden.join(correlated, "key").select(F.col("other").alias("key"))).distinct()
    return items.join(gone, "key", "left_anti")


def logging_pivot(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row a snapshot, with each quota's use and its change since that quota's last value (W3); ``names`` fix the columns."""
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    r = rows.withColumn("_delta", F.col("used_bp") - F.lag("used_bp").over(w))
    of = lambda n, c: F.max(F.when(F.col("quota_name") == n, F.col(c)))
    return r.groupBy("provider", "account_id", "snapshot_id", "us").agg(*[x for n in names for x in (of(n, "used_bp").alias(f"{n}_bp"), of(n, "_delta").alias(f"{n}_delta_bp"))])


def zai_rate(cycles: DataFrame, now_us: int) -> DataFrame:
    """Of open cycles: current use over the time since their start, with no least age and no cap on the projection."""
    age = F.lit(now_us) - F.col("start_us")
    rate = F.when((age > 0) & (F.col("used_bp") > 0), F.col("used_bp") * float(HOUR_US) / age)
    left = F.col("reset_us") - now_us
    return cycles.select(*KEY, F.round(rate, 6).alias("rate"), F.round(F.when(left > 0, F.col("used_bp") + rate * left / float(HOUR_US)), 4).alias("projected_bp"))


def zai_insights(samples: DataFrame, now_us: int) -> DataFrame:
    """Per account of token counters (snapshot_id, us, tokens_used, tokens_budget, reset_us, details): tokens an hour over 24
    hours, use projected at the reset (percent of the budget, and its severity), the trend of 24 hours, tokens used in 7 days and a
    day, capacity a month, tokens a tool call and the tool used most.

    The trend holds the newer half of the samples (of four or more; of an odd number the middle one is newer) against the older
    half, 25 % either way; the older must have risen, the newer may have fallen. The 7 days are the last counter less the first, if it
    rose. details: JSON array of {"modelCode", "usage"}. Unknown parts are null.
    """
    keys = ["provider", "account_id"]
    order = F.struct("us", "snapshot_id")
    s = samples.where((F.col("us") <= now_us) & (F.col("us") > now_us - 7 * DAY_US))
    day = F.col("us") > now_us - DAY_US
    of_day = Window.partitionBy(*keys, day)
    s = s.withColumns({"_nth": F.row_number().over(of_day.orderBy("us", "snapshot_id")), "_all": F.count("*").over(of_day)})
    enough, newer = day & (F.col("_all") >= 4), F.col("_nth") > F.floor(F.col("_all") / 2)
    first, last = lambda c, x: F.min_by(F.when(c, F.col(x)), F.when(c, order)), lambda c, x: F.max_by(F.when(c, F.col(x)), F.when(c, order))
    span = lambda c, n: [first(c, "us").alias(f"{n}_t0"), last(c, "us").alias(f"{n}_t1"), first(c, "tokens_used").alias(f"{n}_v0"), last(c, "tokens_used").alias(f"{n}_v1")]
    a = s.groupBy(*keys).agg(
        *span(day, "d"), *span(enough & ~newer, "o"), *span(enough & newer, "n"), *span(F.lit(True), "w"),
        F.max_by(F.struct("tokens_used", "tokens_budget", "reset_us", "details"), order).alias("l"),
    )
    speed = lambda n: F.when(F.col(f"{n}_t1") > F.col(f"{n}_t0"), (F.col(f"{n}_v1") - F.col(f"{n}_v0")) * float(HOUR_US) / (F.col(f"{n}_t1") - F.col(f"{n}_t0")))
    rising = lambda n: F.when(speed(n) > 0, speed(n))
    week = F.when(rising("w").isNotNull(), F.col("w_v1") - F.col("w_v0"))
    a = a.withColumns({
        "rate": F.round(rising("d"), 6), "_old": rising("o"), "_new": speed("n"), "week_tokens": week, "day_tokens": F.round(rising("w") * 24, 4),
        "_tools": F.from_json("l.details", "array<struct<modelCode:string,usage:double>>"),
    })
    hours = (F.col("l.reset_us") - now_us) / float(HOUR_US)
    projected = F.when(hours > 0, (F.col("l.tokens_used") + F.col("rate") * hours) * 10000 / F.col("l.tokens_budget"))
    change = (F.col("_new") - F.col("_old")) * 100 / F.col("_old")
    calls = F.aggregate("_tools", F.lit(0.0), lambda n, t: n + F.coalesce(t["usage"], F.lit(0.0)))
    top = F.expr("array_sort(_tools, (a, b) -> CASE WHEN a.usage <> b.usage THEN cast(sign(b.usage - a.usage) AS INT) WHEN a.modelCode < b.modelCode THEN -1 WHEN a.modelCode > b.modelCode THEN 1 ELSE 0 END)[0].modelCode")
    a = a.withColumn("projected_bp", F.round(projected, 4)).withColumn("tool_calls", F.round(calls, 4))
    return a.select(
        *keys, "rate", "projected_bp", status(F.col("projected_bp"), "severity").alias("severity"), F.when(change > 25, "rising").when(change < -25, "falling").when(change.isNotNull(), "steady").alias("trend"), "week_tokens", "day_tokens",
        (F.col("l.tokens_budget") * 30).alias("month_capacity"), "tool_calls", F.round(F.when(F.col("tool_calls") > 0, F.col("l.tokens_used") / F.col("tool_calls")), 4).alias("tokens_a_call"), top.alias("top_tool"),
    )


def copilot_insights(latest: DataFrame, rates: DataFrame, series: DataFrame, now_us: int, since_us: int, covered: str) -> DataFrame:
    """Per limited quota (entitlement, remaining, unlimited, reset_us): use in percent, forecast where a rate above 0 is
    known, else its current use, severity (70 and 90), time to the reset if ahead, and the samples of ``covered`` since ``since_us``."""
    used = F.when(F.col("entitlement") > 0, (F.col("entitlement") - F.col("remaining")) * 10000.0 / F.col("entitlement"))
    q = latest.where("NOT unlimited AND entitlement > 0").withColumn("used_bp", F.round(used, 4))
    n = series.where((F.col("quota_name") == covered) & (F.col("us") >= since_us)).groupBy("provider", "account_id").agg(F.count("*").alias("snapshots"))
    q = q.alias("q").join(rates.select(*KEY, "rate").alias("r"), _null_safe("q", "r", KEY), "left").join(n.alias("n"), _null_safe("q", "n", ["provider", "account_id"]), "left")
    ahead = F.col("q.reset_us") - now_us
    return q.select(
        *[F.col(f"q.{k}") for k in KEY], F.col("q.used_bp"), F.when(F.col("r.rate") > 0, "forecast").otherwise("current").alias("kind"), F.when(F.col("r.rate") > 0, F.col("r.rate")).alias("rate"),
        status(F.col("q.used_bp"), "copilot_insight").alias("severity"), F.when(ahead > 0, ahead).alias("reset_in_us"), F.coalesce("n.snapshots", F.lit(0)).alias("snapshots"),
    )


#: Plans whose weekly window is all there is: their five-hour quota is the weekly one under an old name.
FREE_PLAN = "free"
#: The quotas that are forecast, in the order shown.
FORECASTS = ("five_hour", "seven_day", "code_review")


def _work_us(start: Column, end: Column, off: tuple[int, ...]) -> Column:
    """Microseconds of [start, end), cut into days from its start on, that begin on no day in ``off`` (Sunday is 1)."""
    days = F.sequence(F.lit(0), F.lit(6))
    begun = lambda k: start + k * F.lit(DAY_US)
    part = lambda k: F.greatest(F.lit(0), F.least(end - begun(k), F.lit(DAY_US)))
    work = lambda k: ~F.dayofweek(F.timestamp_micros(begun(k))).isin(*off) if off else F.lit(True)
    return F.aggregate(days, F.lit(0).cast("bigint"), lambda n, k: n + F.when(work(k), part(k)).otherwise(0))


def codex_insights(latest: DataFrame, cycles: DataFrame, rates: DataFrame, plans: DataFrame, now_us: int, days: int = 30, week: str = "7-day") -> DataFrame:
    """Per account its primary quota's history, forecasts of its quotas, and its weekly pace.

    ``latest``: KEY, snapshot_id, us, used_bp, reset_us; ``cycles``: KEY, start_us, end_us (null: open), peak_bp, delta_bp; ``rates``: KEY, rate,
    projected_bp; ``plans``: provider, account_id, plan (others have none). The primary quota is five_hour, of the free plan seven_day,
    or what it was called before, five_hour. Its history is that of the cycles that began in the last ``days`` and are closed (number,
    average change, highest peak), else that of the open one (number 0); on the free plan each falls back to the old name first.

    A quota's forecast is the use projected at its reset, not below its use now, where its rate is above 0.01 % an hour; without
    such a rate the forecast is null. Quotas under the old name count as seven_day, the higher use of both. Status of a forecast: by the
    use now, of code_review by what remains. The pace holds weekly use against an even one over the time, or over the work days of ``week``
    (7-day, 6-day, 5-day): within 2 points on pace, else over or in reserve. Null accounts are accounts.
    """
    account = ["provider", "account_id"]
    plan = plans.select(*account, (F.lower(F.trim("plan")) == FREE_PLAN).alias("_free")).groupBy(*account).agg(F.max("_free").alias("_free"))

    def planned(df: DataFrame) -> DataFrame:
        return df.alias("x").join(plan.alias("p"), _null_safe("x", "p", account), "left").select("x.*", F.coalesce("_free", F.lit(False)).alias("_free"))

    old, open_ = F.col("quota_name") == "five_hour", F.col("end_us").isNull()
    kept = open_ | (F.col("start_us") >= now_us - days * DAY_US)
    place = F.when(F.col("_free"), F.when(F.col("quota_name") == "seven_day", 0).when(old, 1)).otherwise(F.when(old, 0))
    own = planned(cycles).withColumn("_place", place + F.when(open_, 2).otherwise(0)).where(kept & F.col("_place").isNotNull())
    own = own.withColumn("_best", F.min("_place").over(Window.partitionBy(*account))).where("_place = _best")
    history = own.groupBy(*account).agg(F.count_if(~open_).alias("cycles"), F.round(F.avg("delta_bp"), 4).alias("avg_delta_bp"), F.max("peak_bp").alias("peak_bp"))

    name = F.when(F.col("_free") & old, "seven_day").otherwise(F.col("quota_name"))
    now = planned(latest).withColumn("_name", name)
    now = now.groupBy(*account, "_free", "_name").agg(F.max_by(F.struct("used_bp", "reset_us"), F.struct("used_bp", "us", "snapshot_id")).alias("l"))
    own_first = F.when(F.col("_name") == F.col("quota_name"), 0).otherwise(1)
    rate = planned(rates).withColumn("_name", name).groupBy(*account, "_name").agg(F.min_by(F.struct("rate", "projected_bp"), own_first).alias("r"))
    both = now.alias("n").join(rate.alias("r"), F.expr("n.provider = r.provider AND n.account_id <=> r.account_id AND n._name = r._name"), "left").select("n.*", F.col("r.r.rate").alias("rate"), F.col("r.r.projected_bp").alias("projected_bp"))
    used = F.col("l.used_bp")
    forecast = F.when(F.col("rate") > 1, F.greatest(used.cast("double"), "projected_bp"))
    left = F.greatest(10000 - used, F.lit(0))
    state = F.when(F.col("rate") > 1, F.when(F.col("_name") == "code_review", F.when(left <= 500, "critical").when(left <= 2000, "danger").when(left <= 5000, "warning").otherwise("healthy")).otherwise(status(used))).otherwise("info")
    of = lambda q, c: F.max(F.when(F.col("_name") == q, c))
    out = both.groupBy(*account, "_free").agg(
        *[x for q in FORECASTS for x in (of(q, forecast).alias(f"{q}_forecast_bp"), of(q, state).alias(f"{q}_status"))],
        of("seven_day", used).alias("_used"), of("seven_day", F.col("l.reset_us")).alias("_reset"),
    )
    start, off = F.col("_reset") - 7 * DAY_US, {"7-day": (), "6-day": (1,), "5-day": (1, 7)}[week]
    done, whole = _work_us(start, F.lit(now_us), off), _work_us(start, F.col("_reset"), off)
    inside = (F.col("_reset") > now_us) & (F.col("_reset") - now_us <= 7 * DAY_US)
    over = F.round(F.when(inside, F.col("_used") - done * 10000.0 / whole), 4)
    out = out.withColumn("pace_bp", over).withColumn("pace", F.when(over.between(-200, 200), "on_pace").when(over > 200, "over").when(over < -200, "reserve"))
    made = out.alias("o").join(history.alias("h"), _null_safe("o", "h", account), "left")
    return made.select("o.provider", "o.account_id", F.when(F.col("_free"), "seven_day").otherwise("five_hour").alias("primary_quota"), F.coalesce("cycles", F.lit(0)).alias("cycles"), "avg_delta_bp", "peak_bp", *[c for c in out.columns if c not in account and not c.startswith("_")])


def gemini_insights(latest: DataFrame, cycles: DataFrame, now_us: int, least_us: int = HOUR_US // 6, most: int = 50) -> DataFrame:
    """I8d: per account and family of models (``model``, used_bp, reset_us; of cycles: model, start_us, end_us, peak_bp, delta_bp):
    the highest rate of members' open cycles of ten minutes or more, completed cycles with average and highest peak (the
    newest ``most`` of a member), and whether it runs out before the reset (negative), burns 5 % an hour or more (warning),
    is idle (info), or neither (positive)."""
    keys = ["provider", "account_id", "family"]
    c = cycles.withColumn("family", gemini_family(F.col("model")))
    age = F.lit(now_us) - F.col("start_us")
    rate = F.when(F.col("end_us").isNull() & (age >= least_us) & (F.col("delta_bp") > 0), F.col("delta_bp") * float(HOUR_US) / age)
    nth = F.row_number().over(Window.partitionBy("provider", "account_id", "model", F.col("end_us").isNull()).orderBy(F.desc("start_us")))
    done = F.col("end_us").isNotNull() & (F.col("_nth") <= most)
    c = c.withColumn("_nth", nth).groupBy(*keys).agg(F.round(F.max(rate), 6).alias("rate"), F.count_if(done).alias("completed"), F.round(F.avg(F.when(done, F.col("peak_bp"))), 4).alias("avg_peak_bp"), F.max(F.when(done, F.col("peak_bp"))).alias("max_peak_bp"))
    f = latest.withColumn("family", gemini_family(F.col("model"))).groupBy(*keys).agg(F.min_by("used_bp", "model").alias("used_bp"), F.min("reset_us").alias("reset_us"))
    f = f.alias("f").join(c.alias("c"), _null_safe("f", "c", keys), "left").select("f.*", "rate", F.coalesce("completed", F.lit(0)).alias("completed"), "avg_peak_bp", "max_peak_bp")
    hours = (10000 - F.col("used_bp")) / F.col("rate")
    early = hours < (F.col("reset_us") - now_us) / float(HOUR_US)
    severity = F.when(F.col("rate").isNull(), "info").when(F.coalesce(early, F.lit(False)), "negative").when(F.col("rate") >= 500, "warning").otherwise("positive")
    return f.select(*f.columns, F.round(hours, 4).alias("exhaust_hours"), severity.alias("severity"))


def openrouter_insights(latest: DataFrame) -> DataFrame:
    """I8e: per account (usage, usage_limit, free_tier): what remains of the limit (not below 0), use in percent, and whether that
    is high (90 and more) or moderate (75 and more); without a limit above 0 there is neither."""
    limited = F.col("usage_limit") > 0
    used = F.round(F.when(limited, F.col("usage") * 10000.0 / F.col("usage_limit")), 4)
    level = F.when(used >= 9000, "high").when(used >= 7500, "moderate")
    return latest.select("provider", "account_id", "usage", F.when(limited, F.greatest(F.col("usage_limit") - F.col("usage"), F.lit(0))).alias("remaining"), used.alias("used_bp"), level.alias("level"), F.coalesce("free_tier", F.lit(False)).alias("free_tier"))


def minimax_insights(samples: DataFrame, now_us: int) -> DataFrame:
    """I8f, of a shared pool: over the newest sample's window (I10), requests an hour from its first to its last, what is projected at
    the reset (rounded half up, at most the total), the hours until it runs out, and its level: exhausted, over_pace, high (80 %), or safe.

    ``samples``: KEY, snapshot_id, us, used, total, window_start_us, reset_us. A window of one sample or without a rise has no rate.
    """
    order = F.struct("us", "snapshot_id")
    a = current_window(samples.where(F.col("us") <= now_us)).groupBy(*KEY).agg(F.min("us").alias("t0"), F.max("us").alias("t1"), F.min_by("used", order).alias("u0"), F.max_by(F.struct("used", "total", "reset_us"), order).alias("l"))
    rate = F.when((F.col("t1") > F.col("t0")) & (F.col("l.used") > F.col("u0")), (F.col("l.used") - F.col("u0")) * float(HOUR_US) / (F.col("t1") - F.col("t0")))
    hours = (F.col("l.reset_us") - now_us) / float(HOUR_US)
    a = a.withColumn("rate", F.round(rate, 6))
    reached = F.floor(F.when(hours > 0, F.col("l.used") + F.coalesce("rate", F.lit(0.0)) * hours) + 0.5).cast("bigint")
    projected = F.when(reached > F.col("l.total"), F.col("l.total")).otherwise(reached)
    out = F.when(F.col("rate") > 0, (F.col("l.total") - F.col("l.used")) / F.col("rate"))
    level = F.when(F.col("l.used") >= F.col("l.total"), "exhausted").when(F.coalesce(out < hours, F.lit(False)), "over_pace").when(F.col("l.used") * 10 >= F.col("l.total") * 8, "high").otherwise("safe")
    return a.select(*KEY, F.col("l.used").alias("used"), F.col("l.total").alias("total"), "rate", projected.alias("projected"), F.round(out, 4).alias("exhaust_hours"), level.alias("level"))


def antigravity_insights(latest: DataFrame, cycles: DataFrame, now_us: int, since_us: int) -> DataFrame:
    """I8g: per account and quota group, the sums over its models of the mean rate of completed cycles since ``since_us`` and of the
    open cycle's rate (percent an hour, from cycles that rose); the group's rate (the open one if above 0), the hours until it runs
    out, its level (before the reset: critical; 5 % an hour or more: warning; else, and for a quiet group, info), and the account's
    earliest end among groups that run out before their reset.

    ``latest``: provider, account_id, group, used_bp, reset_us; ``cycles``: provider, account_id, group, model, start_us, end_us, delta_bp.
    """
    keys = ["provider", "account_id", "group"]
    length = F.coalesce("end_us", F.lit(now_us)) - F.col("start_us")
    rate = F.when((F.col("delta_bp") > 0) & (length > 0), F.col("delta_bp") * float(HOUR_US) / length)
    done = F.col("end_us").isNotNull() & (F.col("start_us") >= since_us)
    m = cycles.groupBy(*keys, "model").agg(F.avg(F.when(done, rate)).alias("_done"), F.max(F.when(F.col("end_us").isNull(), rate)).alias("_open"))
    m = m.groupBy(*keys).agg(F.round(F.sum("_done"), 4).alias("completed_rate"), F.round(F.sum("_open"), 4).alias("open_rate"))
    g = latest.groupBy(*keys).agg(F.max("used_bp").alias("used_bp"), F.min("reset_us").alias("reset_us"))
    g = g.alias("g").join(m.alias("m"), _null_safe("g", "m", keys), "left").select("g.*", "completed_rate", "open_rate").withColumn("rate", F.when(F.col("open_rate") > 0, F.col("open_rate")).otherwise(F.col("completed_rate")))
    hours = F.when(F.col("rate") > 0, (10000 - F.col("used_bp")) / F.col("rate"))
    early = F.coalesce((hours > 0) & (hours < (F.col("reset_us") - now_us) / float(HOUR_US)), F.lit(False))
    g = g.withColumn("exhaust_hours", F.round(hours, 4)).withColumn("level", F.when(early, "critical").when(hours <= 0, "info").when(F.col("rate") >= 500, "warning").otherwise("info"))
    return g.withColumn("earliest_hours", F.min(F.when(F.col("level") == "critical", F.col("exhaust_hours"))).over(Window.partitionBy("provider", "account_id")))
