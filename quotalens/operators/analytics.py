"""Summaries, rates, forecasts and groupings of quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import KEY

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
WEEK_US = 7 * DAY_US


def asof(left: DataFrame, right: DataFrame, on: list[str], value: str, tie: str) -> DataFrame:
    """For each row of ``left`` (on, us) the latest ``value`` of ``right`` (on, us, tie, value) at or before it.

    Both sides are united and a window carries the last value forward: one shuffle on the key and a sort, no pairs.
    """
    r = right.select(*on, "us", F.col(tie).alias("_tie"), F.struct(F.col("us").alias("at_us"), F.col(value)).alias("_v"), F.lit(0).alias("_side"), *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (*on, "us")])
    l = left.select(*on, "us", F.lit(None).cast("bigint").alias("_tie"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"), *[c for c in left.columns if c not in (*on, "us")])
    w = Window.partitionBy(*on).orderBy("us", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = r.unionByName(l).withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*left.columns, F.col("_found.at_us").alias("at_us"), F.col(f"_found.{value}").alias(value))


def quota_summary(cycles: DataFrame) -> DataFrame:
    """A10: per quota, its completed cycles (number, sum, average and largest change, highest peak, first start) and the open one."""
    done = ~F.col("is_open")
    return cycles.groupBy("provider", "quota_name").agg(
        F.count_if(done).alias("completed"), F.coalesce(F.sum(F.when(done, F.col("delta_bp"))), F.lit(0)).cast("bigint").alias("total_delta_bp"),
        F.round(F.avg(F.when(done, F.col("delta_bp"))), 6).alias("avg_delta_bp"), F.max(F.when(done, F.col("peak_bp"))).alias("max_peak_bp"), F.min(F.when(done, F.col("start_us"))).alias("first_start_us"),
        F.count_if(F.col("is_open")).alias("open"), F.max(F.when(F.col("is_open"), F.col("peak_bp"))).alias("open_peak_bp"),
    )


def with_open(cycles: DataFrame) -> DataFrame:
    """Marks the last segment of every key as open."""
    return cycles.withColumn("is_open", F.col("segment") == F.max("segment").over(Window.partitionBy(*KEY)))


def burn_rate(rows: DataFrame, now_us: int, window_us: int, least_us: int, cycles: DataFrame | None = None) -> DataFrame:
    """Change an hour over the trailing window (two samples and ``least_us`` apart at least; a fall counts as 0), hours to
    100 %, use projected at the reset (at most 100 %), and whether it runs out before.

    Where the window gives no rate, the rate of the open cycle (``cycles`` with KEY and rate, as ``insights.cycle_rate``
    gives it) is taken if it is above zero. An unknown rate leaves all that follows from it unknown, and so does an
    unknown reset; a reset that has passed leaves no time. Every quota seen in the window has a row.
    """
    recent = rows.where((F.col("us") > now_us - window_us) & (F.col("us") <= now_us))
    order = F.struct("us", "snapshot_id")
    a = recent.groupBy(*KEY).agg(F.min("us").alias("t0"), F.max("us").alias("t1"), F.min_by("used_bp", order).alias("first_bp"), F.max_by("used_bp", order).alias("last_bp"), F.max_by("reset_us", order).alias("reset_us"), F.count("*").alias("n"))
    known = (F.col("n") >= 2) & (F.col("t1") - F.col("t0") >= least_us)
    rate = F.when(known, F.greatest(F.col("last_bp") - F.col("first_bp"), F.lit(0)) * float(HOUR_US) / (F.col("t1") - F.col("t0")))
    left = F.when(F.col("reset_us").isNotNull(), F.greatest(F.col("reset_us") - now_us, F.lit(0)) / float(HOUR_US))
    a = a.withColumn("rate", F.round(rate, 6)).withColumn("hours_left", F.round(left, 6))
    if cycles is not None:
        of_cycle = cycles.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.when(F.col("rate") > 0, F.col("rate")).alias("_rate"))
        a = a.join(of_cycle, F.expr(" AND ".join(f"{k} <=> _{k}" for k in KEY)), "left").withColumn("rate", F.coalesce("rate", "_rate"))
    exhaust = F.when(F.col("rate") > 0, (10000 - F.col("last_bp")) / F.col("rate"))
    reached = F.col("last_bp") + F.col("rate") * F.col("hours_left")
    return a.select(
        *KEY, "n", "rate", "hours_left", F.round(exhaust, 4).alias("exhaust_hours"), F.round(F.when(reached > 10000, 10000.0).otherwise(reached), 4).alias("projected_bp"),
        (exhaust < F.col("hours_left")).alias("exhausts_first"),
    )


def is_weekly_pace_quota(quota: Column) -> Column:
    """The quotas that have a weekly pace."""
    q = F.lower(F.trim(quota))
    return q.isin("seven_day", "seven_day_sonnet") | q.contains("weekly") | q.startswith("wkly_")


def pace_tier(used: Column, left_share: Column) -> Column:
    """Tier of a weekly quota from its use and the share of the week that is left (in percent): struct<tier, trigger>.

    Over an even pace by 15 points or 30 % of what is left: very_over; by 10 points or 20 %: over. Under by as many points
    or shares of what has passed: very_under and under. Flat points go before shares, very before not; less than one point
    either way and all the rest are on_pace. trigger: flat, time_left or elapsed.
    """
    passed = 100 - left_share
    delta = used - passed
    case = lambda tier, trigger: F.struct(F.lit(tier).alias("tier"), F.lit(trigger).alias("trigger"))
    on = case("on_pace", None)
    over = F.when(delta >= 15, case("very_over", "flat")).when(delta >= 0.3 * left_share, case("very_over", "time_left")).when(delta >= 10, case("over", "flat")).when(delta >= 0.2 * left_share, case("over", "time_left")).otherwise(on)
    under = F.when(-delta >= 15, case("very_under", "flat")).when(-delta >= 0.3 * passed, case("very_under", "elapsed")).when(-delta >= 10, case("under", "flat")).when(-delta >= 0.2 * passed, case("under", "elapsed")).otherwise(on)
    return F.when(F.abs(delta) < 1, on).when(delta > 0, over).otherwise(under)


def weekly_pace(rows: DataFrame) -> DataFrame:
    """I3 for each sample of a weekly quota with a reset; one that has passed leaves no time, more than a week counts as one."""
    week = rows.where(is_weekly_pace_quota(F.col("quota_name")) & F.col("reset_us").isNotNull())
    left = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("reset_us") - F.col("us")) * 100.0 / WEEK_US))
    return week.select(*KEY, "snapshot_id", F.round(left, 6).alias("left_share"), pace_tier(F.col("used_bp") / 100.0, F.round(left, 6)).alias("_p")).select(*KEY, "snapshot_id", "left_share", "_p.*")


def workdays(start: Column, end: Column, days: int = 5) -> Column:
    """fractional workdays of [start, end) in microseconds: 24-hour steps from the start, a step counting by its first day."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil((end - start) / DAY_US) - 1, F.lit(0)).cast("bigint"))
    # 1970-01-01 was a Thursday: Monday is 0
    part = lambda k: F.when(F.pmod(F.floor((start + k * DAY_US) / DAY_US) + 3, F.lit(7)) < days, F.least(F.lit(1.0), (end - start - k * DAY_US) / float(DAY_US))).otherwise(0.0)
    return F.when(end > start, F.aggregate(F.transform(steps, part), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def workday_pace(rows: DataFrame, days: int = 5) -> DataFrame:
    """I4: use against the share of the week's workdays passed, with a band of two points."""
    week = rows.where(F.col("quota_name").startswith("seven_day") & F.col("reset_us").isNotNull() & (F.col("reset_us") > F.col("us")) & (F.col("reset_us") - F.col("us") <= WEEK_US))
    start = F.col("reset_us") - WEEK_US
    week = week.withColumn("passed", F.round(workdays(start, F.col("us"), days), 6)).withColumn("whole", F.round(workdays(start, F.col("reset_us"), days), 6))
    delta = F.col("used_bp") / 100.0 - 100.0 * F.col("passed") / F.col("whole")
    return week.select(*KEY, "snapshot_id", "passed", "whole", F.when(delta > 2, "ahead").when(delta < -2, "behind").otherwise("on_track").alias("pace"))


def percent_of_limit(used: Column, limit: Column, clamp: bool = False) -> Column:
    """Use in percent of a limit; 0 where there is none above 0, and within 0 to 100 if clamped. An unknown use stays unknown."""
    p = F.when(limit > 0, used * 100.0 / limit).otherwise(F.when(used.isNotNull(), 0.0))
    return F.when(p < 0, 0.0).when(p > 100, 100.0).otherwise(p) if clamp else p


#: Status ladders: rungs (name, from this use on in hundredths of a percent), highest first, and what is below all.
LADDERS = {
    "usage": ((("critical", 9500), ("danger", 8000), ("warning", 5000)), "healthy"),
    "cursor": ((("exhausted", 9500), ("critical", 8000), ("warning", 6000)), "healthy"),
    "severity": ((("negative", 9500), ("warning", 8000), ("info", 5000)), "positive"),
    "copilot_insight": ((("negative", 9000), ("warning", 7000)), "positive"),
    "menubar": ((("critical", 9000), ("warning", 7000)), "healthy"),
    "openrouter": ((("high", 9000), ("moderate", 7500)), "low"),
}


def status(used_bp: Column, kind: str = "usage", unlimited: Column | None = None) -> Column:
    """the highest rung of the ladder that use has reached; "remaining" counts what is left (at or below 50, 20, 5 %).

    An unlimited quota is at the bottom whatever its use; unknown use has no status.
    """
    if kind == "remaining":
        made = F.when(used_bp <= 500, "critical").when(used_bp <= 2000, "danger").when(used_bp <= 5000, "warning").when(used_bp.isNotNull(), "healthy")
        bottom = "healthy"
    else:
        rungs, bottom = LADDERS[kind]
        made = F.when(used_bp >= rungs[0][1], rungs[0][0])
        for name, least in rungs[1:]:
            made = made.when(used_bp >= least, name)
        made = made.when(used_bp.isNotNull(), bottom)
    return made if unlimited is None else F.when(unlimited, bottom).otherwise(made)


RANK = {"healthy": 0, "warning": 1, "danger": 2, "critical": 3}


def status_ladder(rows: DataFrame) -> DataFrame:
    """every ladder's status of every sample."""
    return rows.select("snapshot_id", *[status(F.col("used_bp"), k).alias(f"{k}_status") for k in LADDERS], status(10000 - F.col("used_bp"), "remaining").alias("remaining_status"))


def provider_cards(latest: DataFrame) -> DataFrame:
    """Highest use, worst status and numbers per provider."""
    s = status(F.col("used_bp"))
    rank = F.when(s == "critical", 3).when(s == "danger", 2).when(s == "warning", 1).otherwise(0)
    return latest.groupBy("provider").agg(F.max("used_bp").alias("max_bp"), F.max_by(s, rank).alias("worst"), F.count("*").alias("quotas"), F.count_if(rank >= 2).alias("alarming"))


def provider_aggregate(cards: DataFrame) -> DataFrame:
    """One row over all providers: their number, highest use, worst status, critical ones and those in danger or warned, and a label.

    No providers are healthy. The labels are fixed values.
    """
    rank = F.when(F.col("worst") == "critical", 3).when(F.col("worst") == "danger", 2).when(F.col("worst") == "warning", 1).otherwise(0)
    a = cards.agg(
        F.count("*").alias("providers"), F.coalesce(F.max("max_bp"), F.lit(0)).alias("max_bp"), F.coalesce(F.max_by("worst", rank), F.lit("healthy")).alias("status"),
        F.count_if(F.col("worst") == "critical").alias("critical"), F.count_if(F.col("worst").isin("danger", "warning")).alias("warned"),
    )
    label = F.when(F.col("critical") > 0, F.concat(F.col("critical").cast("string"), F.lit(" Critical"))).when(F.col("warned") > 0, F.concat(F.col("warned").cast("string"), F.lit(" Warning"))).otherwise("All Good")
    return a.withColumn("label", label)


def gemini_family(model: Column) -> Column:
    """the pool that a Gemini model draws on: flash-lite, flash, pro, or the model's own name."""
    m = F.lower(model)
    return F.when(m.contains("flash") & m.contains("lite"), "flash-lite").when(m.contains("pro"), "pro").when(m.contains("flash"), "flash").otherwise(model)


def family_rollup(models: DataFrame) -> DataFrame:
    """Per snapshot and family, the first member's use (all share a pool), the earliest known reset, and the members.

    ``models``: snapshot_id, place (order in the snapshot), model, used_bp, reset_us. Ordered for display by family rank (L8).
    """
    a = models.groupBy("snapshot_id", gemini_family(F.col("model")).alias("family")).agg(
        F.min_by("used_bp", "place").alias("used_bp"), F.min("reset_us").alias("reset_us"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "model"))), lambda m: m["model"]), "+").alias("members")
    )
    return a.withColumn("rank", F.when(F.col("family") == "pro", 0).when(F.col("family") == "flash", 1).when(F.col("family") == "flash-lite", 2).otherwise(3))


def pool_groups(latest: DataFrame) -> DataFrame:
    """Quotas of a provider that show the same use and reset share a pool; named by its members in order."""
    return latest.groupBy("provider", "used_bp", "reset_us").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat("quota_name", F.lit("@"), F.coalesce(F.col("account_id").cast("string"), F.lit(""))))), "+").alias("pool"))


def shared_pool(latest: DataFrame) -> DataFrame:
    """Accounts all of whose quotas (two or more) agree in use, and in reset to a second; merged into the first by name."""
    a = latest.groupBy("provider", "account_id").agg(
        F.count("*").alias("n"), F.min("used_bp").alias("lo"), F.max("used_bp").alias("hi"), F.min("reset_us").alias("r0"), F.max("reset_us").alias("r1"), F.min_by(F.struct("quota_name", "used_bp", "reset_us"), "quota_name").alias("_m")
    )
    shared = (F.col("n") > 1) & (F.col("lo") == F.col("hi")) & (F.coalesce(F.col("r1") - F.col("r0"), F.lit(0)) <= 1_000_000)
    a = a.withColumn("is_shared", shared)
    return a.select("provider", "account_id", "n", "is_shared", *[F.when(F.col("is_shared"), F.col(f"_m.{c}")).alias(f"merged_{c}") for c in ("quota_name", "used_bp", "reset_us")])


def grouped_cycles(cycles: DataFrame) -> DataFrame:
    """Cycles of all accounts of a quota that start in the same minute, as one."""
    minute = (F.col("start_us") - F.pmod("start_us", F.lit(60_000_000))).alias("minute_us")
    return cycles.groupBy("provider", "quota_name", minute).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("peak_bp").alias("peak_bp"), F.sum("delta_bp").alias("delta_bp"))


def trend_half_split(daily: DataFrame) -> DataFrame:
    """The older half of a series (the smaller one, if it has an odd number) against the newer: a change over
    max(5 points, 15 % of the older) is a trend; fewer than two days are stable."""
    w = Window.partitionBy(*KEY)
    d = daily.withColumn("_i", F.row_number().over(w.orderBy("day"))).withColumn("_n", F.count("*").over(w))
    old = F.col("_i") <= F.expr("_n DIV 2")
    a = d.groupBy(*KEY).agg(F.round(F.avg(F.when(old, F.col("rise_bp"))), 6).alias("older"), F.round(F.avg(F.when(~old, F.col("rise_bp"))), 6).alias("newer"))
    change, least = F.col("newer") - F.col("older"), F.greatest(F.lit(500.0), 0.15 * F.col("older"))
    return a.withColumn("trend", F.when(change > least, "rising").when(change < -least, "falling").otherwise("stable"))


def cycle_overview(cycles: DataFrame, rows: DataFrame, names: tuple[str, ...] = ("five_hour", "monthly", "seven_day")) -> DataFrame:
    """Each cycle's peak sample (earliest on ties), its first sample, the account's other quotas at that moment,
    and how far each of these rose since the cycle's start.

    Cycles of a key are disjoint, so a window over cycle starts and samples carries the latest start forward, and a sample
    up to that cycle's end is its: no pairs. Then the quotas' values at both moments are one carried value each.
    """
    heads = cycles.select(*KEY, F.col("start_us").alias("us"), F.struct("start_us", "end_us").alias("_cycle"), F.lit(-1).cast("bigint").alias("snapshot_id"), F.lit(0).alias("_side"))
    both = rows.select(*KEY, "us", "snapshot_id", "used_bp", F.lit(1).alias("_side")).unionByName(heads, allowMissingColumns=True)
    at = Window.partitionBy(*KEY).orderBy("us", "_side", "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_cycle", F.last("_cycle", ignorenulls=True).over(at)).where((F.col("_side") == 1) & (F.col("us") <= F.col("_cycle.end_us")))
    best = held.groupBy(*KEY, F.col("_cycle.start_us").alias("start_us")).agg(
        F.max_by(F.struct("us", "used_bp"), F.struct("used_bp", -F.col("us"))).alias("_peak"), F.min_by("used_bp", F.struct("us", "snapshot_id")).alias("start_bp")
    ).select(*KEY, "start_us", F.col("_peak.us").alias("peak_us"), F.col("_peak.used_bp").alias("peak_bp"), "start_bp")
    account = ["provider", "account_id"]
    moments = best.select(*account, F.struct(*best.columns).alias("_of"), F.explode(F.array(F.struct(F.col("start_us").alias("us"), F.lit(0).alias("_which")), F.struct(F.col("peak_us").alias("us"), F.lit(1).alias("_which")))).alias("_m")).select(*account, "_of", "_m.*")
    points = rows.select(*account, "us", "snapshot_id", "quota_name", "used_bp").unionByName(moments, allowMissingColumns=True)
    upto = Window.partitionBy(*account).orderBy("us", F.coalesce("_which", F.lit(-1)) >= 0, "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    known = {f"{n}_bp": F.last(F.when(F.col("quota_name") == n, F.col("used_bp")), ignorenulls=True).over(upto) for n in names}
    at_moment = points.withColumns(known).where("_which IS NOT NULL")
    pair = lambda n, w: F.max(F.when(F.col("_which") == w, F.col(f"{n}_bp")))
    out = at_moment.groupBy("_of").agg(*[pair(n, 1).alias(f"{n}_bp") for n in names], *[(pair(n, 1) - pair(n, 0)).alias(f"{n}_delta_bp") for n in names])
    return out.select("_of.*", *[c for n in names for c in (f"{n}_bp", f"{n}_delta_bp")])
