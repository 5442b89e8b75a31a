"""Insights over billing periods and shared pools (I5, I6, I8f), names of models (F15), ages (F18), the log of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boundaries import billing_periods
from .samples import KEY

DAY_US, HOUR_US, MINUTE_US = 86_400_000_000, 3_600_000_000, 60_000_000
ACCOUNT = ["provider", "account_id"]


def newest_cycles(cycles: DataFrame, most: int = 50) -> DataFrame:
    """Of each key its newest ``most`` completed cycles (``is_open`` false)."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("start_us"))
    return cycles.where(~F.col("is_open")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def period_insights(periods: DataFrame) -> DataFrame:
    """Of each quota's billing periods (T8): number, average and highest peak; from three periods and an average over 1 % on
    how far the highest lies above the average (over 50 % spiky, over 10 % uneven, else steady); from four on the trend: the newer
    half (of an odd number the smaller) against the older, 15 % either way. What has too few periods is null.
    """
    w = Window.partitionBy(*KEY)
    p = periods.withColumns({"_nth": F.row_number().over(w.orderBy(F.desc("period"))), "_all": F.count("*").over(w)})
    new = F.col("_nth") <= F.floor(F.col("_all") / 2)
    a = p.groupBy(*KEY).agg(F.count("*").alias("periods"), F.round(F.avg("peak_bp"), 6).alias("avg_bp"), F.max("peak_bp").alias("max_bp"), F.avg(F.when(new, F.col("peak_bp"))).alias("_new"), F.avg(F.when(~new, F.col("peak_bp"))).alias("_old"))
    over = F.round(F.when((F.col("periods") >= 3) & (F.col("avg_bp") > 100), (F.col("max_bp") - F.col("avg_bp")) * 100 / F.col("avg_bp")), 4)
    change = F.round(F.when((F.col("periods") >= 4) & (F.col("_old") > 0), (F.col("_new") - F.col("_old")) * 100 / F.col("_old")), 4)
    spread = F.when(over > 50, "spiky").when(over > 10, "uneven").when(over.isNotNull(), "steady")
    trend = F.when(change > 15, "rising").when(change < -15, "falling").when(change.isNotNull(), "steady")
    return a.select(*KEY, "periods", "avg_bp", "max_bp", over.alias("over_percent"), spread.alias("spread"), change.alias("change_percent"), trend.alias("trend"))


def rate_ratio(rates: DataFrame, short: str = "five_hour", long: str = "seven_day", least_bp: float = 1.0) -> DataFrame:
    """Per account how many points of ``short`` a point of ``long`` costs at the present rates (KEY, rate in hundredths of a percent an
    hour); only where both are ``least_bp`` (0.01 %) or more."""
    of = lambda q: F.max(F.when(F.col("quota_name") == q, F.col("rate")))
    a = rates.groupBy(*ACCOUNT).agg(of(short).alias("short_rate"), of(long).alias("long_rate")).where((F.col("short_rate") >= least_bp) & (F.col("long_rate") >= least_bp))
    return a.withColumn("ratio", F.round(F.col("short_rate") / F.col("long_rate"), 6))


def plan_use(cycles: DataFrame, limits: DataFrame, now_us: int, range_us: int, main: str = "subscription") -> DataFrame:
    """Per account what its counted quotas used: in the range, all together and of ``main``; of ``main`` in 30 and 7 days, the month at
    the week's pace (times 30/7) and whether that passes 80 % of the limit times the month's cycles; and how its average period
    fits the limit (under 25 % much too large, under 50 roomy, under 80 fits, under 95 tight, else over).

    ``cycles``: KEY, start_us, peak_bp, delta_bp (peaks are counts here); ``limits``: provider, account_id, usage_limit. Use is the sum of
    the peaks of the periods (T8) that the cycles begun since make. All three spans are folded in one pass, as keys of their own.
    """
    spans = {"range": range_us, "month": 30 * DAY_US, "week": 7 * DAY_US}
    began = F.filter(F.array(*[F.when(F.col("start_us") >= now_us - us, F.lit(n)) for n, us in spans.items()]), lambda x: x.isNotNull())
    dealt = cycles.withColumn("_span", F.explode(began)).withColumn("quota_name", F.concat("quota_name", F.lit("\n"), "_span"))
    p = billing_periods(dealt).withColumns({"_span": F.element_at(F.split("quota_name", "\n"), -1), "quota_name": F.element_at(F.split("quota_name", "\n"), 1)})
    own = F.col("quota_name") == main
    sum_ = lambda span, only: F.coalesce(F.sum(F.when((F.col("_span") == span) & only, F.col("peak_bp"))), F.lit(0))
    month = (F.col("_span") == "month") & own
    a = p.groupBy(*ACCOUNT).agg(
        sum_("range", own).alias("used_range"), sum_("range", F.lit(True)).alias("all_range"), sum_("month", own).alias("used_month"), sum_("week", own).alias("used_week"),
        F.avg(F.when(month, F.col("peak_bp"))).alias("_avg"), F.coalesce(F.sum(F.when(month, F.col("cycles"))), F.lit(0)).alias("_cycles"),
    )
    limit = limits.groupBy(*ACCOUNT).agg(F.max("usage_limit").alias("_limit"))
    a = a.alias("a").join(limit.alias("l"), F.expr("a.provider = l.provider AND a.account_id <=> l.account_id"), "left").select("a.*", "_limit")
    pace = F.when(F.col("used_week") > 0, F.round(F.col("used_week") * 30.0 / 7.0, 4))
    high = (F.col("_limit") > 0) & (F.col("_cycles") > 0) & (F.col("used_week") * 30.0 / 7.0 > F.col("_limit") * F.col("_cycles") * 0.8)
    fit = F.round(F.when((F.col("_avg") > 0) & (F.col("_limit") > 0), F.col("_avg") * 100 / F.col("_limit")), 4)
    level = F.when(fit < 25, "much_too_large").when(fit < 50, "roomy").when(fit < 80, "fits").when(fit < 95, "tight").when(fit.isNotNull(), "over")
    return a.select(*ACCOUNT, "used_range", "all_range", "used_month", "used_week", pace.alias("month_at_pace"), F.when(F.col("used_week") > 0, F.coalesce(high, F.lit(False))).alias("pace_high"), fit.alias("average_percent"), level.alias("plan_fit"))


def pool_days(samples: DataFrame) -> DataFrame:
    """I8f: per key (with ``used``) the days on which it was seen after its first sample and their rises; falls add nothing, a day of
    falls alone is none."""
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    rise = F.col("used") - F.lag("used").over(w)
    return samples.withColumn("_rise", rise).where(F.col("_rise") >= 0).groupBy(*KEY, F.expr(f"us DIV {DAY_US}").alias("day")).agg(F.sum("_rise").alias("used"))


def pool_history(samples: DataFrame, cycles: DataFrame, now_us: int, range_us: int) -> DataFrame:
    """I8f of a shared pool beside its present window: average and highest day of the range (7 days at least), the trend of its days
    (the newer half, of an odd number the larger, against the older: by over 5 and 15 %), use of the newest sample, what the last completed cycle used, and
    interval use for a point of weekly use.

    ``samples``: KEY, snapshot_id, us, used, total, weekly_used, weekly_total (null or 0: no weekly limit); ``cycles``: KEY, end_us, delta.
    """
    s = samples.where((F.col("us") <= now_us) & (F.col("us") >= now_us - max(range_us, 7 * DAY_US)))
    w = Window.partitionBy(*KEY)
    d = pool_days(s).withColumns({"_nth": F.row_number().over(w.orderBy("day")), "_all": F.count("*").over(w)})
    old = F.col("_nth") <= F.floor(F.col("_all") / 2)
    d = d.groupBy(*KEY).agg(F.count("*").alias("days"), F.round(F.avg("used"), 6).alias("day_average"), F.max("used").alias("day_peak"), F.max_by("day", F.struct("used", -F.col("day"))).alias("peak_day"), F.avg(F.when(old, F.col("used"))).alias("_old"), F.avg(F.when(~old, F.col("used"))).alias("_new"))
    change, least = F.col("_new") - F.col("_old"), F.greatest(F.lit(5.0), F.when(F.col("_old") > 0, F.col("_old") * 0.15).otherwise(0.0))
    d = d.withColumn("trend", F.when(change > least, "rising").when(change < -least, "falling").otherwise("stable"))
    last = s.groupBy(*KEY).agg(F.max_by(F.struct("used", "total", "weekly_used", "weekly_total"), F.struct("us", "snapshot_id")).alias("l")).select(*KEY, "l.*")
    done = cycles.where(F.col("end_us") <= now_us).groupBy(*KEY).agg(F.max_by("delta", "end_us").alias("_last"))
    same = lambda b: F.expr(" AND ".join(f"a.{k} <=> {b}.{k}" for k in KEY))
    a = last.alias("a").join(d.alias("d"), same("d"), "left").join(done.alias("c"), same("c"), "left").select("a.*", "days", "day_average", "day_peak", "peak_day", "trend", "_last")
    percent = lambda x, y: F.when(F.col(y) > 0, F.col(x) * 100.0 / F.col(y))
    weekly = percent("weekly_used", "weekly_total")
    ratio = F.when(weekly > 0, F.round(percent("used", "total") / weekly, 6)).when(F.col("weekly_total") > 0, 0.0)
    return a.select(*KEY, F.coalesce("days", F.lit(0)).alias("days"), "day_average", "day_peak", "peak_day", F.coalesce("trend", F.lit("stable")).alias("trend"), F.round(percent("used", "total"), 4).alias("used_percent"), F.round(percent("_last", "total"), 4).alias("last_cycle_percent"), ratio.alias("interval_for_week"))


def model_use(latest: DataFrame) -> DataFrame:
    """I8f of pools that are not shared: per account number of models, average and highest use, sums, and the models at 80 % or more,
    by name (critical from 95 on). ``latest``: provider, account_id, model, used, total; a model without a total is unused."""
    p = latest.withColumn("_p", F.when(F.col("total") > 0, F.col("used") * 100.0 / F.col("total")).otherwise(0.0))
    high = F.when(F.col("_p") >= 80, F.concat("model", F.lit(":"), F.when(F.col("_p") >= 95, "critical").otherwise("warning")))
    return p.groupBy(*ACCOUNT).agg(
        F.count("*").alias("models"), F.round(F.avg("_p"), 4).alias("avg_percent"), F.round(F.max("_p"), 4).alias("max_percent"), F.sum("used").alias("used"), F.sum("total").alias("total"),
        F.array_join(F.array_sort(F.collect_set(high)), ",").alias("high"),
    )


def cursor_model(name: Column) -> Column:
    """lower case, without ``-thinking`` at its end, and 4.6 of claude written 4-6."""
    return F.replace(F.regexp_replace(F.lower(F.trim(name)), "-thinking$", ""), F.lit("claude-4.6"), F.lit("claude-4-6"))


#: Brackets in brackets that are taken out pair by pair; an open one takes the rest with it.
NESTED = 4


def antigravity_model(name: Column) -> Column:
    """lower case, without ``custom:`` before it and what stands in brackets; dots, blanks and dashes in a row are one dash, none
    at the ends."""
    made = F.lower(F.regexp_replace(F.trim(name), "^custom:", ""))
    for _ in range(NESTED):
        made = F.regexp_replace(made, r"\[[^\[\]]*\]", "")
    made = F.regexp_replace(F.regexp_replace(made, r"\[.*$", ""), r"\]", "")
    return F.regexp_replace(F.regexp_replace(made, r"[.\- \t]+", "-"), "^-|-$", "")


def time_ago(us: Column, now_us: int) -> Column:
    """just now, 5m ago, 3h ago, 2d ago; times ahead are just now, null is empty."""
    age = F.lit(now_us) - us
    ago = lambda unit, mark: F.concat(F.floor(age / unit).cast("string"), F.lit(f"{mark} ago"))
    return F.when(us.isNull(), "").when(age < MINUTE_US, "just now").when(age < HOUR_US, ago(MINUTE_US, "m")).when(age < DAY_US, ago(HOUR_US, "h")).otherwise(ago(DAY_US, "d"))


def alert_log(alerts: DataFrame, created: DataFrame, dismissed: DataFrame, now_us: int, keep_us: int) -> DataFrame:
    """The table of alerts after new ones came (same columns), some were dismissed (``alert_id``), and what was created ``keep_us``
    ago or more was cleared. Columns: alert_id, provider, us, until_us, dismissed and any more. An id that is there already is not
    created again; an unknown one cannot be dismissed."""
    new = created.dropDuplicates(["alert_id"]).join(alerts.select("alert_id"), "alert_id", "left_anti")
    all_ = alerts.unionByName(new.select(*alerts.columns)).where(F.col("us") > now_us - keep_us)
    gone = dismissed.select("alert_id", F.lit(True).alias("_gone")).distinct()
    return all_.join(gone, "alert_id", "left").withColumn("dismissed", F.coalesce("_gone", "dismissed")).select(*alerts.columns)
