"""Resets, billing periods and activity sessions of quota series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted
from .samples import KEY

MINUTE_US, HOUR_US, DAY_US = 60_000_000, 3_600_000_000, 86_400_000_000


def reset_boundaries(rows: DataFrame) -> DataFrame:
    """Samples at which the reset time moved by over 10 minutes, appeared or went, or use fell by over 20 points from
    over 20, or fell at all after a gap of over an hour."""
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    rows = rows.withColumns({"_used": F.lag("used_bp").over(w), "_reset": F.lag("reset_us").over(w), "_us": F.lag("us").over(w)})
    moved = F.when(F.col("reset_us").isNotNull() & F.col("_reset").isNotNull(), F.abs(F.col("reset_us") - F.col("_reset")) > 10 * MINUTE_US).otherwise(F.col("reset_us").isNotNull() | F.col("_reset").isNotNull())
    fell = (F.col("_used") > 2000) & (F.col("_used") - F.col("used_bp") > 2000)
    gap = (F.col("us") - F.col("_us") > HOUR_US) & (F.col("used_bp") < F.col("_used"))
    return rows.withColumn("is_boundary", F.col("_us").isNotNull() & (moved | fell | gap)).drop("_used", "_reset", "_us")


def cycle_stats(rows: DataFrame) -> DataFrame:
    """A9 over T12's segments: peak, sum of rises, and the first reset time, per segment."""
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    rows = reset_boundaries(rows).withColumn("segment", F.sum(F.col("is_boundary").cast("bigint")).over(w))
    rise = F.greatest(F.col("used_bp") - F.lag("used_bp").over(Window.partitionBy(*KEY, "segment").orderBy("us", "snapshot_id")), F.lit(0))
    rows = rows.withColumn("_rise", F.coalesce(rise, F.lit(0)))
    return rows.groupBy(*KEY, "segment").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.max("used_bp").alias("peak_bp"), F.sum("_rise").alias("delta_bp"),
        F.min_by("reset_us", F.struct("us", "snapshot_id")).alias("reset_us"), F.count("*").alias("samples"),
    )


#: The longest that a cycle can last, by provider family: (quota, or its first letters if it ends in *, microseconds).
CAPS = {
    "anthropic": (("five_hour", 6 * HOUR_US), ("seven_day*", 8 * DAY_US), ("monthly", 32 * DAY_US)),
    "synthetic": (("search", 2 * HOUR_US), ("subscription", 48 * HOUR_US)),
    "zai": (("tokens", 48 * HOUR_US),),
    "copilot": (("*", 35 * DAY_US),),
}


def bad_cycles(cycles: DataFrame, family: str = "anthropic") -> DataFrame:
    """Cycles that last longer than their quota can; quotas without a cap have none."""
    cap = F.lit(None).cast("bigint")
    for name, us in reversed(CAPS[family]):
        fits = F.col("quota_name").startswith(name[:-1]) if name.endswith("*") else F.col("quota_name") == name
        cap = F.when(fits, F.lit(us)).otherwise(cap)
    return cycles.where(F.col("end_us") - F.col("start_us") > cap)


def repaired_cycles(cycles: DataFrame, rows: DataFrame) -> DataFrame:
    """The samples of each bad cycle, cut at T12's boundaries into cycles of their own.

    ``end_us`` is a cycle's last sample, which belongs to it. Cycles of a key do not overlap, so a window over samples and
    cycle starts carries the latest start forward: no pairs, and null accounts meet their own.
    """
    bad = bad_cycles(cycles).select(*KEY, F.col("start_us").alias("us"), F.struct("start_us", "end_us").alias("_cycle"), F.lit(-1).cast("bigint").alias("snapshot_id"), F.lit(0).alias("_side"))
    both = rows.select(*KEY, "us", "snapshot_id", "used_bp", "reset_us", F.lit(1).alias("_side")).unionByName(bad, allowMissingColumns=True)
    at = Window.partitionBy(*KEY).orderBy("us", "_side", "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_cycle", F.last("_cycle", ignorenulls=True).over(at)).where((F.col("_side") == 1) & (F.col("us") <= F.col("_cycle.end_us")))
    held = held.withColumn("cycle_us", F.col("_cycle.start_us"))
    w = Window.partitionBy(*KEY, "cycle_us").orderBy("us", "snapshot_id")
    held = held.withColumns({"_used": F.lag("used_bp").over(w), "_reset": F.lag("reset_us").over(w), "_us": F.lag("us").over(w)})
    moved = F.when(F.col("reset_us").isNotNull() & F.col("_reset").isNotNull(), F.abs(F.col("reset_us") - F.col("_reset")) > 10 * MINUTE_US).otherwise(F.col("reset_us").isNotNull() | F.col("_reset").isNotNull())
    fell = (F.col("_used") > 2000) & (F.col("_used") - F.col("used_bp") > 2000)
    gap = (F.col("us") - F.col("_us") > HOUR_US) & (F.col("used_bp") < F.col("_used"))
    cut = (F.col("_us").isNotNull() & (moved | fell | gap)).cast("bigint")
    held = held.withColumn("segment", F.sum(cut).over(w)).withColumn("_rise", F.when(cut == 1, 0).otherwise(F.greatest(F.coalesce(F.col("used_bp") - F.col("_used"), F.lit(0)), F.lit(0))))
    return held.groupBy(*KEY, "cycle_us", "segment").agg(F.min("us").alias("start_us"), F.max("used_bp").alias("peak_bp"), F.sum("_rise").alias("delta_bp"), F.count("*").alias("samples"))


def billing_periods(cycles: DataFrame, floor_bp: int = 500) -> DataFrame:
    """Runs of cycles; a cycle whose peak is under half of its run's highest (over ``floor_bp``) opens a new run.

    The running maximum starts anew with each run, so rows are folded in order: each task walks its sorted keys with one
    row of state.
    """

    def walk(rows):
        key, run = None, None
        for *own, start, peak, delta in rows:
            if own != key or (run[3] > floor_bp and 2 * peak < run[3]):
                if key is not None:
                    yield *key, *run
                run = [0 if own != key else run[0] + 1, start, 0, 0, 0]
                key = own
            run[2] += 1
            run[3] = max(run[3], peak)
            run[4] += delta
        if key is not None:
            yield *key, *run

    ordered = cycles.select(*KEY, "start_us", "peak_bp", "delta_bp").repartition(*KEY).sortWithinPartitions(*KEY, "start_us")
    return fold_sorted(ordered, walk, "provider string, account_id long, quota_name string, period long, start_us long, cycles long, peak_bp long, delta_bp long")


def billing_summary(periods: DataFrame) -> DataFrame:
    """Number, sum, average and highest of the peaks of each quota's billing periods."""
    return periods.groupBy(*KEY).agg(
        F.count("*").alias("periods"), F.sum("peak_bp").cast("bigint").alias("total_peak_bp"), F.round(F.avg("peak_bp"), 6).alias("avg_peak_bp"), F.max("peak_bp").alias("max_peak_bp")
    )


def idle_sessions(rows: DataFrame, timeout_us: int, silence_closes: bool = False, forget_us: int | None = None) -> DataFrame:
    """Activity sessions of a series, from changes of its value; windows alone, no fold.

    The first sample is the baseline. A change opens a session, or extends an open one whatever the gap; an unchanged
    sample within the timeout counts, one beyond closes. So a session starts at a change if none came before, or if the
    sample before lies over the timeout after the last change. It ends at its last change plus the timeout.

    ``silence_closes``: a session also closes when its timeout passes without any sample, as timers do on a stream; so a change
    later than that opens a new one. ``forget_us``: after so long without a sample the value is forgotten, and the next is a baseline.
    """
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    known = F.lit(True) if forget_us is None else F.col("us") - F.lag("us").over(w) <= forget_us
    rows = rows.withColumn("_changed", F.coalesce((F.col("used_bp") != F.lag("used_bp").over(w)) & known, F.lit(False)))
    rows = rows.withColumns({"_last": F.last(F.when(F.col("_changed"), F.col("us")), ignorenulls=True).over(earlier), "_us": F.lag("us").over(w), "_before": F.lag("used_bp").over(w)})
    seen = F.col("us") if silence_closes else F.col("_us")
    opens = F.col("_changed") & (F.col("_last").isNull() | (seen - F.col("_last") > timeout_us))
    rows = rows.withColumn("session", F.sum(opens.cast("bigint")).over(w)).withColumn("_opens", opens)
    member = (F.col("session") > 0) & (F.col("_changed") | (F.col("us") - F.col("_last") <= timeout_us))
    return rows.where(member).groupBy(*KEY, "session").agg(
        F.min("us").alias("start_us"), (F.max(F.when(F.col("_changed"), F.col("us"))) + timeout_us).alias("end_us"), F.max(F.when(F.col("_opens"), F.col("_before"))).alias("start_bp"),
        F.max(F.when(F.col("_changed"), F.col("used_bp"))).alias("max_bp"), F.count("*").alias("samples"),
    )


def split_sessions(rows: DataFrame, gap_us: int) -> DataFrame:
    """Sessions split at a gap, a fall in use, or a reset time that moved by over a second."""
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    split = (F.col("us") - F.lag("us").over(w) > gap_us) | (F.col("used_bp") < F.lag("used_bp").over(w)) | (F.abs(F.coalesce("reset_us", F.lit(0)) - F.coalesce(F.lag("reset_us").over(w), F.lit(0))) > 1_000_000)
    rows = rows.withColumn("session", F.sum(F.coalesce(split, F.lit(False)).cast("bigint")).over(w))
    return rows.groupBy(*KEY, "session").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("used_bp").alias("start_bp"), F.max("used_bp").alias("max_bp"), F.count("*").alias("samples"))


def cumulative_delta(events: DataFrame) -> DataFrame:
    """Changes of cumulative counters per path; a new model or any counter that fell starts anew from the whole value."""
    w = Window.partitionBy("source_path").orderBy("us", "event_id")
    counters = ["input_tokens", "cached_input_tokens", "output_tokens"]
    d = {f"_{c}": F.col(c) - F.lag(c).over(w) for c in counters}
    rows = events.withColumns(d | {"_model": F.lag("model").over(w)})
    goes_on = F.coalesce(F.col("model") == F.col("_model"), F.lit(False))
    for c in counters:
        goes_on = goes_on & (F.col(f"_{c}") >= 0)
    return rows.select("event_id", "source_path", goes_on.alias("goes_on"), *[F.when(goes_on, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in counters])


def daily_usage(rows: DataFrame) -> DataFrame:
    """Rises of each quota by UTC day; falls are skipped."""
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    rise = F.col("used_bp") - F.lag("used_bp").over(w)
    rows = rows.withColumn("_rise", rise).where(F.col("_rise") > 0)
    return rows.groupBy(*KEY, F.expr("us DIV 86400000000").alias("day")).agg(F.sum("_rise").alias("rise_bp"))
