"""Subscription value: allowance cycles of meters against the cost of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotalens.session import cut

from .folds import fold_sorted
from .ingest import prefer_polled
from .samples import KEY

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
#: Time that one task of the running sums holds of a provider.
SPAN_US = 600_000_000
#: An interval closes when use has risen by so much; a fall of up to REJECT_BP at the same reset (within RESET_US) is rejected.
LEAST_BP, REJECT_BP, RESET_US, FULL_BP = 500, 500, 60_000_000, 10_000
#: Quotas whose intervals calibrate models: these names, or names that end in this.
WEEKLY, WEEKLY_TAIL = ("seven_day", "weekly"), ":weekly"
_OUT = (
    "provider string, account_id long, quota_name string, cycle long, plan string, boundary string, start_us long, start_bp long, reset_us long, rejected long, "
    "from_us long, to_us long, from_bp long, to_bp long"
)


def value_meters(polled: DataFrame, rollout: DataFrame, within_us: int = 600_000_000) -> DataFrame:
    """Meters that were polled and meters from rollout logs, without rollout meters that a poll lies near."""
    both = polled.withColumn("source", F.lit("poll")).unionByName(rollout.withColumn("source", F.lit("rollout")))
    return prefer_polled(both, within_us)


def value_activity(events: DataFrame, archive: DataFrame) -> DataFrame:
    """Raw events (with ``plan``, null if unknown) and hourly archive rows, which know no plan, in one shape."""
    keys = ["provider", "model", "reasoning_effort", "speed_mode"]
    raw = events.select(
        *keys, "us", F.col("us").alias("end_us"), "plan", F.lit(1).cast("bigint").alias("requests"), F.coalesce("cost_cents", F.lit(0)).cast("bigint").alias("cost_cents"),
        F.col("cost_cents").isNull().cast("bigint").alias("unknown"), "output_tokens", F.lit(False).alias("archived"),
    )
    old = archive.select(
        *keys, F.col("first_us").alias("us"), F.col("last_us").alias("end_us"), F.lit(None).cast("string").alias("plan"), F.col("request_count").alias("requests"), "cost_cents",
        F.col("unpriced").alias("unknown"), "output_tokens", F.lit(True).alias("archived"),
    )
    return raw.unionByName(old)


def quota_scope(quota: Column) -> Column:
    """Which models' requests draw on a quota; null where it is no shared token allowance."""
    return (
        F.when(quota.isin("five_hour", "seven_day", "weekly"), "all").when(quota == "seven_day_sonnet", "sonnet").when(quota == "seven_day_opus", "opus")
        .when(quota.startswith("antigravity_claude_gpt:"), "claude_gpt").when(quota.startswith("antigravity_gemini_pro:"), "gemini").when(quota.startswith("antigravity_gemini_flash:"), "flash")
    )


def model_scopes(model: Column) -> Column:
    """The scopes that a model's requests fall in."""
    m = F.coalesce(model, F.lit(""))
    claude, gemini = m.startswith("claude-"), m.startswith("gemini-")
    named = {"all": F.lit(True), "sonnet": claude & m.contains("sonnet"), "opus": claude & m.contains("opus"), "claude_gpt": claude | m.startswith("gpt-"), "gemini": gemini, "flash": gemini & m.contains("flash")}
    return F.filter(F.array(*[F.when(fits, F.lit(name)) for name, fits in named.items()]), lambda s: s.isNotNull())


def allowance_cycles(meters: DataFrame) -> DataFrame:
    """Intervals (from, to] of rising use by allowance cycle; a cycle without any has one row of null intervals.

    ``meters``: KEY, plan (null or blank: unknown), us, snapshot_id, used_bp, reset_us. Values outside 0 to 100 % are
    skipped. A fall of up to 5 points under the same plan and reset (within a minute, or none on both sides) is rejected
    and counted. A cycle starts at the first meter, at another plan, at any other fall, or where the reset moved by over
    a minute. Until its use is 100 %, an interval closes (later than the last meter) once use is 5 points above the
    anchor, at 100 %, or above it at the last meter of its cycle, which the next meter tells. ``boundary``: first,
    scheduled (the old reset had passed), early_reset, or correction.
    """

    def far(a, b) -> bool:
        return a is not None and b is not None and abs(a - b) > RESET_US

    def walk(rows):
        key = None
        for *own, plan, us, used, reset, has_next, next_plan, next_bp, next_reset in rows:
            if not 0 <= used <= FULL_BP:
                continue
            fresh = own != key
            if not fresh:
                last_us, last_bp, last_reset, last_plan = last
                same_reset = last_reset is None if reset is None else last_reset is not None and not far(reset, last_reset)
                if plan == last_plan and same_reset and 0 < last_bp - used <= REJECT_BP:
                    rejected += 1
                    continue
            if fresh or plan != last_plan or used < last_bp or far(reset, last_reset):
                if key is not None:
                    yield from ((*head, rejected, *i) for i in intervals or [(None, None, None, None)])
                boundary = "first" if fresh else "scheduled" if last_reset is not None and us >= last_reset else "early_reset" if used < last_bp else "correction"
                head = (*own, 0 if fresh else head[3] + 1, plan, boundary, us, used, reset)
                key, anchor, end_bp, rejected, intervals = own, (us, used), used, 0, []
            elif us > last_us and end_bp < FULL_BP:
                ends = not has_next or next_plan != plan or next_bp < used - REJECT_BP or far(next_reset, reset)
                if used - anchor[1] >= LEAST_BP or used >= FULL_BP or (used > anchor[1] and ends):
                    intervals.append((anchor[0], us, anchor[1], used))
                    anchor, end_bp = (us, used), used
            last = us, used, reset, plan
        if key is not None:
            yield from ((*head, rejected, *i) for i in intervals or [(None, None, None, None)])

    plan = F.coalesce("plan", F.lit("")) if "plan" in meters.columns else F.lit("")
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    m = meters.select(*KEY, plan.alias("plan"), "us", "snapshot_id", "used_bp", "reset_us")
    m = m.withColumns({"_has": F.lead("us").over(w).isNotNull(), "_plan": F.lead("plan").over(w), "_bp": F.lead("used_bp").over(w), "_reset": F.lead("reset_us").over(w)})
    ordered = m.sortWithinPartitions(*KEY, "us", "snapshot_id").select(*KEY, "plan", "us", "used_bp", "reset_us", "_has", "_plan", "_bp", "_reset")
    return fold_sorted(ordered, walk, _OUT)


#: Sums of requests, and their types: squares of kinds' numbers can pass 2^63 where there are many kinds.
_SUMS = {n: "bigint" for n in ("rows", "requests", "cents", "unknown", "output", "archived", "model")} | {"model2": "decimal(38,0)"}


def _with_model_number(activity: DataFrame) -> DataFrame:
    """Numbers the kinds of requests (model, effort, speed); of those there are few."""
    kind = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("model", "reasoning_effort", "speed_mode")])
    kinds = activity.select("model", "reasoning_effort", "speed_mode").distinct().withColumn("kind", kind)
    return activity.withColumn("kind", kind).join(kinds.select("kind").distinct().withColumn("number", F.dense_rank().over(Window.orderBy("kind")).cast("bigint")), "kind")


def interval_sums(intervals: DataFrame, activity: DataFrame) -> DataFrame:
    """What matching requests in each interval (from, to] add up to: id columns, and the sums.

    A request matches if its model draws on the quota (P11) and its plan, where both are known, is the meter's. An
    archived hour that begins in the interval and ends after it counts as unknown requests alone; ``taint`` tells that
    an archived hour lies across the interval's start or inside it.

    Sums up to a time are running sums inside ten minutes plus a prefix sum over these, both per provider, scope and plan; an
    interval is the difference of its two ends. So the work grows with meters plus requests, and no task holds more of a
    provider than ten minutes. The kinds of requests are numbered: all are the same if rows times the sum of squared
    numbers is the square of their sum.
    """
    ident = intervals.columns  # the whole interval goes along, so that nothing is joined back to it
    intervals = cut(intervals)  # few next to the meters, and read by four branches
    scoped = intervals.withColumn("scope", quota_scope(F.col("quota_name"))).where("scope IS NOT NULL")
    plans = F.when(F.col("plan") == "", F.array(F.lit("*"))).otherwise(F.array(F.lit("?"), F.concat(F.lit("="), "plan")))
    edges = scoped.withColumn("plan_key", F.explode(plans))
    both_ends = F.array(F.struct(F.col("from_us").alias("us"), F.lit(-1).alias("sign")), F.struct(F.col("to_us").alias("us"), F.lit(1).alias("sign")))
    ends = edges.select(F.struct(*ident).alias("id"), "provider", "scope", "plan_key", F.explode(both_ends).alias("_e")).select("id", "provider", "scope", "plan_key", "_e.*")
    measures = {"rows": F.lit(1), "requests": F.col("requests"), "cents": F.col("cost_cents"), "unknown": F.col("unknown"), "output": F.col("output_tokens"), "archived": F.col("archived").cast("int"), "model": F.col("number"), "model2": F.col("number") * F.col("number")}
    plan = F.coalesce("plan", F.lit(""))
    acts = _with_model_number(activity).select(
        "provider", F.explode(model_scopes(F.col("model"))).alias("scope"), plan.alias("plan"), "us", "end_us", *[v.cast(_SUMS[n]).alias(n) for n, v in measures.items()], F.col("archived").alias("is_archived")
    )
    acts = acts.withColumn("plan_key", F.explode(F.when(F.col("plan") == "", F.array(F.lit("*"), F.lit("?"))).otherwise(F.array(F.lit("*"), F.concat(F.lit("="), "plan")))))
    zero = [F.lit(0).cast(t).alias(n) for n, t in _SUMS.items()]
    points = acts.select("provider", "scope", "plan_key", "us", *_SUMS, F.lit(None).cast(ends.schema["id"].dataType).alias("id"), F.lit(0).alias("sign")).unionByName(ends.select("provider", "scope", "plan_key", "us", *zero, "id", "sign"))
    points = points.withColumn("span", F.expr(f"us DIV {SPAN_US}"))
    group = ["provider", "scope", "plan_key"]
    spans = points.groupBy(*group, "span").agg(*[F.sum(n).cast(t).alias(n) for n, t in _SUMS.items()])
    earlier = Window.partitionBy(*group).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*group, "span", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast(t).alias(f"before_{n}") for n, t in _SUMS.items()])
    inside = Window.partitionBy(*group, "span").orderBy("us", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)
    at = points.withColumns({n: F.sum(n).over(inside).cast(t) for n, t in _SUMS.items()}).where("sign != 0").join(spans, [*group, "span"])
    sums = at.groupBy("id").agg(*[F.sum(F.col("sign") * (F.col(n) + F.col(f"before_{n}"))).cast(t).alias(n) for n, t in _SUMS.items()])

    # archived hours that begin inside and end after: they lie in the hour of the interval's end
    hour = lambda c: F.expr(f"{c} DIV {HOUR_US}")
    old = acts.where("is_archived AND end_us > us").select(*group, hour("us").alias("hour"), F.col("us").alias("a_us"), F.col("end_us").alias("a_end"), *_SUMS)
    late = edges.select(F.struct(*ident).alias("id"), *group, "from_us", "to_us", hour("to_us").alias("hour")).join(old, [*group, "hour"]).where("a_us > from_us AND a_us <= to_us AND a_end > to_us")
    late = late.groupBy("id").agg(*[F.sum(n).cast(t).alias(f"late_{n}") for n, t in _SUMS.items()])
    # archived hours across the start, of any model: the latest end of those that began up to it
    began = activity.where("archived AND end_us > us").select("provider", F.col("us").alias("t"), "end_us", F.lit(None).cast(ends.schema["id"].dataType).alias("id"), F.lit(0).alias("side"))
    starts = intervals.select("provider", F.col("from_us").alias("t"), F.lit(None).cast("bigint").alias("end_us"), F.struct(*ident).alias("id"), F.lit(1).alias("side"))
    both = began.unionByName(starts).withColumn("hour", hour("t"))
    upto = Window.partitionBy("provider", "hour").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    across = both.withColumn("_end", F.max("end_us").over(upto)).where("side = 1").select("id", F.coalesce(F.col("_end") > F.col("t"), F.lit(False)).alias("across"))

    none = {n: F.lit(None).cast(t) for n, t in _SUMS.items()}
    parts = [
        sums.select("id", *[F.col(n) for n in _SUMS], *[none[n].alias(f"late_{n}") for n in _SUMS], F.lit(None).cast("boolean").alias("across")),
        late.select("id", *[none[n].alias(n) for n in _SUMS], *[F.col(f"late_{n}") for n in _SUMS], F.lit(None).cast("boolean").alias("across")),
        across.select("id", *[none[n].alias(n) for n in _SUMS], *[none[n].alias(f"late_{n}") for n in _SUMS], "across"),
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for n, t in _SUMS.items() for c in (n, f"late_{n}")], F.coalesce(F.max("across"), F.lit(False)).alias("across")
    )
    n = lambda c: F.col(c) - F.col(f"late_{c}")
    return found.select(
        "id.*", n("requests").alias("requests"), n("cents").alias("cents"), n("output").alias("output"), (n("unknown") + F.col("late_requests")).alias("unknown"), (F.col("across") | (n("archived") > 0)).alias("taint"),
        (n("rows").cast("decimal(19,0)") * n("model2") == n("model").cast("decimal(19,0)") * n("model")).alias("one_kind"), F.when(n("rows") > 0, F.expr("(model - late_model) DIV (rows - late_rows)")).alias("number"),
    )


def subscription_value(meters: DataFrame, activity: DataFrame, multiplier: float = 0.0, plan_type: str = "") -> DataFrame:
    """Per allowance cycle what its points cost, and what a whole allowance does.

    per100_cents only for cycles of 5 points or more with a cost, no unknown price, no interval without any request
    (their points are ``unmatched_bp``) and no archived hour in or across an interval; low and high take the meter's
    rounding of one point either way; x1 divides by the profile's multiplier where its plan is the cycle's or either is
    unknown. complete: from 1 % or less to 99 % or more, without any of these faults. Of cycles without an interval only
    the newest of a quota stays.
    """
    iv = allowance_cycles(meters)
    sums = interval_sums(iv.where("to_us IS NOT NULL"), activity).withColumn("points", F.col("to_bp") - F.col("from_bp"))
    head = [*KEY, "cycle", "plan", "boundary", "start_us", "start_bp", "reset_us", "rejected"]
    some = sums.groupBy(*head).agg(
        F.max("to_us").alias("end_us"), F.max("to_bp").alias("end_bp"), F.sum("cents").alias("cost_cents"), F.sum("requests").alias("requests"), F.sum("unknown").alias("unknown"),
        F.coalesce(F.sum(F.when(F.col("requests") == 0, F.col("points"))), F.lit(0)).alias("unmatched_bp"), F.max("taint").alias("archive_timing"),
    )
    none = iv.where("to_us IS NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("cycle")))).where("_n = 1")
    zero = lambda c: F.lit(0).cast("bigint").alias(c)
    none = none.select(*head, F.col("start_us").alias("end_us"), F.col("start_bp").alias("end_bp"), *map(zero, ("cost_cents", "requests", "unknown", "unmatched_bp")), F.lit(False).alias("archive_timing"))
    a = some.unionByName(none).withColumn("used_bp", F.col("end_bp") - F.col("start_bp"))
    clean = (F.col("unknown") == 0) & (F.col("unmatched_bp") == 0) & ~F.col("archive_timing") & (F.col("cost_cents") > 0)
    known = clean & (F.col("used_bp") >= LEAST_BP)
    whole = lambda of: F.when(known, F.round(F.col("cost_cents") * float(FULL_BP) / of, 4))
    used = F.col("used_bp")
    plans_agree = F.lit(plan_type == "") | (F.col("plan") == "") | (F.col("plan") == plan_type)
    a = a.withColumns({"per100_cents": whole(used), "low_cents": whole(F.least(F.lit(FULL_BP), used + 100)), "high_cents": whole(F.greatest(F.lit(100), used - 100)), "complete": clean & (F.col("start_bp") <= 100) & (F.col("end_bp") >= 9900)})
    x1 = F.when(plans_agree, F.round(F.col("per100_cents") / multiplier, 4)) if multiplier > 0 else F.lit(None).cast("double")
    return a.withColumn("x1_cents", x1)


def model_calibration(meters: DataFrame, activity: DataFrame) -> DataFrame:
    """Per kind of request (model, effort, speed), what weekly intervals of 5 points or more cost in which all requests
    were of that kind, priced, and not archived; per100_cents and output tokens a point."""
    iv = allowance_cycles(meters).where("to_us IS NOT NULL")
    weekly = F.col("quota_name").isin(*WEEKLY) | F.col("quota_name").endswith(WEEKLY_TAIL)
    iv = iv.where(weekly & (F.col("to_bp") - F.col("from_bp") >= LEAST_BP))
    kinds = _with_model_number(activity).select("number", "model", "reasoning_effort", "speed_mode").distinct()
    own = interval_sums(iv, activity).where("one_kind AND unknown = 0 AND requests > 0 AND NOT taint").join(kinds, "number")
    a = own.groupBy("model", "reasoning_effort", "speed_mode").agg(F.sum(F.col("to_bp") - F.col("from_bp")).alias("quota_bp"), F.sum("cents").alias("matched_cents"), F.sum("output").alias("matched_output"))
    return a.withColumns({"per100_cents": F.round(F.col("matched_cents") * float(FULL_BP) / F.col("quota_bp"), 4), "output_per_point": F.round(F.col("matched_output") * 100.0 / F.col("quota_bp"), 4)})
