"""Alerts and metrics from quota samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boundaries import reset_boundaries
from .folds import fold_sorted
from .samples import KEY

WEEK_US = 7 * 86_400_000_000


def threshold_alerts(rows: DataFrame, warning_bp: int = 8000, critical_bp: int = 9500, overrides: DataFrame | None = None) -> DataFrame:
    """Warning and critical once a cycle, critical also after warning; a reset boundary clears both.

    ``overrides`` (provider, quota_name, warning, critical, quota_limit): own thresholds of a quota, in percent, or where
    quota_limit is given in its unit; a null one leaves the common threshold.
    """
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    rows = reset_boundaries(rows).withColumn("segment", F.sum(F.col("is_boundary").cast("bigint")).over(w))
    warning, critical = F.lit(warning_bp), F.lit(critical_bp)
    if overrides is not None:
        of = lambda c: F.when(F.col("quota_limit") > 0, F.col(c) * 10000.0 / F.col("quota_limit")).otherwise(F.col(c) * 100.0)
        rows = rows.join(overrides.select("provider", "quota_name", of("warning").alias("_w"), of("critical").alias("_c")), ["provider", "quota_name"], "left")
        warning, critical = F.coalesce("_w", warning), F.coalesce("_c", critical)
    rows = rows.withColumn("_level", F.when(F.col("used_bp") >= critical, 2).when(F.col("used_bp") >= warning, 1).otherwise(0))
    before = Window.partitionBy(*KEY, "segment").orderBy("us", "snapshot_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_sent", F.coalesce(F.max("_level").over(before), F.lit(0))).where("_level > _sent")
    return rows.select(*KEY, "segment", "snapshot_id", "us", F.when(F.col("_level") == 2, "critical").otherwise("warning").alias("alert"))


def reset_alerts(rows: DataFrame, cooldown_us: int = 30 * 60_000_000) -> DataFrame:
    """Reset boundaries that are told, none within ``cooldown_us`` of the last one told of its quota."""

    def walk(boundaries):
        key, told = None, None
        for *own, snapshot, us in boundaries:
            if own != key or us - told >= cooldown_us:
                key, told = own, us
                yield *own, snapshot, us

    found = reset_boundaries(rows).where("is_boundary").select(*KEY, "snapshot_id", "us")
    ordered = found.repartition(*KEY).sortWithinPartitions(*KEY, "us", "snapshot_id")
    return fold_sorted(ordered, walk, "provider string, account_id long, quota_name string, snapshot_id long, us long")


def pace_alerts(rows: DataFrame, fires_bp: int = 1500, clears_bp: int = 1000, again_bp: int = 1000) -> DataFrame:
    """Fires when use is so far over an even pace, again at each further ``again_bp``, and is armed anew below ``clears_bp``.

    Whether a sample fires depends on the last one that did, so sorted rows are walked with one number of state.
    """
    week = rows.where(F.col("quota_name").startswith("seven_day") & (F.col("reset_us") > F.col("us")) & (F.col("reset_us") - F.col("us") <= WEEK_US))
    week = week.select(*KEY, "snapshot_id", "us", F.expr(f"used_bp - 10000 + (reset_us - us) * 10000 DIV {WEEK_US}").alias("over_bp"))

    def walk(rows):
        key, sent = None, None
        for *own, snapshot, us, over in rows:
            if own != key:
                key, sent = own, None
            fire = over >= fires_bp and (sent is None or over >= sent + again_bp)
            sent = over if fire else None if over < clears_bp else sent
            if fire:
                yield *own, snapshot, us, over

    ordered = week.repartition(*KEY).sortWithinPartitions(*KEY, "us", "snapshot_id")
    return fold_sorted(ordered, walk, "provider string, account_id long, quota_name string, snapshot_id long, us long, over_bp long")


def missed_polls(rows: DataFrame, now_us: int, interval_us: int, grace_us: int) -> DataFrame:
    """Whole intervals missed since the deadline (last sample + interval + grace), the first counting when it has come."""
    last = rows.where(F.col("us") <= now_us).groupBy("provider", "account_id").agg(F.max("us").alias("last_us"))
    over = f"{now_us} - last_us - {interval_us} - {grace_us}"
    return last.withColumn("missed", F.expr(f"CASE WHEN {over} >= 0 THEN 1 + ({over}) DIV {interval_us} ELSE 0L END"))


def quiet_weekly(rows: DataFrame, below_bp: int = 5000) -> DataFrame:
    """Once a weekly cycle, the first sample past its middle with less than half used."""
    half = rows.where(F.col("quota_name").startswith("seven_day") & (F.col("reset_us") > F.col("us")) & (F.col("reset_us") - F.col("us") <= WEEK_US // 2) & (F.col("used_bp") < below_bp))
    return half.groupBy(*KEY, "reset_us").agg(F.min_by(F.struct("snapshot_id", "us", "used_bp"), F.struct("us", "snapshot_id")).alias("e")).select(*KEY, "reset_us", "e.*")


#: Labels of a metric's row; those that a metric does not have are null.
LABELS = ["provider", "account_id", "quota_name", "integration", "unit", "reason", "name"]


def _metric(df: DataFrame, metric: str, value: Column, **labels: str) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), *[(F.col(labels[x]) if x in labels else F.lit(None)).cast("string").alias(x) for x in LABELS], value.cast("double").alias("value")).where("value IS NOT NULL")


def metrics_long(
    latest: DataFrame, now_us: int, stale_us: int, polls: DataFrame | None = None, events: DataFrame | None = None, credits: DataFrame | None = None,
    accounts: DataFrame | None = None, errors: DataFrame | None = None, version: str | None = None,
) -> DataFrame:
    """Every gauge and counter as rows (metric, labels, value); unknown values give no row, tables not given no metric.

    latest: newest sample of each quota (use and reset time; by account the age of its newest sample, and whether that is
    at most ``stale_us``, twice the poll interval). polls (provider, account_id, failed, reason): cycles that completed or failed.
    events (usage): requests and dollars by integration. credits (provider, account_id, unit, balance). accounts (provider,
    account_id, account_name). errors (provider, error_type): failures of this collection itself. version: of the build.
    """
    quota, poller = {"provider": "provider", "account_id": "account_id", "quota_name": "quota_name"}, {"provider": "provider", "account_id": "account_id"}
    newest = latest.groupBy("provider", "account_id").agg(F.max("us").alias("us"))
    age = F.lit(now_us) - F.col("us")
    parts = [
        _metric(latest, "quota_utilization_percent", F.col("used_bp") / 100.0, **quota), _metric(latest, "quota_reset_timestamp_seconds", F.col("reset_us") / 1e6, **quota),
        _metric(newest, "agent_last_cycle_age_seconds", age / 1e6, **poller), _metric(newest, "agent_healthy", F.when(age > stale_us, 0).otherwise(1), **poller),
    ]
    if polls is not None:
        done = polls.groupBy("provider", "account_id").agg(F.count_if(~F.col("failed")).alias("n"))
        lost = polls.where("failed").groupBy("provider", "account_id", "reason").agg(F.count("*").alias("n"))
        parts += [_metric(done, "cycles_completed_total", F.col("n"), **poller), _metric(lost, "cycles_failed_total", F.col("n"), reason="reason", **poller)]
    if events is not None:
        used = events.groupBy("integration_name").agg(F.count("*").alias("n"), F.coalesce(F.sum("cost_cents"), F.lit(0)).alias("cents"))
        parts += [_metric(used, "api_integration_requests", F.col("n"), integration="integration_name"), _metric(used, "api_integration_spend_usd", F.col("cents") / 100.0, integration="integration_name")]
    if credits is not None:
        parts.append(_metric(credits, "credits_balance", F.col("balance"), unit="unit", **poller))
    if accounts is not None:
        parts.append(_metric(accounts, "account_info", F.lit(1), name="account_name", **poller))
    if errors is not None:
        parts.append(_metric(errors.groupBy("provider", "error_type").agg(F.count("*").alias("n")), "scrape_errors_total", F.col("n"), provider="provider", reason="error_type"))
    if version is not None:
        parts.append(_metric(latest.sparkSession.range(1).withColumn("_v", F.lit(version)), "build_info", F.lit(1), name="_v"))
    return reduce(DataFrame.unionByName, parts)
