"""Quota samples: latest values, series, carried values, down-sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["provider", "account_id", "quota_name"]


def in_range(rows: DataFrame, start_us: int, end_us: int, newest: int | None = None) -> DataFrame:
    """Rows of the half-open [start, end); with ``newest``, only so many of the latest (ties by id)."""
    rows = rows.where((F.col("us") >= start_us) & (F.col("us") < end_us))
    return rows if newest is None else rows.orderBy(F.desc("us"), F.desc("snapshot_id")).limit(newest)


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """The newest sample of each provider and account, by time and then id; no theta anti join, one aggregate."""
    rest = [c for c in rows.columns if c not in ("provider", "account_id")]
    best = F.max_by(F.struct(*rest), F.struct("us", "snapshot_id")).alias("best")
    return rows.groupBy("provider", "account_id").agg(best).select("provider", "account_id", "best.*")


def latest_per_quota(rows: DataFrame, last_ids: int | None = None) -> DataFrame:
    """L4: the newest sample of each quota; with ``last_ids``, among each provider's ids within that distance of its newest.

    The bound is the feature: a quota that the last snapshots no longer name is not current.
    """
    if last_ids is not None:
        newest = rows.groupBy("provider").agg(F.max("snapshot_id").alias("_newest"))
        rows = rows.join(newest, "provider").where(F.col("snapshot_id") >= F.col("_newest") - last_ids).drop("_newest")
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("us", "snapshot_id")).alias("best")).select(*KEY, "best.*")


def utilization_series(headers: DataFrame, values: DataFrame, how: str = "inner") -> DataFrame:
    """Snapshot headers with their quota values."""
    return headers.join(values, "snapshot_id", how)


def with_values(headers: DataFrame, values: DataFrame) -> DataFrame:
    """Headers that have at least one value."""
    return headers.join(values, "snapshot_id", "left_semi")


def logging_history(rows: DataFrame) -> DataFrame:
    """Change of each quota since its own previous sample; a snapshot without the quota does not count."""
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    return rows.select(*KEY, "snapshot_id", "us", "used_bp", (F.col("used_bp") - F.lag("used_bp").over(w)).alias("delta_bp"))


def carry_forward(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per provider and account and sample, the last known value of every named quota (null before its first)."""
    w = Window.partitionBy("provider", "account_id").orderBy("us", "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    known = [F.last(F.when(F.col("quota_name") == n, F.col("used_bp")), ignorenulls=True).over(w).alias(n) for n in names]
    return rows.select("provider", "account_id", "snapshot_id", "us", *known)


def range_sampled(rows: DataFrame, points: int) -> DataFrame:
    """At most about ``points`` snapshots of each provider, evenly over time, preferring those in which a quota fell.

    Bucket of a snapshot: (t - t0) * (points - 1) div (t1 - t0) in whole microseconds. The first and last buckets give the
    first and last snapshot, each other its newest snapshot with a fall, else its newest; few snapshots stay all.
    """
    per_quota = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    fell = rows.select("provider", "snapshot_id", "us", (F.col("used_bp") < F.lag("used_bp").over(per_quota)).alias("_fell"))
    snaps = fell.groupBy("provider", "snapshot_id", "us").agg(F.max(F.coalesce("_fell", F.lit(False))).alias("is_reset"))
    ends = snaps.groupBy("provider").agg(
        F.min("us").alias("_t0"), F.max("us").alias("_t1"), F.count("*").alias("_n"), F.min_by("snapshot_id", F.struct("us", "snapshot_id")).alias("_first"), F.max_by("snapshot_id", F.struct("us", "snapshot_id")).alias("_last")
    )
    bucket = F.least(F.lit(points - 1).cast("bigint"), F.expr(f"(us - _t0) * {points - 1} DIV greatest(_t1 - _t0, 1)"))
    snaps = snaps.join(ends, "provider").withColumn("bucket", bucket)
    best = snaps.groupBy("provider", "bucket").agg(F.max_by("snapshot_id", F.struct("is_reset", "us", "snapshot_id")).alias("_best"))
    snaps = snaps.join(best, ["provider", "bucket"])
    inner = (F.col("bucket") > 0) & (F.col("bucket") < points - 1) & (F.col("snapshot_id") == F.col("_best"))
    stays = (F.col("_n") <= points) | (F.col("snapshot_id") == F.col("_first")) | (F.col("snapshot_id") == F.col("_last")) | inner
    return snaps.where(stays).select("provider", "snapshot_id", "us", "bucket", "is_reset")


def _numbered(rows: DataFrame) -> DataFrame:
    """Numbers a provider's rows (_i, from 1, of _n) by time and id: a place in ten minutes, and the rows of all before.

    The windows over rows see ten minutes of a provider, those over providers one row for these, so that no task sorts a provider.
    """
    rows = rows.withColumn("_span", F.expr("us DIV 600000000"))
    spans = rows.groupBy("provider", "_span").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy("provider")
    spans = spans.select("provider", "_span", F.coalesce(F.sum("_rows").over(whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("provider", "_span").orderBy("us", "snapshot_id"))
    return rows.join(spans, ["provider", "_span"]).withColumn("_i", F.col("_before") + inside).drop("_span", "_before")


def rank_sampled(rows: DataFrame, points: int) -> DataFrame:
    """Row 1, and rows at which (i - 1) * (points - 1) div (n - 1) grows."""
    names = rows.columns
    rows = _numbered(rows)
    step = "({i} * %d) DIV greatest(_n - 1, 1)" % (points - 1)
    grows = F.expr(f"_i = 1 OR _n <= {points} OR {step.format(i='(_i - 1)')} > {step.format(i='(_i - 2)')}")
    return rows.where(grows).select(*names)


def stride(rows: DataFrame, most: int = 500) -> DataFrame:
    """Every ceil(n / most)-th row, and the last."""
    names = rows.columns
    return _numbered(rows).where(F.expr(f"(_i - 1) % greatest(1, ceil(_n / {most})) = 0 OR _i = _n")).select(*names)
