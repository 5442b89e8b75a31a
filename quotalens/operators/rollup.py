"""Usage rollups over raw events and their hourly archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS = ["input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "output_tokens", "reasoning_output_tokens"]
DIMENSIONS = ["integration_name", "provider", "account_name", "model", "reasoning_effort", "mode", "speed_mode"]
HOUR_US = 3_600_000_000


def measures() -> list[Column]:
    """The token measure vector: requests, token sums, known cost (null cost counts 0) and requests without one."""
    return [
        F.count("*").alias("request_count"),
        *[F.sum(t).alias(t) for t in TOKENS],
        F.coalesce(F.sum("cost_cents"), F.lit(0)).cast("bigint").alias("cost_cents"),
        F.count_if(F.col("cost_cents").isNull()).alias("unpriced"),
    ]


def remeasures() -> list[Column]:
    """The same vector summed again from rows that already are aggregates."""
    return [F.sum(c).cast("bigint").alias(c) for c in ["request_count", *TOKENS, "cost_cents", "unpriced"]]


def usage_summary(events: DataFrame) -> DataFrame:
    """A1: by integration, provider, account and model, with the last capture."""
    return events.groupBy("integration_name", "provider", "account_name", "model").agg(*measures(), F.max("us").alias("last_us"))


def compact_hourly(events: DataFrame) -> DataFrame:
    """Hour and all dimensions, with the first and last capture; one shuffle on partial sums. See ``reconciled``."""
    hour = (F.col("us") - F.pmod("us", F.lit(HOUR_US))).alias("hour_us")
    return events.groupBy(hour, *DIMENSIONS).agg(*measures(), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def with_archive(events: DataFrame, archive: DataFrame) -> DataFrame:
    """Raw events in the shape of the archive, united with it; sums over either half can be added up."""
    raw = events.select(*DIMENSIONS, F.col("us").alias("first_us"), F.col("us").alias("last_us"), F.lit(1).cast("bigint").alias("request_count"), *TOKENS,
                        F.coalesce("cost_cents", F.lit(0)).cast("bigint").alias("cost_cents"), F.col("cost_cents").isNull().cast("bigint").alias("unpriced"))
    return raw.unionByName(archive.select(raw.columns))


def reconciled(events: DataFrame, archive: DataFrame) -> DataFrame:
    """Per integration, whether the archive adds up to the events it stands for; events may be deleted only where it does."""
    sums = remeasures()
    raw = with_archive(events, archive.where("false")).groupBy("integration_name").agg(*sums)
    old = archive.groupBy("integration_name").agg(*sums)
    names = ["request_count", *TOKENS, "cost_cents", "unpriced"]
    both = raw.alias("r").join(old.alias("o"), F.expr("r.integration_name <=> o.integration_name"), "full")
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"o.{n}")) for n in names]
    return both.select(F.coalesce("r.integration_name", "o.integration_name").alias("integration_name"), F.coalesce("r.request_count", F.lit(0)).alias("events"), F.coalesce("o.request_count", F.lit(0)).alias("archived"), F.least(*same).alias("adds_up"))


def effort_summary(united: DataFrame) -> DataFrame:
    """A2: as A1, with effort, mode and speed, over raw and archive."""
    return united.groupBy(*DIMENSIONS).agg(*remeasures(), F.max("last_us").alias("last_us"))


def in_range(united: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """An archived hour counts if it overlaps [start, end): its edges can overcount, as the archive has no finer grain."""
    return united.where((F.col("first_us") < end_us) & (F.col("last_us") >= start_us))


def effort_totals(united: DataFrame, start_us: int, end_us: int, integration: str | None = None) -> DataFrame:
    """A3."""
    rows = in_range(united, start_us, end_us)
    if integration is not None:
        rows = rows.where(F.col("integration_name") == integration)
    return rows.groupBy(*DIMENSIONS).agg(*remeasures())


def usage_totals(united: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Range totals per integration."""
    return in_range(united, start_us, end_us).groupBy("integration_name").agg(*remeasures())


def bucket_seconds(range_seconds: int) -> int:
    """Bucket size by range."""
    for most, size in ((3_600, 60), (6 * 3_600, 300), (86_400, 900), (7 * 86_400, 3_600)):
        if range_seconds <= most:
            return size
    return 6 * 3_600


def usage_buckets(events: DataFrame, seconds: int) -> DataFrame:
    """A4: epoch-aligned buckets per integration."""
    size = seconds * 1_000_000
    return events.groupBy("integration_name", (F.col("us") - F.pmod("us", F.lit(size))).alias("bucket_us")).agg(*measures())


def usage_sessions(events: DataFrame) -> DataFrame:
    """A5: by integration, session (else source path) and UTC day; the coalesced key is the group, so empty ids do not merge."""
    session = F.coalesce(F.nullif(F.col("session_id"), F.lit("")), F.nullif(F.col("source_path"), F.lit("")), F.lit("unknown"))
    day = F.floor(F.col("us") / F.lit(86_400_000_000)).cast("bigint")
    return events.groupBy("integration_name", session.alias("session"), day.alias("day")).agg(*measures(), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def usage_hierarchy(events: DataFrame) -> DataFrame:
    """Integration, provider, account and model with subtotals of each level; level is the number of keys rolled up."""
    keys = ["integration_name", "provider", "account_name", "model"]
    return events.rollup(*keys).agg(F.grouping_id().cast("bigint").alias("level"), *measures())


def usage_tree(events: DataFrame) -> DataFrame:
    """A8 nested: an integration a row, with its measures and its providers; these hold their accounts, and these their models, by name.

    Built from the models upwards: each level sums the one below, which it holds as an array of structs, so the events are aggregated
    once and each array is as long as there are names. Every level has its measures and its last capture.
    """
    keys, inner = ["integration_name", "provider", "account_name", "model"], ["providers", "accounts", "models"]
    level = events.groupBy(*keys).agg(*measures(), F.max("us").alias("last_us"))
    for depth in (3, 2, 1):
        held = [keys[depth], *[c for c in level.columns if c not in keys]]
        level = level.groupBy(*keys[:depth]).agg(*remeasures(), F.max("last_us").alias("last_us"), F.sort_array(F.collect_list(F.struct(*held))).alias(inner[depth - 1]))
    return level


def usage_cumulative(buckets: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Running cost and output tokens per integration over its buckets.

    With ``totals`` (A6, per integration), its last bucket shows the range's totals, which count what buckets leave out,
    as archived hours across the edges; an integration without totals keeps its sums.
    """
    order = Window.partitionBy("integration_name").orderBy("bucket_us")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    made = buckets.select("integration_name", "bucket_us", F.sum("cost_cents").over(w).alias("cum_cost_cents"), F.sum("output_tokens").over(w).alias("cum_output_tokens"), F.lead("bucket_us").over(order).isNull().alias("_last"))
    if totals is None:
        return made.drop("_last")
    t = totals.select("integration_name", F.col("cost_cents").alias("_cost"), F.col("output_tokens").alias("_tokens"))
    made = made.join(t, "integration_name", "left")
    of = lambda total, own: F.when(F.col("_last"), F.coalesce(total, own)).otherwise(F.col(own)).alias(own)
    return made.select("integration_name", "bucket_us", of("_cost", "cum_cost_cents"), of("_tokens", "cum_output_tokens"))
