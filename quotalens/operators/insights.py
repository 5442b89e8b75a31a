"""Insights, display forms, account and report aggregates, retention and transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folds import fold_sorted
from .samples import KEY

HOUR_US, DAY_US, MINUTE_US = 3_600_000_000, 86_400_000_000, 60_000_000
RANGES = {"1h": HOUR_US, "6h": 6 * HOUR_US, "24h": DAY_US, "1d": DAY_US, "7d": 7 * DAY_US, "30d": 30 * DAY_US}
LIMIT_YEARS_US = 100 * 366 * DAY_US


def named_range(name: str | None, now_us: int, default: str = "6h") -> tuple[int | None, int]:
    """(start, end) of a named range; "all" has no start, an unknown name is an error."""
    if name == "all":
        return None, now_us
    if (name or default) not in RANGES:
        raise ValueError(f"unknown range {name!r}")
    return now_us - RANGES[name or default], now_us


def explicit_range(start_us: int | None, end_us: int | None) -> tuple[int, int]:
    """Both ends, in order, at most a hundred years apart."""
    if start_us is None or end_us is None or start_us >= end_us or end_us - start_us > LIMIT_YEARS_US:
        raise ValueError("a range needs a start before its end, at most 100 years apart")
    return start_us, end_us


def display_mode(rows: DataFrame, mode: str) -> DataFrame:
    """Use as it is, or what is available."""
    return rows.withColumn("shown_bp", F.col("used_bp") if mode == "usage" else F.greatest(10000 - F.col("used_bp"), F.lit(0)))


def normalize_plan(rows: DataFrame, free: Column) -> DataFrame:
    """On the free plan the five-hour quota is the weekly one; where both are there the higher use stays, later on ties."""
    rows = rows.withColumn("quota_name", F.when(free & (F.col("quota_name") == "five_hour"), "seven_day").otherwise(F.col("quota_name")))
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("used_bp", "us", "snapshot_id")).alias("e")).select(*KEY, "e.*")


def duplicate_accounts(accounts: DataFrame) -> DataFrame:
    """External ids with several accounts, and the one that survives: an active one first, then the smallest id."""
    a = accounts.groupBy("external_id").agg(F.count("*").alias("n"), F.min_by("account_id", F.struct("is_deleted", "account_id")).alias("survivor"))
    return a.where("n > 1")


def logical_groups(rows: DataFrame) -> DataFrame:
    """Per group and window the scarcest member (on ties the latest reset), any exhausted; then each group's tightest window."""
    left = 10000 - F.col("used_bp")
    a = rows.groupBy("provider", "account_id", "window_kind").agg(
        F.min(left).alias("left_bp"), F.min_by("reset_us", F.struct(left, -F.coalesce("reset_us", F.lit(0)))).alias("reset_us"), F.max(left <= 0).alias("exhausted")
    )
    rank = F.struct("left_bp", F.when(F.col("window_kind") == "weekly", 0).otherwise(1), "window_kind")
    return a.groupBy("provider", "account_id").agg(F.min_by(F.struct("window_kind", "left_bp", "reset_us"), rank).alias("e"), F.max("exhausted").alias("exhausted")).select("provider", "account_id", "e.*", "exhausted")


def window_kind(rows: DataFrame) -> DataFrame:
    """F16: no reset: unknown; over six hours ahead: weekly; else five_hour."""
    return rows.withColumn("window_kind", F.when(F.col("reset_us").isNull(), "unknown").when(F.col("reset_us") - F.col("us") > 6 * HOUR_US, "weekly").otherwise("five_hour"))


def compact_number(n: Column) -> Column:
    """1.2K, 3.4M, 5.6B; below a thousand as it is."""
    short = lambda d, s: F.concat(F.format_string("%.1f", F.floor(n * 10 / d) / 10.0), F.lit(s))
    return F.when(n >= 1_000_000_000, short(1_000_000_000, "B")).when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1_000, short(1_000, "K")).otherwise(n.cast("string"))


def duration(us: Column) -> Column:
    """2d 3h, 4h 5m, 6m, or now."""
    m = F.floor(us / MINUTE_US)
    d, h, r = F.floor(m / 1440), F.floor(m / 60) % 24, m % 60
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x + " "), b.cast("string"), F.lit(y))
    return F.when(m < 1, "now").when(d >= 1, two(d, "d", h, "h")).when(h >= 1, two(h, "h", r, "m")).otherwise(F.concat(r.cast("string"), F.lit("m")))


def formatted(events: DataFrame) -> DataFrame:
    return events.select("event_id", compact_number(F.col("output_tokens") * 977).alias("tokens"), duration(F.col("output_tokens") * 37 * MINUTE_US).alias("time"))


def active_first(cycles: DataFrame, limit: int) -> DataFrame:
    """Of each key the open cycle, then the newest, ``limit`` in all."""
    w = Window.partitionBy(*KEY).orderBy((~F.col("is_open")).cast("int"), F.desc("start_us"))
    return cycles.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= limit).select(*KEY, "start_us", "is_open", "place")


def trim_empty(cycles: DataFrame) -> DataFrame:
    """Cycles without use go, but for the newest of each key."""
    w = Window.partitionBy(*KEY).orderBy((F.col("delta_bp") > 0).cast("int"), F.desc("start_us"))
    return cycles.withColumn("_n", F.row_number().over(w)).where((F.col("delta_bp") > 0) | (F.col("_n") == 1)).select(*KEY, "start_us", "delta_bp")


def device_class(path: Column) -> Column:
    """What kind of machine a source path comes from. The names are fixed values."""
    p = F.coalesce(path, F.lit(""))
    return (
        F.when(p.contains("/Users/"), "macOS source").when(p.contains(":\\") | p.contains(":/"), "Windows source")
        .when(p.startswith("device:") | p.startswith("import:"), "Imported source").otherwise("Other / unknown source")
    )


def report_totals(united: DataFrame) -> DataFrame:
    """Cost, requests, unknown prices and archived requests for the report as a whole, by model with effort and speed,
    and by device class (P12), each kind by falling cost (L9).

    ``united``: model, reasoning_effort, speed_mode, source_path, request_count, cost_cents, unpriced, archived.
    """
    keyed = united.withColumn("_k", F.explode(F.array(
        F.struct(F.lit("report").alias("kind"), F.lit("").alias("name")),
        F.struct(F.lit("model").alias("kind"), F.concat_ws("|", "model", "reasoning_effort", "speed_mode").alias("name")),
        F.struct(F.lit("device").alias("kind"), device_class(F.col("source_path")).alias("name")),
    )))
    a = keyed.groupBy("_k.kind", "_k.name").agg(
        F.sum("cost_cents").cast("bigint").alias("cost_cents"), F.sum("request_count").cast("bigint").alias("requests"), F.sum("unpriced").cast("bigint").alias("unknown"),
        F.sum(F.when(F.col("archived"), F.col("request_count")).otherwise(0)).cast("bigint").alias("archived"),
    )
    return a.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("cost_cents"), "name")).cast("bigint"))


def burn_insights(rates: DataFrame) -> DataFrame:
    """Ladder of burn rates: none known, idle, runs out before the reset, over 80 % at the reset (of cursor also just
    80 %), or safe."""
    high = F.when(F.col("provider") == "cursor", F.col("projected_bp") >= 8000).otherwise(F.col("projected_bp") > 8000)
    level = (
        F.when(F.col("rate").isNull(), "analysing").when(F.col("rate") < 1, "idle").when(F.coalesce("exhausts_first", F.lit(False)), "negative")
        .when(high, "warning").otherwise("positive")
    )
    return rates.select(*KEY, level.alias("insight"))


def cycle_rate(cycles: DataFrame, now_us: int) -> DataFrame:
    """The open cycle's change an hour once it is half an hour old and has risen, and the use it leads to at its reset
    (at most 100 %); an unknown rate or reset leaves that unknown."""
    open_ = cycles.where("is_open")
    age = F.lit(now_us) - F.col("start_us")
    rate = F.when((age >= 30 * MINUTE_US) & (F.col("delta_bp") > 0), F.col("delta_bp") * float(HOUR_US) / age)
    left = F.when(F.col("reset_us").isNotNull(), F.greatest(F.col("reset_us") - now_us, F.lit(0)) / float(HOUR_US))
    reached = F.col("peak_bp") + rate * left
    return open_.select(*KEY, F.round(rate, 6).alias("rate"), F.round(F.when(reached > 10000, 10000.0).otherwise(reached), 4).alias("projected_bp"))


def variance_insight(cycles: DataFrame) -> DataFrame:
    """Peak against average of completed cycles (three or more): over 50 % above is spiky, over 10 % uneven, else steady."""
    a = cycles.where(~F.col("is_open")).groupBy("provider", "quota_name").agg(F.count("*").alias("n"), F.round(F.avg("peak_bp"), 6).alias("avg_bp"), F.max("peak_bp").alias("max_bp"))
    a = a.where((F.col("n") >= 3) & (F.col("avg_bp") > 100))
    over = F.round((F.col("max_bp") - F.col("avg_bp")) * 100 / F.col("avg_bp"), 4)
    return a.select("provider", "quota_name", "n", over.alias("over_percent"), F.when(over > 50, "spiky").when(over > 10, "uneven").otherwise("steady").alias("insight"))


def underuse_slots(rows: DataFrame, hours: tuple[int, ...] = (10, 22), reach_us: int = 90 * MINUTE_US, below_bp: int = 3000) -> DataFrame:
    """Low use within 90 minutes of a daily hour (UTC), once a slot and key."""
    found = rows.where(F.col("used_bp") < below_bp).withColumn("_slot", F.explode(F.array(*[
        F.floor((F.col("us") - h * HOUR_US + DAY_US // 2) / DAY_US).cast("bigint") * DAY_US + h * HOUR_US for h in hours
    ]))).where(F.abs(F.col("us") - F.col("_slot")) <= reach_us)
    return found.groupBy(*KEY, F.col("_slot").alias("slot_us")).agg(F.min_by("snapshot_id", F.struct("us", "snapshot_id")).alias("snapshot_id"))


def poll_failures(polls: DataFrame, threshold: int = 3, min_outage_us: int = 0, repeat_us: int = 6 * HOUR_US) -> DataFrame:
    """Alerts for runs of failed polls per poller: at the first failure that makes ``threshold`` (below 2: 3) of them and lies
    ``min_outage_us`` after the run's first, and again at failures ``repeat_us`` after the last alert. A poll that succeeds ends
    the run. An alert counts as delivered. Each task walks its sorted polls with one run of state."""
    threshold = threshold if threshold >= 2 else 3

    def walk(rows):
        key = None
        for *own, snapshot, us, failed in rows:
            if own != key:
                key, run, first, sent = own, 0, None, None
            if not failed:
                run, first, sent = 0, None, None
                continue
            run, first = run + 1, us if first is None else first
            if run >= threshold and us - first >= min_outage_us and (sent is None or us - sent >= repeat_us):
                sent = us
                yield *own, snapshot, us, run

    keys = ["provider", "account_id"]
    ordered = polls.select(*keys, "snapshot_id", "us", "failed").repartition(*keys).sortWithinPartitions(*keys, "us", "snapshot_id")
    return fold_sorted(ordered, walk, "provider string, account_id long, snapshot_id long, us long, failures long")


def system_alerts(alerts: DataFrame, now_us: int, provider: str | None = None) -> DataFrame:
    """Alerts that are neither dismissed nor over, newest first by the caller's order."""
    live = alerts.where(~F.col("dismissed") & (F.col("until_us").isNull() | (F.col("until_us") > now_us)))
    return live if provider is None else live.where(F.col("provider") == provider)


def older_than(rows: DataFrame, cutoff_us: int) -> tuple[DataFrame, DataFrame]:
    """M6: (what stays, what goes); the caller overwrites with the first."""
    return rows.where(F.col("us") >= cutoff_us), rows.where(F.col("us") < cutoff_us)


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet, and a manifest of rows and a digest of their hashes."""
    lines = None
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("name"), "rows", "digest")
        lines = one if lines is None else lines.unionByName(one)
    lines.write.json(f"{path}/manifest")


def import_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an export; ValueError if a table is not what the manifest says."""
    found = {}
    for r in spark.read.json(f"{path}/manifest").collect():  # one row a table
        df = spark.read.parquet(f"{path}/{r['name']}")
        now = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0)).cast("string")).first()
        if tuple(now) != (r["rows"], r["digest"]):
            raise ValueError(f"table {r['name']} differs from the manifest")
        found[r["name"]] = df
    return found
