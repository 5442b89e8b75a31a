"""Ingest: validation, fingerprints, replays, late data, thinning, merges."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import adds_to
from .folds import fold_sorted
from .samples import KEY

MINUTE_US = 60_000_000
PROVIDERS = ("anthropic", "openai", "gemini")
LINE = "ts string, integration string, provider string, account string, model string, request_id string, input_tokens bigint, output_tokens bigint, total_tokens bigint, cost_usd double, metadata string"


def parse_lines(lines: DataFrame) -> DataFrame:
    """S3: one JSON usage event a line (column value) into typed columns and ``error``, null where the line is valid."""
    p = lines.withColumn("e", F.from_json("value", LINE)).select("*", "e.*").drop("e")
    ts = F.try_to_timestamp("ts")
    long = lambda c: F.char_length(F.coalesce(F.col(c), F.lit(""))) > 256
    error = (
        F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "empty")
        .when(F.col("ts").isNull() & F.col("integration").isNull() & F.col("model").isNull(), "bad_json")
        .when(ts.isNull(), "bad_ts").when(F.coalesce(F.col("integration"), F.lit("")) == "", "no_integration").when(F.coalesce(F.col("model"), F.lit("")) == "", "no_model")
        .when(~F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False)), "provider")
        .when((F.coalesce("input_tokens", F.lit(0)) < 0) | (F.coalesce("output_tokens", F.lit(0)) < 0), "negative_tokens").when(F.coalesce("cost_usd", F.lit(0.0)) < 0, "negative_cost")
        .when(long("integration") | long("model"), "too_long").when(F.col("metadata").isNotNull() & ~F.coalesce("metadata", F.lit("")).rlike(r"^\s*\{"), "metadata")
        .when(F.octet_length(F.coalesce("metadata", F.lit(""))) > 4096, "metadata_size")
    )
    return p.withColumn("us", F.unix_micros(ts)).withColumn("error", error)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, each closed by a NUL."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\0"))]), 256)


def event_fingerprint(source_path: Column, us: Column, metadata: Column) -> Column:
    """what makes an event the same one (columns integration, provider, account, model, request_id, tokens; metadata JSON).

    Requests of Claude transcripts with a request id: their file, account, session, request, model and all token counts;
    else the metadata's event_key, if it has one; else path, time, names, counts and request id.
    """
    of = lambda k: F.coalesce(F.trim(F.get_json_object(metadata, f"$.{k}")), F.lit(""))
    count = lambda k: F.coalesce(F.nullif(of(k), F.lit("")), F.lit("0"))
    request = F.coalesce(F.col("request_id"), F.lit(""))
    total = F.coalesce(F.col("total_tokens"), F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    tokens = ("input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "cache_creation_1h_input_tokens", "output_tokens", "reasoning_output_tokens")
    claude = fingerprint(F.lit("claude_usage"), of("source_path"), F.col("provider"), F.col("account"), of("session_id"), request, F.col("model"), *map(count, tokens), total)
    plain = fingerprint(source_path, us, F.col("integration"), F.col("provider"), F.col("account"), F.col("model"), F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)), total, request)
    is_claude = (F.col("provider") == "anthropic") & (of("source") == "claude") & (request != "")
    return F.when(is_claude, claude).when(of("event_key") != "", fingerprint(F.lit("event_key"), of("event_key"))).otherwise(plain)


def dedupe(events: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The first event of each fingerprint, by time and id."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("us", "event_id")).alias("e")).select(key, "e.*")


def not_compacted(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Events whose fingerprint was not compacted before."""
    return events.join(tombstones.select("fingerprint").distinct(), "fingerprint", "left_anti")


def _same_json(a: str, b: str) -> bool:
    try:
        return json.loads(a) == json.loads(b)
    except (TypeError, ValueError):
        return a == b


def receipt(held: tuple[str, str] | None, device: str, kind: str, identity: str, payload: str, stored: bool, owner: str) -> tuple[str, str | None, tuple[str, str] | None]:
    """Status and code of one arrival, and the (identity, payload) that stand after it; ``held`` are those that stood before."""
    if held is None:
        if kind != "usage_event" and owner != device:
            return "rejected", "ownership_conflict", None
        return "duplicate" if stored and kind == "usage_event" else "accepted", None, (identity, payload)
    if identity != held[0]:
        return "rejected", "event_identity_conflict", held
    if _same_json(payload, held[1]):
        return "duplicate", None, held
    if kind == "usage_event" and adds_to(held[1], payload):
        return "enriched", None, (identity, payload)
    return "rejected", "event_payload_conflict", held


def receipts(arrivals: DataFrame) -> DataFrame:
    """Status (and code, if rejected) of each arrival, in order of time and id of its (device_id, event_key).

    ``arrivals``: event_id, device_id, event_key, us, kind (usage_event or quota_snapshot), identity (digest of what may not
    change), payload (JSON), stored (whether its fingerprint is known already), owner (the device that polls the account).
    The first arrival is accepted, or a duplicate if its fingerprint is known; a quota snapshot of a device that does not
    own the account is rejected and leaves no receipt. A later one with another identity is rejected; with an equal payload it
    is a duplicate; a usage event whose payload adds to the last accepted one is enriched, and then that is the accepted one;
    else it is rejected. What arrives later depends on what was accepted, so a key's arrivals are walked in order.
    """

    def walk(rows):
        key, held = None, None
        for event, *own, kind, identity, payload, stored, owner in rows:
            if own != key:
                key, held = own, None
            status, code, held = receipt(held, own[0], kind, identity, payload, stored, owner)
            yield event, *own, status, code

    keys = ["device_id", "event_key"]
    columns = ["event_id", *keys, "kind", "identity", "payload", "stored", "owner"]
    ordered = arrivals.select(*columns, "us").repartition(*keys).sortWithinPartitions(*keys, "us", "event_id").select(*columns)
    return fold_sorted(ordered, walk, "event_id long, device_id string, event_key string, status string, code string")


def late_observations(rows: DataFrame, arrival: Column, late_us: int = 5 * MINUTE_US, ahead_us: int = MINUTE_US) -> DataFrame:
    """Per key the newest observation, and whether it may alert: not older than 5 minutes at arrival nor over one ahead."""
    rows = rows.withColumn("_arrived", arrival)
    rows = rows.withColumn("may_alert", (F.col("_arrived") - F.col("us") <= late_us) & (F.col("us") - F.col("_arrived") <= ahead_us))
    w = Window.partitionBy(*KEY).orderBy(F.desc("us"), F.desc("snapshot_id"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*KEY, "snapshot_id", "us", "may_alert")


def thin_meters(rows: DataFrame, within_us: int = 10 * MINUTE_US) -> DataFrame:
    """Drops a meter if an equal one (key, plan, use, reset) was kept in the last ten minutes, just ten included.

    What is kept depends on what was kept before, so each task walks its sorted rows holding one time.
    """

    def walk(meters):
        key, kept = None, 0
        for *own, snapshot, us in meters:
            if own != key or us - kept > within_us:
                key, kept = own, us
                yield *own[:3], snapshot, us, own[3], own[5]

    reset = F.col("reset_us") if "reset_us" in rows.columns else F.lit(None).cast("bigint")
    plan = F.col("plan") if "plan" in rows.columns else F.lit(None).cast("string")
    order = [*KEY, "used_bp", "_reset", "_plan"]
    keyed = rows.select(*KEY, "used_bp", reset.alias("_reset"), plan.alias("_plan"), "snapshot_id", "us")
    ordered = keyed.repartition(*order).sortWithinPartitions(*order, "us", "snapshot_id")
    return fold_sorted(ordered, walk, "provider string, account_id long, quota_name string, snapshot_id long, us long, used_bp long, plan string")


def prefer_polled(meters: DataFrame, within_us: int = 10 * MINUTE_US) -> DataFrame:
    """Drops a rollout meter if a polled one of the same quota lies within ten minutes on either side."""
    polled = F.when(F.col("source") == "poll", F.col("us"))
    upto = lambda order: Window.partitionBy(*KEY).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    # the nearest poll on each side is a running value in one of the two orders: no frame is read twice
    rows = meters.withColumns({"_before": F.max(polled).over(upto(F.asc("us"))), "_after": F.min(polled).over(upto(F.desc("us")))})
    near = (F.col("us") - F.col("_before") <= within_us) | (F.col("_after") - F.col("us") <= within_us)
    return rows.where((F.col("source") == "poll") | ~F.coalesce(near, F.lit(False))).drop("_before", "_after")


def upsert_hourly(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """M3: added counters, earliest and latest of both."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums], F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def merge_mutable(a: DataFrame, b: DataFrame) -> DataFrame:
    """M4: one row a key; the later row's terminal fields, the maximum of what only grows."""
    both = a.withColumn("_o", F.lit(0)).unionByName(b.withColumn("_o", F.lit(1)))
    latest = F.max_by(F.struct("reset_us", "snapshot_id"), F.struct("us", "snapshot_id", "_o")).alias("_l")
    return both.groupBy(*KEY).agg(latest, F.max("used_bp").alias("peak_bp"), F.max("us").alias("us")).select(*KEY, "_l.reset_us", "_l.snapshot_id", "peak_bp", "us")


def first_wins(*tables: DataFrame, key: str) -> DataFrame:
    """Union in which an earlier table's row of a key wins."""
    ranked = None
    for k, t in enumerate(tables):
        one = t.withColumn("_rank", F.lit(k))
        ranked = one if ranked is None else ranked.unionByName(one)
    rest = [c for c in ranked.columns if c not in (key, "_rank")]
    return ranked.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("e")).select(key, "e.*")


def ingest_health(cursors: DataFrame, events: DataFrame) -> DataFrame:
    """Every known file with its events and the newest of them."""
    own = events.groupBy("source_path").agg(F.count("*").alias("events"), F.max("us").alias("newest_us"))
    return cursors.join(own, "source_path", "left").select("source_path", F.coalesce("events", F.lit(0)).alias("events"), "newest_us")
