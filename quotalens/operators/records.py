"""Event metadata, meters from it, account and provenance lookups, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: P10: metadata keys that become columns.
TEXTS, TOKENS = ("event_key", "source_path", "source", "session_id"), ("input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "output_tokens", "reasoning_output_tokens")
PLANS, METERED = ("pro", "plus", "prolite", "free"), ("seven_day", "five_hour")
INSIGHT_DAYS = {"1d": 1, "7d": 7, "30d": 30}


def normalized_metadata(events: DataFrame, column: str = "metadata") -> DataFrame:
    """P10: the columns that an event's metadata (JSON object) gives, beside the others.

    Texts are trimmed. Effort and mode default to 'unknown'; so does the speed, unless a boolean fast_mode says fast or
    standard. Token counts of the metadata go before the event's columns of that name, if it has them. No object, or a
    null one, gives defaults alone.
    """
    of = lambda k: F.get_json_object(column, f"$.{k}")
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    fast = of("fast_mode")
    made = {k: F.coalesce(F.trim(of(k)), F.lit("")) for k in TEXTS}
    made |= {"reasoning_effort": known(of("reasoning_effort")), "mode": known(of("mode")), "speed_mode": F.when(fast == "true", "fast").when(fast == "false", "standard").otherwise(known(of("speed_mode")))}
    made |= {k: F.coalesce(of(k).try_cast("bigint"), F.col(k) if k in events.columns else F.lit(0).cast("bigint")) for k in TOKENS}
    return events.withColumns(made)


def meters_from_events(events: DataFrame, column: str = "metadata") -> DataFrame:
    """(account, us, quota_name, plan, used_bp, reset_us) of Codex events whose quota telemetry names a known plan; a meter
    needs a use of 0 to 100 and a reset above 0 (epoch seconds)."""
    of = lambda p: F.get_json_object(column, f"$.quota_telemetry.{p}")
    e = events.where((F.col("integration") == "Codex CLI") & of("plan").isin(*PLANS))
    meters = F.array(*[F.struct(F.lit(n).alias("quota_name"), of(f"{n}.used").try_cast("double").alias("used"), of(f"{n}.reset").try_cast("bigint").alias("reset")) for n in METERED])
    m = e.select("account", "us", of("plan").alias("plan"), F.explode(meters).alias("m")).select("account", "us", "plan", "m.*")
    m = m.where("used BETWEEN 0 AND 100 AND NOT isnan(used) AND reset > 0")
    return m.select("account", "us", "quota_name", "plan", F.round(F.col("used") * 100).cast("bigint").alias("used_bp"), (F.col("reset") * 1_000_000).alias("reset_us"))


def resolved_accounts(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """account_id of each row's ``external``: the account of that external id (the smallest, of several), else the text as a
    number, else 1."""
    known = accounts.groupBy(F.col("external_id").alias("external")).agg(F.min("account_id").alias("_id"))
    return rows.join(known, "external", "left").withColumn("account_id", F.coalesce("_id", F.trim("external").try_cast("bigint"), F.lit(1).cast("bigint"))).drop("_id")


def with_receipts(snapshots: DataFrame, receipts: DataFrame) -> DataFrame:
    """Snapshots with the receipt whose ``entity_id`` (text) is their id; those without stay."""
    own = receipts.select(F.col("entity_id").alias("_entity"), "device_id", "receipt_id")
    return snapshots.join(own, snapshots["snapshot_id"].cast("string") == own["_entity"], "left").drop("_entity")


def with_provenance(rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """Rows with the origin of their first provenance record (smallest ``seq``) of the same table and key."""
    first = provenance.groupBy("table_name", "row_key").agg(F.min_by("origin", "seq").alias("origin"))
    return rows.join(first, ["table_name", "row_key"], "left")


def history_bounds(tables: dict[str, DataFrame]) -> DataFrame:
    """First and last time over all tables, and of each; a table without rows has none."""
    every = None
    for name, t in tables.items():
        one = t.select(F.lit(name).alias("name"), "us")
        every = one if every is None else every.unionByName(one)
    return every.rollup("name").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us")).select(F.coalesce("name", F.lit("*")).alias("name"), "first_us", "last_us")


def origins(*tables: DataFrame) -> DataFrame:
    """The distinct non-blank origins of all tables."""
    every = None
    for t in tables:
        one = t.select("origin").where("trim(origin) != ''").distinct()
        every = one if every is None else every.unionByName(one)
    return every.distinct()


def observed(tables: dict[str, DataFrame], rank: tuple[str, ...]) -> DataFrame:
    """Providers that have any row in any table, in a fixed order; names outside ``rank`` follow by name."""
    every = None
    for t in tables.values():
        one = t.select("provider").where("provider IS NOT NULL").distinct()
        every = one if every is None else every.unionByName(one)
    order = F.lit(len(rank))
    for k, name in enumerate(rank):
        order = F.when(F.col("provider") == name, k).otherwise(order)
    return every.distinct().withColumn("place", F.row_number().over(Window.orderBy(order, "provider")).cast("bigint"))


def insights_range(name: str | None, now_us: int) -> tuple[int, int]:
    """(start, end) of an insights range; an unknown name is seven days."""
    return now_us - INSIGHT_DAYS.get(name or "7d", 7) * DAY_US, now_us


def logging_range(days: int | None, limit: int | None, now_us: int) -> tuple[int, int, int]:
    """(start, end, rows) of a logging history: 1 to 30 days and 1 to 50 000 rows; ValueError outside these."""
    days, limit = 1 if days is None else days, 500 if limit is None else limit
    if not 1 <= days <= 30 or not 1 <= limit <= 50_000:
        raise ValueError("a logging history has 1 to 30 days and 1 to 50 000 rows")
    return now_us - days * DAY_US, now_us, limit


def not_over(rows: DataFrame, most: int, what: str) -> DataFrame:
    """The rows as they are; ValueError if there are more than ``most``. Reads ``most`` + 1 rows at most."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}: choose a shorter range")
    return rows


#: F1: RFC 3339 with any fraction of a second and a zone.
_RFC3339 = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})$"


def time_order(text: Column) -> Column:
    """F1, L1: what RFC 3339 times sort by: the instant to the nanosecond, whatever their zones and lengths of fraction. Texts that
    are no such time come after all that are, by their letters; null sorts as Spark sorts nulls. Equal instants are equal keys."""
    part = lambda k: F.regexp_extract(text, _RFC3339, k)
    instant = F.when(text.rlike(_RFC3339), F.unix_seconds(F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), part(4)))))
    nanos = F.rpad(F.substring(part(3), 1, 9), 9, "0").cast("int")
    key = F.struct(instant.isNull().alias("no_time"), F.coalesce(instant, F.lit(0)).alias("s"), F.when(instant.isNull(), 0).otherwise(nanos).alias("ns"), F.when(instant.isNull(), text).otherwise("").alias("text"))
    return F.when(text.isNotNull(), key)
