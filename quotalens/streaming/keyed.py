"""Keyed state on streams: sessions that time out in event time (T9, T15) and receipts that enrich across batches.

Receipts use arbitrary state with a time to live, so the session's state store must be RocksDB (``prepare_state``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quotalens.operators.ingest import receipt

LATE = "5 minutes"
SESSIONS = "provider string, account_id long, quota_name string, session long, start_us long, end_us long, start_bp long, max_bp long, samples long"
RECEIPTS = "event_id long, device_id string, event_key string, status string, code string, payload string"


def prepare_state(spark: SparkSession) -> None:
    """State with a time to live needs the RocksDB store, which also keeps it outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Session:
    """What is held of one key: the newest sample, and the open session if there is one."""

    __slots__ = ("seen_us", "seen_id", "used", "session", "start_us", "changed_us", "start_bp", "max_bp", "samples")

    def __init__(self, *values) -> None:
        self.seen_us, self.seen_id, self.used, self.session, self.start_us, self.changed_us, self.start_bp, self.max_bp, self.samples = values or (-1, -1, _NO_USE, 0, 0, 0, 0, 0, 0)

    def closed(self, key: tuple, timeout_us: int) -> tuple:
        made, self.samples = self.samples, 0
        return (*key, self.session, self.start_us, self.changed_us + timeout_us, self.start_bp, self.max_bp, made)

    def due_ms(self, timeout_us: int, forget_us: int) -> int:
        """When the session times out, or else when the value is forgotten."""
        return (self.changed_us + timeout_us if self.samples else self.seen_us + forget_us) // 1000 + 1

    def take(self, us: int, snapshot: int, used: int, key: tuple, timeout_us: int, forget_us: int) -> tuple | None:
        """One sample; the session that it shows to be over, if any."""
        if us < self.seen_us or us == self.seen_us and snapshot <= self.seen_id:
            return None  # its place in the order has passed
        over = self.closed(key, timeout_us) if self.samples and us - self.changed_us > timeout_us else None
        if used != self.used and used != _NO_USE and self.used != _NO_USE and us - self.seen_us <= forget_us:
            if not self.samples:
                self.session, self.start_us, self.start_bp, self.max_bp = self.session + 1, us, self.used, used
            self.changed_us, self.max_bp, self.samples = us, max(self.max_bp, used), self.samples + 1
        elif self.samples:
            self.samples += 1
        self.seen_us, self.seen_id, self.used = us, snapshot, used
        return over


#: A use that is not known: a null on the way, as pandas would turn a nullable number into a float.
_NO_USE = -(2**63)
_KEYS = "provider string, _account string, quota_name string"
_MADE = f"{_KEYS}, session long, start_us long, end_us long, start_bp long, max_bp long, samples long"
#: One list a column, with an item for each key of the group.
_HELD = ", ".join(f"{c} array<string>" for c in ("providers", "accounts", "quotas")) + ", " + ", ".join(f"{c} array<long>" for c in _Session.__slots__)


def closing_sessions(samples: DataFrame, timeout_us: int, forget_us: int, late: str = LATE, groups: int | None = None) -> DataFrame:
    """T9, T15 on a stream: sessions of ``idle_sessions(..., silence_closes=True, forget_us=...)``, each given once, when its timeout
    has passed without a change: at the key's next sample, or by a timer once the watermark of all keys has passed it.

    A sample later than ``late``, or at or before the newest that its key has seen, is dropped. A key without samples for
    ``forget_us`` (not below the timeout) leaves no state; sessions are numbered from 1 again when it comes back.

    ``groups``: keys are dealt by hash into so many groups, each with one state for its keys; None gives each key a state of its own. To
    call Python for a key costs far more than a sample's step, so large batches of many keys want groups. Small batches want
    none, as a batch that meets one key of a group writes the state of all its keys. The number is fixed with the checkpoint.
    """
    if forget_us < timeout_us:
        raise ValueError("a value is kept at least as long as its session")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, made, now = {}, [], state.getCurrentWatermarkMs()
        if state.exists:
            columns = state.get
            held = {k: _Session(*v) for k, v in zip(zip(*columns[:3]), zip(*columns[3:]))}
        rows = [r for f in frames for r in zip(f["us"].tolist(), f["snapshot_id"].tolist(), f["_used"].tolist(), f["provider"].tolist(), f["_account"].tolist(), f["quota_name"].tolist())]
        for us, snapshot, used, *own in sorted(rows, key=lambda r: r[:2]):
            own = tuple(own)
            if own not in held:
                held[own] = _Session()
            if over := held[own].take(us, snapshot, used, own, timeout_us, forget_us):
                made.append(over)
        if state.hasTimedOut:
            for own, s in list(held.items()):
                if s.samples and s.due_ms(timeout_us, forget_us) <= now:
                    made.append(s.closed(own, timeout_us))
                if not s.samples and s.due_ms(timeout_us, forget_us) <= now:
                    del held[own]
        if held:
            state.update((*map(list, zip(*held)), *([getattr(s, c) for s in held.values()] for c in _Session.__slots__)))
            # times out once the watermark is beyond the time set, which must lie ahead
            state.setTimeoutTimestamp(max(min(s.due_ms(timeout_us, forget_us) for s in held.values()) - 1, now + 1))
        elif state.exists:
            state.remove()
        if made:
            names = [c.split()[0] for c in _MADE.split(", ")]
            yield pd.DataFrame({n: pd.array(list(column), dtype="Int64" if k > 2 else "object") for k, (n, column) in enumerate(zip(names, zip(*made)))})

    own = ["provider", "_account", "quota_name"]
    keyed = samples.select("provider", F.coalesce(F.col("account_id").cast("string"), F.lit("")).alias("_account"), "quota_name", "us", "snapshot_id", F.coalesce("used_bp", F.lit(_NO_USE)).alias("_used"), F.timestamp_micros("us").alias("ts"))
    keyed = keyed.withWatermark("ts", late)
    if groups is not None:
        own, keyed = ["_group"], keyed.withColumn("_group", F.pmod(F.xxhash64(*own), F.lit(groups)))
    closed = keyed.groupBy(*own).applyInPandasWithState(step, _MADE, _HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return closed.withColumn("account_id", F.nullif(F.col("_account"), F.lit("")).cast("bigint")).select(*[c.split()[0] for c in SESSIONS.split(", ")])


_STATED = [f.split()[0] for f in RECEIPTS.split(", ")]


class _Receipts(StatefulProcessor):
    """One value a key: the identity and payload that were accepted last."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "identity string, payload string", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.held.get()) if self.held.exists() else None
        held, made = before, []
        whole = lambda column: [None if v is None else int(v) for v in column.tolist()]
        arrivals = [r for f in rows for r in zip(whole(f["us"]), whole(f["event_id"]), *[f[c].tolist() for c in ("kind", "identity", "payload", "stored", "owner")])]
        for _, event, *arrival in sorted(arrivals, key=lambda r: r[:2]):
            status, code, held = receipt(held, key[0], *arrival)
            made.append((None if event is None else str(event), *key, status, code, held[1] if status in ("accepted", "enriched") else None))
        if held is not None and held != before:
            self.held.update(held)
        yield pd.DataFrame(dict(zip(_STATED, (pd.Series(c, dtype="object") for c in zip(*made)))))

    def close(self) -> None:
        pass


def receipt_stream(arrivals: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """T14 on a stream: what ``receipts`` gives, one arrival at a time, and the payload that stands if it was accepted or enriched.

    A key's accepted event is its state, so an event that comes back batches later is a duplicate, an enrichment or a conflict
    as it would be in one batch. Arrivals of one micro-batch are taken by time and id; across batches as they come. ``ttl_ms``: how long
    after its last write (in processing time) a receipt is kept; None keeps it for good.
    """
    mode = "None" if ttl_ms is None else "ProcessingTime"
    # arrivals go to Python as frames, as single rows cost several times a step; ids and times as texts, so they stay whole and null
    texts = arrivals.select("device_id", "event_key", F.col("us").cast("string").alias("us"), F.col("event_id").cast("string").alias("event_id"), "kind", "identity", "payload", "stored", "owner")
    made = texts.groupBy("device_id", "event_key").transformWithStateInPandas(_Receipts(ttl_ms), ", ".join(f"{c} string" for c in _STATED), "Update", mode)
    return made.withColumn("event_id", F.col("event_id").cast("long"))
