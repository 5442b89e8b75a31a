"""Reset-cycle detection, one rule a provider."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted
from .samples import KEY

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US


@dataclass(frozen=True)
class Rule:
    """When a sample ends the open cycle, and how the cycle closes.

    past_us: so long after the stored reset (None: never). shift_us: the reset time lies farther than this from the one
    of ``shift_from`` (stored at opening, or last seen). appeared: a reset time where none was stored. fell_bp: a shift
    counts only with a fall of more than this. drop_bp: a fall of more than this is a reset by itself. below: a value
    under this share of the last is a reset. past_fell: any fall after the stored reset is one. whole_hours: reset times
    are compared by their hour. confirm: a shift must be seen again by the next sample (within 5 minutes, use at most 2
    points above); until then shifted samples are skipped, the latest being the one to confirm. forgets: the last reset
    time is the last sample's, even if that has none. rolls: the stored reset follows the samples. adds: the closing sample's rise
    counts; peaks: its value may be the peak; ends_at_reset: a late sample ends the cycle at the stored reset.
    """

    past_us: int | None = None
    shift_us: int | None = None
    shift_from: str = "stored"
    appeared: bool = False
    fell_bp: int | None = None
    drop_bp: int | None = None
    below: tuple[int, int] | None = None
    past_fell: bool = False
    whole_hours: bool = False
    confirm: bool = False
    forgets: bool = False
    rolls: bool = False
    adds: bool = False
    peaks: bool = False
    ends_at_reset: bool = True

    @property
    def local(self) -> bool:
        """Whether a reset depends on the samples alone, not on what a cycle stored at its opening."""
        return self.past_us is None and self.shift_from == "last" and not (self.appeared or self.past_fell or self.confirm or self.rolls or self.adds or self.peaks or self.whole_hours)


RULES = {
    "anthropic": Rule(past_us=2 * MINUTE_US, shift_us=10 * MINUTE_US, appeared=True, adds=True, peaks=True),
    "cursor": Rule(past_us=2 * MINUTE_US, shift_us=10 * MINUTE_US, appeared=True, adds=True, peaks=True),
    "synthetic": Rule(past_us=2 * MINUTE_US, shift_us=0, whole_hours=True, adds=True),
    "codex": Rule(past_us=2 * MINUTE_US, shift_us=60 * MINUTE_US, shift_from="last", fell_bp=200, confirm=True, rolls=True, adds=True, peaks=True),
    "gemini": Rule(past_us=2 * MINUTE_US, shift_us=60 * MINUTE_US, fell_bp=200, rolls=True, adds=True, peaks=True),
    "antigravity": Rule(shift_us=10 * MINUTE_US, shift_from="last", drop_bp=1000, past_fell=True),
    "minimax": Rule(shift_us=10 * MINUTE_US, shift_from="last", below=(3, 5)),
    "copilot": Rule(shift_us=0, shift_from="last", past_fell=True, forgets=True),
    "zai_tokens": Rule(past_us=2 * MINUTE_US, shift_us=0, appeared=True, adds=True, peaks=True),
    "zai_time": Rule(shift_from="last", below=(1, 2), ends_at_reset=False),
    "openrouter": Rule(shift_from="last", below=(1, 2), ends_at_reset=False),
}


class Cycle:
    """The open cycle of one key, and what the rule remembers of the samples before."""

    def __init__(self, rule: Rule, us: int, used: int, reset: int | None) -> None:
        self.rule, self.pending = rule, None
        self.last, self.last_reset = used, reset
        self._open(us, used, reset)

    def _open(self, us: int, used: int, reset: int | None) -> None:
        self.start, self.reset, self.peak, self.delta = us, reset, used, 0

    def _shifted(self, reset: int | None) -> bool:
        r = self.rule
        old = self.reset if r.shift_from == "stored" else self.last_reset
        if r.shift_us is None or reset is None or old is None:
            return False
        if r.whole_hours:
            return reset // HOUR_US != old // HOUR_US
        return abs(reset - old) > r.shift_us

    def take(self, us: int, used: int, reset: int | None) -> tuple | None:
        """Adds a sample; returns (start, end, reset, peak, delta) of the cycle that it ends."""
        r, late = self.rule, self.reset is not None and us > self.reset
        fall = self.last - used
        past = r.past_us is not None and self.reset is not None and us > self.reset + r.past_us
        shifted = self._shifted(reset) and (r.fell_bp is None or fall > r.fell_bp)
        if r.confirm:
            shifted = shifted and self.reset is not None
            was, self.pending = self.pending, None
            if shifted and not past and not (was and abs(reset - was[0]) <= 5 * MINUTE_US and used <= was[1] + 200):
                self.pending = (reset, used)
                return None
        ended = past or shifted or (r.appeared and reset is not None and self.reset is None)
        ended = ended or (r.drop_bp is not None and fall > r.drop_bp) or (r.past_fell and late and fall > 0)
        ended = ended or (r.below is not None and used * r.below[1] < self.last * r.below[0])
        closed = None
        if ended:
            if r.adds:
                self.delta += max(0, -fall)
            if r.peaks:
                self.peak = max(self.peak, used)
            closed = (self.start, self.reset if late and r.ends_at_reset else us, self.reset, self.peak, self.delta)
            self._open(us, used, reset)
        else:
            self.delta += max(0, -fall)
            self.peak = max(self.peak, used)
            if r.rolls and reset is not None:
                self.reset = reset
        self.last = used
        if reset is not None or r.forgets:
            self.last_reset = reset
        return closed


_OUT = "provider string, account_id long, quota_name string, start_us long, end_us long, reset_us long, peak_bp long, delta_bp long"


def detect_cycles(rows: DataFrame, rule: Rule) -> DataFrame:
    """Closed cycles of every key and its open one (null end), from all samples in order of time and id.

    Under most rules what ends a cycle depends on what its opening stored, so a key's samples are walked in order. They
    come sorted, and a task holds one open cycle at a time: memory does not grow with a key's samples. A single key's own
    series is the smallest unit of work. Local rules are windows alone. A null account is an account like any other.
    """
    if rule.local:
        return _local_cycles(rows, rule)

    def walk(samples: Iterator[tuple]) -> Iterator[tuple]:
        key, cycle = None, None
        for *own, us, used, reset in samples:
            if own != key:
                if cycle is not None:
                    yield *key, cycle.start, None, cycle.reset, cycle.peak, cycle.delta
                key, cycle = own, Cycle(rule, us, used, reset)
            elif closed := cycle.take(us, used, reset):
                yield *key, *closed
        if cycle is not None:
            yield *key, cycle.start, None, cycle.reset, cycle.peak, cycle.delta

    ordered = rows.select(*KEY, "us", "snapshot_id", "used_bp", "reset_us").repartition(*KEY).sortWithinPartitions(*KEY, "us", "snapshot_id")
    return fold_sorted(ordered.drop("snapshot_id"), walk, _OUT)


def _local_cycles(rows: DataFrame, rule: Rule) -> DataFrame:
    """``detect_cycles`` of a local rule: resets from the sample before, running sums of them, one aggregate a segment."""
    w = Window.partitionBy(*KEY).orderBy("us", "snapshot_id")
    seen = F.lag("reset_us").over(w) if rule.forgets else F.last("reset_us", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(*KEY, "us", "snapshot_id", "used_bp", "reset_us").withColumns({"_last": F.lag("used_bp").over(w), "_seen": seen})
    ended = F.lit(False)
    if rule.shift_us is not None:
        fell = F.lit(True) if rule.fell_bp is None else F.col("_last") - F.col("used_bp") > rule.fell_bp
        ended = ended | ((F.abs(F.col("reset_us") - F.col("_seen")) > rule.shift_us) & fell)
    if rule.drop_bp is not None:
        ended = ended | (F.col("_last") - F.col("used_bp") > rule.drop_bp)
    if rule.below is not None:
        ended = ended | (F.col("used_bp") * rule.below[1] < F.col("_last") * rule.below[0])
    rows = rows.withColumn("_ended", F.coalesce(ended, F.lit(False))).withColumn("_segment", F.sum(F.col("_ended").cast("bigint")).over(w))
    rise = F.when(F.col("_ended"), 0).otherwise(F.coalesce(F.greatest(F.col("used_bp") - F.col("_last"), F.lit(0)), F.lit(0)))
    cycles = rows.groupBy(*KEY, "_segment").agg(
        F.min("us").alias("start_us"), F.min_by("reset_us", F.struct("us", "snapshot_id")).alias("reset_us"), F.max("used_bp").alias("peak_bp"), F.sum(rise).cast("bigint").alias("delta_bp")
    )
    following = F.lead("start_us").over(Window.partitionBy(*KEY).orderBy("_segment"))
    end = F.when(F.col("_next") > F.col("reset_us"), F.col("reset_us")).otherwise(F.col("_next")) if rule.ends_at_reset else F.col("_next")
    return cycles.withColumn("_next", following).select(*KEY, "start_us", end.alias("end_us"), "reset_us", "peak_bp", "delta_bp")
