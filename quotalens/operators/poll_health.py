"""Health of pollers, with polls that never came, and what is told of it outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted

MINUTE_US, HOUR_US = 60_000_000, 3_600_000_000
POLLER = ["provider", "account_id"]


def _missed(late: str, interval_us: int) -> str:
    """Whole intervals up to ``late`` microseconds after a deadline, the deadline being the first."""
    return f"CASE WHEN {late} >= 0 THEN 1 + ({late}) DIV {interval_us} ELSE 0L END"


def poll_runs(polls: DataFrame, now_us: int, interval_us: int, grace_us: int, threshold: int = 3) -> DataFrame:
    """Per poller its runs of failed and missed polls, each ended by a success or still open at ``now_us``.

    ``polls``: provider, account_id, snapshot_id, us, outcome (success, failure or skipped). A poll is missed an interval and the
    grace after the one before (a skipped one counts as seen), and again every interval until the next. Missed polls
    are counted from the gaps, not made as rows, so a long silence costs nothing. A poll on a deadline is in time; at
    ``now_us`` a deadline has passed. A poller is known from its first poll on.

    Columns: run (from 0), failed, missed, first_us and last_us of these, ended_us (the success; null: open), state (failing or
    stalled, by the last of them), severity (error from ``threshold`` on, below 2: 3). Runs without any are left out.
    """
    threshold = threshold if threshold >= 2 else 3
    p = polls.where(F.col("us") <= now_us).select(*POLLER, "snapshot_id", "us", "outcome")
    ends = p.groupBy(*POLLER).agg(F.max("us").alias("_last")).select(*POLLER, F.lit(None).cast("bigint").alias("snapshot_id"), F.lit(now_us).alias("us"), F.lit("now").alias("outcome"))
    order = [F.col("us"), (F.col("outcome") == "now"), F.col("snapshot_id")]
    w = Window.partitionBy(*POLLER).orderBy(*order)
    rows = p.unionByName(ends).withColumn("_deadline", F.lag("us").over(w) + interval_us + grace_us)
    # between two polls a deadline counts if it lies before the later one, at the end also if it is now
    rows = rows.withColumn("_late", F.when(F.col("outcome") == "now", F.col("us") - F.col("_deadline")).otherwise(F.col("us") - F.col("_deadline") - 1))
    rows = rows.withColumn("_missed", F.coalesce(F.expr(_missed("_late", interval_us)), F.lit(0)))
    rows = rows.withColumn("run", F.coalesce(F.sum((F.col("outcome") == "success").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    failed = F.col("outcome") == "failure"
    at_miss = F.when(F.col("_missed") > 0, F.col("_deadline"))
    last_miss = F.when(F.col("_missed") > 0, F.col("_deadline") + (F.col("_missed") - 1) * interval_us)
    runs = rows.groupBy(*POLLER, "run").agg(
        F.count_if(failed).alias("failed"), F.sum("_missed").alias("missed"), F.min(F.least(at_miss, F.when(failed, F.col("us")))).alias("first_us"),
        F.max(F.greatest(last_miss, F.when(failed, F.col("us")))).alias("last_us"), F.max(F.when(failed, F.col("us"))).alias("_failed_us"), F.max(F.when(F.col("outcome") == "success", F.col("us"))).alias("ended_us"),
    )
    all_ = F.col("failed") + F.col("missed")
    state = F.when(F.col("_failed_us") == F.col("last_us"), "failing").otherwise("stalled")
    return runs.where(all_ > 0).select(*POLLER, "run", "failed", "missed", "first_us", "last_us", "ended_us", state.alias("state"), F.when(all_ >= threshold, "error").otherwise("warning").alias("severity"))


def poll_health(polls: DataFrame, now_us: int, interval_us: int, grace_us: int, threshold: int = 3) -> DataFrame:
    """State of every poller at ``now_us``: healthy, failing or stalled, with the polls failed and missed since it last succeeded."""
    seen = polls.where(F.col("us") <= now_us).groupBy(*POLLER).agg(F.max("us").alias("polled_us"), F.max(F.when(F.col("outcome") == "success", F.col("us"))).alias("success_us"))
    open_ = poll_runs(polls, now_us, interval_us, grace_us, threshold).where("ended_us IS NULL")
    same = F.expr("s.provider <=> o.provider AND s.account_id <=> o.account_id")
    both = seen.alias("s").join(open_.alias("o"), same, "left")
    return both.select("s.provider", "s.account_id", "polled_us", "success_us", F.coalesce("state", F.lit("healthy")).alias("state"), F.coalesce(F.col("failed") + F.col("missed"), F.lit(0)).alias("failures"), "first_us", "last_us", "severity")


def backoff(polls: DataFrame, base_us: int = 5 * MINUTE_US, most_us: int = 6 * HOUR_US) -> DataFrame:
    """Of every failed poll how long the poller rests after it: ``base_us``, doubled for each failure in a row before it, at most
    ``most_us``; or what the provider asks for (``retry_after_us``, if given and above 0). ``resume_us`` is the end of the rest, ``early``
    tells that the next poll came before it. A success starts the row anew, a skipped poll does not count."""
    w = Window.partitionBy(*POLLER).orderBy("us", "snapshot_id")
    failed = (F.col("outcome") == "failure").cast("bigint")
    rows = polls.withColumn("_run", F.sum((F.col("outcome") == "success").cast("bigint")).over(w))
    nth = F.sum(failed).over(Window.partitionBy(*POLLER, "_run").orderBy("us", "snapshot_id"))
    asked = F.when(F.col("retry_after_us") > 0, F.col("retry_after_us")) if "retry_after_us" in polls.columns else F.lit(None).cast("bigint")
    doubled = F.lit(base_us).cast("bigint") * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(10))).cast("bigint")
    rows = rows.withColumns({"failures": nth, "_next": F.lead("us").over(w)}).where("outcome = 'failure'")
    rows = rows.withColumn("rest_us", F.coalesce(asked, F.least(doubled, F.lit(most_us)))).withColumn("resume_us", F.col("us") + F.col("rest_us"))
    return rows.select(*POLLER, "snapshot_id", "us", "failures", "rest_us", "resume_us", F.coalesce(F.col("_next") < F.col("resume_us"), F.lit(False)).alias("early"))


class _Poller:
    """Health of one poller and of the one message that may be on its way."""

    def __init__(self, interval: int, grace: int, threshold: int, outage: int, cooldown: int, repeat: int) -> None:
        self.interval, self.grace, self.threshold, self.outage, self.cooldown, self.repeat = interval, grace, threshold, outage, cooldown, repeat
        self.deadline, self.clock, self.on_its_way = None, 0, None
        self._healthy()

    def _healthy(self) -> None:
        self.failures, self.first, self.tried, self.told = 0, None, None, None

    def _due(self) -> int | None:
        """When a failure may be told next: never while a message is on its way or failures are too few."""
        if self.on_its_way or self.failures < self.threshold:
            return None
        due = self.first + self.outage
        if self.told is not None:
            due = max(due, self.told + self.repeat)
        if self.tried is not None and (self.told is None or self.tried > self.told):
            due = max(due, self.tried + self.cooldown)
        return max(due, self.clock)

    def _fail(self, us: int, times: int = 1) -> None:
        self.failures += times
        self.first = us if self.first is None else self.first

    def _claim(self):
        if (due := self._due()) is not None and due <= self.clock:
            self.on_its_way, self.tried = ("failure", self.clock, self.first, None), self.clock
            yield self.clock, "failure", self.failures

    def until(self, us: int, inclusive: bool):
        """Deadlines that pass and messages that fall due before ``us``."""
        end = us if inclusive else us - 1
        while True:
            due = self._due()
            times = [t for t in (self.deadline, due) if t is not None and t <= end]
            if not times:
                return
            if self.deadline is not None and self.deadline <= min(times):
                # once enough have failed, only a message that falls due matters: all deadlines before it at once
                some = 1 if self.failures < self.threshold else 1 + (min(end, end if due is None else due) - self.deadline) // self.interval
                self._fail(self.deadline, some)
                self.clock, self.deadline = self.deadline + (some - 1) * self.interval, self.deadline + some * self.interval
            else:
                self.clock = due
            yield from self._claim()

    def poll(self, us: int, outcome: str):
        self.clock, self.deadline = us, us + self.interval + self.grace
        if outcome == "failure":
            self._fail(us)
        elif outcome == "success" and self.failures:
            failures, told = self.failures, self.told is not None
            self._healthy()
            if self.on_its_way and self.on_its_way[0] == "failure":
                self.on_its_way = (*self.on_its_way[:3], (told, failures))  # told once it is known whether the failure was
            elif told and not self.on_its_way:
                self.on_its_way = ("recovery", us, None, None)
                yield us, "recovery", failures

    def outcome(self, us: int, sent: bool):
        self.clock = us
        if self.on_its_way is None:
            return
        kind, tried, incident, recovery = self.on_its_way
        self.on_its_way = None
        if kind == "failure" and self.failures and self.first == incident and sent:
            self.told = tried
        if recovery is not None and (recovery[0] or sent):
            self.on_its_way = ("recovery", us, None, None)
            yield us, "recovery", recovery[1]


def poll_messages(
    polls: DataFrame, outcomes: DataFrame, now_us: int, interval_us: int, grace_us: int, threshold: int = 3, outage_us: int = 30 * MINUTE_US, cooldown_us: int = 30 * MINUTE_US, repeat_us: int = 6 * HOUR_US
) -> DataFrame:
    """Attempts to tell of failures and recoveries outside: provider, account_id, us, kind (failure or recovery), failures.

    A failure is told once ``threshold`` polls (below 2: 3) failed or were missed and the first lies ``outage_us`` back; after an attempt
    that did not arrive again after ``cooldown_us``, after one that did after ``repeat_us``. Only one message of a poller is on its way:
    ``outcomes`` (provider, account_id, us, sent) say how the one before ended; one that nothing waits for is ignored. A success ends the
    failure; its recovery is told if the failure was, or arrives later. Polls as in ``poll_runs``; at one time polls come before
    outcomes, both before deadlines and messages that fall due then.

    Whether a message is sent depends on when the last one was, so each poller's two series are walked in order, with its few
    numbers of state; deadlines and due times are made on the way.
    """
    threshold = threshold if threshold >= 2 else 3

    def walk(rows):
        key, poller = None, None
        for *own, us, rank, outcome in rows:
            if own != key:
                if poller is not None:
                    yield from ((*key, *m) for m in poller.until(now_us, True))
                key, poller = own, _Poller(interval_us, grace_us, threshold, outage_us, cooldown_us, repeat_us)
            yield from ((*key, *m) for m in poller.until(us, False))
            yield from ((*key, *m) for m in (poller.poll(us, outcome) if rank == 0 else poller.outcome(us, outcome == "sent")))
        if poller is not None:
            yield from ((*key, *m) for m in poller.until(now_us, True))

    p = polls.where(F.col("us") <= now_us).select(*POLLER, "us", F.lit(0).alias("rank"), F.col("snapshot_id").alias("at"), "outcome")
    o = outcomes.where(F.col("us") <= now_us).select(*POLLER, "us", F.lit(1).alias("rank"), F.when(F.col("sent"), 1).otherwise(0).cast("bigint").alias("at"), F.when(F.col("sent"), "sent").otherwise("lost").alias("outcome"))
    both = p.unionByName(o).repartition(*POLLER).sortWithinPartitions(*POLLER, "us", "rank", "at").select(*POLLER, "us", "rank", "outcome")
    return fold_sorted(both, walk, "provider string, account_id long, us long, kind string, failures long")
