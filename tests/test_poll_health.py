"""Poll health against a monitor that ticks at every microsecond; order of times; nested usage."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quotalens.operators import poll_health, records, rollup

POLLS = "provider string, account_id long, snapshot_id long, us long, outcome string"
OUTCOMES = "provider string, account_id long, us long, sent boolean"
INTERVAL, GRACE, OUTAGE, COOLDOWN, REPEAT = 5, 2, 9, 7, 30


def series(seed, pollers=12, end=260):
    rng, polls, outcomes = random.Random(seed), [], []
    for k in range(pollers):
        key = (rng.choice("pq"), rng.choice([None, k, 2**60 + k]))
        t, mood = rng.randrange(20), "success"
        while t < end:
            mood = mood if rng.random() < 0.7 else rng.choice(["success", "failure", "failure", "skipped"])
            polls.append((*key, len(polls), t, mood))
            t += rng.choice([1, 4, 5, 6, 7, 8, 20]) if rng.random() < 0.95 else 70
        outcomes += [(*key, rng.randrange(end + 10), rng.random() < 0.5) for _ in range(rng.randrange(25))]
    return polls, outcomes


def ticking(polls, outcomes, now):
    """Counts and tells at every microsecond, as a monitor that never sleeps: (messages, runs) of one poller."""
    messages, runs = [], []
    seen = last_miss = first = tried = told = waiting = None
    failed = missed = run = 0
    last = state = None
    for t in range(now + 1):
        for _, outcome in sorted((s, o) for s, u, o in polls if u == t):
            seen, last_miss = t, None
            if outcome == "failure":
                failed, first, last, state = failed + 1, t if first is None else first, t, "failing"
            if outcome == "success":
                if failed + missed:
                    runs.append((run, failed, missed, first, last, t, state))
                    if waiting and waiting["kind"] == "failure":
                        waiting["recovery"] = (told is not None, failed + missed)
                    elif told is not None and not waiting:
                        messages.append((t, "recovery", failed + missed))
                        waiting = {"kind": "recovery"}
                failed = missed = 0
                first = tried = told = last = state = None
                run += 1
        due = True
        for _, sent in sorted((s, s) for u, s in outcomes if u == t):
            if waiting:
                was, waiting = waiting, None
                if was["kind"] == "failure" and failed + missed and first == was["incident"] and sent:
                    told = was["at"]
                if was.get("recovery") and (was["recovery"][0] or sent):
                    messages.append((t, "recovery", was["recovery"][1]))
                    waiting = {"kind": "recovery"}
        if seen is not None and t == (seen + INTERVAL + GRACE if last_miss is None else last_miss + INTERVAL):
            missed, first, last, last_miss, state = missed + 1, t if first is None else first, t, t, "stalled"
        if failed + missed >= 3 and not waiting and t - first >= OUTAGE:
            due = told is None or t - told >= REPEAT
            if tried is not None and (told is None or tried > told):
                due = due and t - tried >= COOLDOWN
            if due:
                messages.append((t, "failure", failed + missed))
                waiting, tried = {"kind": "failure", "at": t, "incident": first}, t
    if failed + missed:
        runs.append((run, failed, missed, first, last, None, state))
    return messages, runs


@pytest.mark.parametrize("seed", range(4))
def test_runs_and_messages(spark, seed):
    polls, outcomes = series(seed)
    now = 300
    p, o = spark.createDataFrame(polls, POLLS), spark.createDataFrame(outcomes, OUTCOMES)
    keys = {r[:2] for r in polls}
    want = {k: ticking([r[2:] for r in polls if r[:2] == k], [r[2:] for r in outcomes if r[:2] == k], now) for k in keys}
    got = poll_health.poll_messages(p, o, now, INTERVAL, GRACE, 3, OUTAGE, COOLDOWN, REPEAT).collect()
    made = {k: sorted((r.us, r.kind, r.failures) for r in got if tuple(r)[:2] == k) for k in keys}
    assert made == {k: sorted(m) for k, (m, _) in want.items()}
    runs = poll_health.poll_runs(p, now, INTERVAL, GRACE).collect()
    assert {k: sorted(tuple(r)[2:9] for r in runs if tuple(r)[:2] == k) for k in keys} == {k: sorted(r) for k, (_, r) in want.items()}
    assert all((r.severity == "error") == (r.failed + r.missed >= 3) for r in runs)
    health = {tuple(r)[:2]: r for r in poll_health.poll_health(p, now, INTERVAL, GRACE).collect()}
    for k in keys:
        open_ = [r for r in want[k][1] if r[5] is None]
        assert (health[k].state, health[k].failures) == ((open_[0][6], open_[0][1] + open_[0][2]) if open_ else ("healthy", 0))
    assert any(m[1] == "recovery" for ms, _ in want.values() for m in ms)


def test_long_silence_costs_nothing(spark):
    polls = spark.createDataFrame([("p", 1, 1, 0, "success")], POLLS)
    none = spark.createDataFrame([], OUTCOMES)
    now = 10**15
    assert poll_health.poll_health(polls, now, 1000, 0).first().failures == now // 1000
    assert [tuple(r)[2:] for r in poll_health.poll_messages(polls, none, now, 1000, 0, outage_us=0).collect()] == [(3000, "failure", 3)]
    assert poll_health.poll_runs(polls.where("us < 0"), now, 10, 0).count() == 0


def test_times_sort_by_instant(spark):
    rng = random.Random(1)
    base, rows = datetime(2024, 2, 28, 23, 30, tzinfo=timezone.utc), []
    for _ in range(300):
        at, ns = base + timedelta(seconds=rng.randrange(4000)), rng.choice([0, 1, 999_999_999, 120_000_000, 120_000_001, rng.randrange(10**9)])
        zone = rng.choice([0, 330, -480, 60])
        text = (at + timedelta(minutes=zone)).strftime("%Y-%m-%dT%H:%M:%S")
        digits = f"{ns:09d}".rstrip("0") if rng.random() < 0.5 else f"{ns:09d}77"
        text += ("." + digits if digits else "") + ("Z" if zone == 0 and rng.random() < 0.5 else f"{'-' if zone < 0 else '+'}{abs(zone) // 60:02d}:{abs(zone) % 60:02d}")
        rows.append((int(at.timestamp()) * 10**9 + ns, text))
    odd = ["2024-02-30T00:00:00Z", "2024-01-01 00:00:00Z", "x", "", "2024-01-01T00:00:00"]
    df = spark.createDataFrame([*rows, *((None, t) for t in odd), (None, None)], "ns long, text string").withColumn("key", records.time_order(F.col("text")))
    got = df.where("text IS NOT NULL").orderBy("key").collect()
    assert [r.ns for r in got[: len(rows)]] == sorted(n for n, _ in rows) and [r.text for r in got[len(rows) :]] == sorted(odd)
    assert df.where("ns IS NOT NULL").groupBy("ns").agg(F.countDistinct("key").alias("n")).where("n > 1").count() == 0
    assert df.where("text IS NULL AND key IS NULL").count() == 1


def test_nested_usage_adds_up(spark):
    rng = random.Random(2)
    names = ["integration_name", "provider", "account_name", "model"]
    rows = [(*[rng.choice(["", "b", "a"]) for _ in names], k, *[rng.randrange(9) for _ in rollup.TOKENS], rng.choice([None, 3])) for k in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", us long, " + ", ".join(f"{t} long" for t in rollup.TOKENS) + ", cost_cents long")
    flat = {tuple(r)[:4]: r for r in df.groupBy(*names).agg(*rollup.measures(), F.max("us").alias("last_us")).collect()}
    seen = 0
    for i in rollup.usage_tree(df).collect():
        assert i.request_count == sum(p.request_count for p in i.providers) and [p.provider for p in i.providers] == sorted(p.provider for p in i.providers)
        for p in i.providers:
            assert p.cost_cents == sum(a.cost_cents for a in p.accounts) and p.last_us == max(a.last_us for a in p.accounts)
            for a in p.accounts:
                for m in a.models:
                    assert tuple(m)[1:] == tuple(flat[i.integration_name, p.provider, a.account_name, m.model])[4:]
                    seen += 1
    assert seen == len(flat)
