"""Reset rules, windows and forecasts on small cases worked by hand."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quotalens.functions import pricing
from quotalens.operators import analytics, boundaries, cycles, ingest, insights, records, value
from quotalens.operators.cycles import RULES, Cycle

MIN = 60_000_000
SAMPLE = "provider string, account_id long, quota_name string, snapshot_id long, us long, used_bp long, reset_us long"


def samples(spark, rows, key=("p", 1, "five_hour")):
    return spark.createDataFrame([(*key, k, *r) for k, r in enumerate(rows)], SAMPLE)


def walk(rule, rows):
    c, closed = Cycle(RULES[rule], *rows[0]), []
    for r in rows[1:]:
        if got := c.take(*r):
            closed.append(got)
    return closed, (c.start, c.reset, c.peak, c.delta)


def test_jitter_of_the_reset_time_is_no_reset():
    closed, open_ = walk("anthropic", [(0, 10, 300 * MIN), (MIN, 20, 300 * MIN + 1_000_000), (2 * MIN, 30, 300 * MIN - 1_000_000)])
    assert not closed and open_ == (0, 300 * MIN, 30, 20)


def test_moved_reset_closes_with_its_rise_and_peak():
    closed, open_ = walk("anthropic", [(0, 10, 300 * MIN), (MIN, 40, 300 * MIN), (2 * MIN, 5, 600 * MIN)])
    assert closed == [(0, 2 * MIN, 300 * MIN, 40, 30)] and open_ == (2 * MIN, 600 * MIN, 5, 0)


def test_late_sample_ends_the_cycle_at_its_reset():
    closed, _ = walk("anthropic", [(0, 10, 5 * MIN), (9 * MIN, 20, 5 * MIN)])
    assert closed == [(0, 5 * MIN, 5 * MIN, 20, 10)]


def test_the_closing_sample_is_no_peak_of_a_synthetic_cycle():
    closed, _ = walk("synthetic", [(0, 500, 60 * MIN), (MIN, 900, 25 * 60 * MIN)])
    assert closed == [(0, MIN, 60 * MIN, 500, 400)]


def test_a_shift_must_be_confirmed_for_codex():
    rows = [(0, 5000, 300 * MIN), (MIN, 100, 900 * MIN), (2 * MIN, 5100, 300 * MIN)]
    assert not walk("codex", rows)[0]
    assert len(walk("codex", [*rows[:2], (2 * MIN, 150, 900 * MIN)])[0]) == 1


def test_another_codex_candidate_replaces_the_pending_one():
    rows = [(0, 5000, 300 * MIN), (MIN, 100, 900 * MIN), (2 * MIN, 300, 1500 * MIN), (3 * MIN, 320, 1500 * MIN)]
    closed, open_ = walk("codex", rows)
    assert closed == [(0, 3 * MIN, 300 * MIN, 5000, 0)] and open_ == (3 * MIN, 1500 * MIN, 320, 0)


def test_a_normal_codex_sample_clears_the_candidate():
    rows = [(0, 5000, 300 * MIN), (MIN, 100, 900 * MIN), (2 * MIN, 5100, 301 * MIN), (3 * MIN, 100, 900 * MIN)]
    closed, open_ = walk("codex", rows)
    assert not closed and open_ == (0, 301 * MIN, 5100, 100)


def test_a_codex_candidate_must_come_again_within_five_minutes_and_two_points():
    rows = [(0, 5000, 300 * MIN), (MIN, 100, 900 * MIN)]
    assert not walk("codex", [*rows, (2 * MIN, 301, 900 * MIN)])[0]
    assert not walk("codex", [*rows, (2 * MIN, 100, 906 * MIN)])[0]
    assert walk("codex", [*rows, (2 * MIN, 300, 905 * MIN)])[0]


def test_a_missing_copilot_date_is_the_last_one():
    h = 60 * MIN
    rows = [(0, 10, 24 * h), (MIN, 20, None), (2 * MIN, 30, 48 * h)]
    assert not walk("copilot", rows)[0]
    assert len(walk("copilot", [rows[0], rows[2]])[0]) == 1


def test_null_and_large_accounts_are_keys_like_others(spark):
    big = 9_007_199_254_740_993
    rows = [("p", a, "q", k, k * MIN, 10 * k, None) for k in range(4) for a in (None, big, big - 1)]
    df = spark.createDataFrame(rows, SAMPLE)
    for rule in ("openrouter", "anthropic", "minimax"):
        got = cycles.detect_cycles(df, RULES[rule]).collect()
        assert sorted((r["account_id"] or 0, r["peak_bp"], r["delta_bp"]) for r in got) == [(0, 30, 30), (big - 1, 30, 30), (big, 30, 30)]
    stats = boundaries.cycle_stats(df)
    for found in (boundaries.billing_periods(stats), ingest.thin_meters(df.where("snapshot_id = 0")), value.allowance_cycles(df), analytics.cycle_overview(stats, df)):
        assert sorted(r["account_id"] or 0 for r in found.collect()) == [0, big - 1, big]
    whole = df.groupBy("provider", "account_id", "quota_name").agg(F.min("us").alias("start_us"), (F.max("us")).alias("end_us"))
    assert boundaries.repaired_cycles(whole.withColumn("quota_name", F.lit("five_hour")).withColumn("end_us", F.lit(7 * 60 * MIN)), df.withColumn("quota_name", F.lit("five_hour"))).count() == 3


def test_the_last_sample_of_a_bad_cycle_stays(spark):
    h = 60 * MIN
    df = samples(spark, [(0, 10, 9 * h), (5 * h, 20, 9 * h), (7 * h, 90, 9 * h)])
    whole = boundaries.cycle_stats(df)
    assert [(r["peak_bp"], r["samples"]) for r in boundaries.repaired_cycles(whole, df).collect()] == [(90, 3)]


def test_unknown_rates_and_resets_stay_unknown(spark):
    df = samples(spark, [(10 * MIN, 500, None)])
    r = analytics.burn_rate(df, 20 * MIN, 60 * MIN, MIN).first()
    assert (r["rate"], r["hours_left"], r["projected_bp"], r["exhausts_first"]) == (None, None, None, None)
    df = samples(spark, [(0, 500, None), (10 * MIN, 600, None)])
    r = analytics.burn_rate(df, 20 * MIN, 60 * MIN, MIN).first()
    assert (r["rate"], r["hours_left"], r["projected_bp"]) == (600.0, None, None)


def test_weekly_pace_tiers(spark):
    cases = [(50.0, 50.0, "on_pace", None), (51.0, 50.0, "on_pace", None), (59.9, 50.0, "on_pace", None), (60.0, 50.0, "over", "flat"), (65.0, 50.0, "very_over", "flat"), (97.0, 10.0, "very_over", "time_left"), (92.5, 10.0, "over", "time_left"),
             (40.0, 50.0, "under", "flat"), (35.0, 50.0, "very_under", "flat"), (7.0, 90.0, "very_under", "elapsed"), (8.0, 90.0, "under", "elapsed"), (101.0, 0.0, "very_over", "time_left"), (0.0, 99.5, "on_pace", None)]
    df = spark.createDataFrame([c[:2] for c in cases], "used double, left_share double").coalesce(1)
    got = df.select("used", "left_share", analytics.pace_tier(F.col("used"), F.col("left_share")).alias("p")).select("used", "left_share", "p.*").collect()
    assert [tuple(r) for r in got] == cases


def test_halved_use_is_a_reset_for_openrouter():
    closed, open_ = walk("openrouter", [(0, 100, None), (1, 200, None), (2, 99, None)])
    assert closed == [(0, 2, None, 200, 100)] and open_ == (2, None, 99, 0)


@given(st.lists(st.integers(0, 10_000), min_size=2, max_size=40), st.sampled_from(sorted(RULES)))
def test_cycles_follow_each_other_and_rise_at_least_to_their_peak(used, rule):
    rows = [(k * MIN, u, 600 * MIN * (1 + k // 7)) for k, u in enumerate(used)]
    closed, open_ = walk(rule, rows)
    starts = [c[0] for c in closed] + [open_[0]]
    assert starts == sorted(starts) and starts[0] == 0
    by_time = {r[0]: r[1] for r in rows}
    for start, _, _, peak, delta in closed:
        if RULES[rule].adds == RULES[rule].peaks:
            assert delta >= peak - by_time[start]


def test_detection_in_spark_equals_the_walk(spark):
    rows = [(k * 30 * MIN, (k * 977) % 10_000, None if k % 9 == 0 else 300 * MIN * (1 + k // 10)) for k in range(60)]
    for name, rule in RULES.items():
        got = [tuple(r)[3:] for r in cycles.detect_cycles(samples(spark, rows), rule).collect()]
        closed, (start, reset, peak, delta) = walk(name, rows)
        assert sorted(got, key=lambda r: r[0]) == [*closed, (start, None, reset, peak, delta)]


def test_no_samples_no_cycles(spark):
    assert cycles.detect_cycles(samples(spark, []), RULES["anthropic"]).count() == 0


def test_boundaries(spark):
    h = 60 * MIN
    rows = [(0, 5000, None), (MIN, 5000, 9 * h), (2 * MIN, 5000, 9 * h + 11 * MIN), (3 * MIN, 2500, 9 * h + 11 * MIN), (3 * MIN + 2 * h, 2400, 9 * h + 11 * MIN), (4 * MIN + 2 * h, 2300, 9 * h + 11 * MIN), (5 * MIN + 2 * h, 2400, None)]
    got = [r["is_boundary"] for r in boundaries.reset_boundaries(samples(spark, rows)).orderBy("us").collect()]
    assert got == [False, True, True, True, True, False, True]


def test_two_bursts_without_a_poll_between_are_one_session(spark):
    rows = [(0, 1, None), (MIN, 2, None), (600 * MIN, 3, None), (601 * MIN, 3, None), (800 * MIN, 3, None), (801 * MIN, 4, None)]
    got = boundaries.idle_sessions(samples(spark, rows), 10 * MIN).orderBy("session").collect()
    assert [(r["start_us"], r["end_us"], r["start_bp"], r["max_bp"], r["samples"]) for r in got] == [(MIN, 610 * MIN, 1, 3, 3), (801 * MIN, 811 * MIN, 3, 4, 1)]


def test_asof_takes_the_sample_at_the_same_time(spark):
    left = spark.createDataFrame([(1, 10), (1, 4), (2, 10)], "account_id long, us long")
    right = spark.createDataFrame([(1, 5, 0, 50), (1, 10, 1, 60), (1, 11, 2, 70)], "account_id long, us long, snapshot_id long, used_bp long")
    got = analytics.asof(left, right, ["account_id"], "used_bp", "snapshot_id")
    assert {tuple(r) for r in got.collect()} == {(1, 10, 10, 60), (1, 4, None, None), (2, 10, None, None)}


def test_thinning_counts_from_the_last_kept(spark):
    got = ingest.thin_meters(samples(spark, [(m * MIN, 7, None) for m in (0, 6, 12, 18, 23)]))
    assert sorted(r["us"] // MIN for r in got.collect()) == [0, 12, 23]


def test_replayed_events_change_nothing(spark):
    e = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "event_id long, us long, fingerprint string")
    assert sorted(map(tuple, ingest.dedupe(e.unionByName(e)).collect())) == sorted(map(tuple, ingest.dedupe(e).collect()))


def test_lines_without_json_are_reported(spark):
    lines = ["", "{oops", '{"ts":"2024-01-01T00:00:00Z","integration":"i","provider":"openai","model":"m","metadata":"[]"}', '{"ts":"2024-01-01T00:00:00Z","integration":"i","provider":"openai","model":"m","input_tokens":3}']
    got = ingest.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["error"] for r in got.collect()] == ["empty", "bad_json", "metadata", None]


METER = "provider string, account_id long, quota_name string, plan string, snapshot_id long, us long, used_bp long, reset_us long"
ACTIVITY = "provider string, model string, reasoning_effort string, speed_mode string, us long, end_us long, plan string, requests long, cost_cents long, unknown long, output_tokens long, archived boolean"


def meters(spark, rows, quota="seven_day"):
    return spark.createDataFrame([("p", 1, quota, r[2] if len(r) > 2 else None, k, r[0] * MIN, r[1], 10_000 * MIN) for k, r in enumerate(rows)], METER)


def activity(spark, rows):
    """(minute, cents or None, model, plan, end minute or None: raw)"""
    made = [("p", m, "high", "fast", t * MIN, (t if end is None else end) * MIN, plan, 1, cents or 0, int(cents is None), 10, end is not None) for t, cents, m, plan, end in rows]
    return spark.createDataFrame(made, ACTIVITY)


def test_small_falls_are_rejected_and_counted(spark):
    got = value.allowance_cycles(meters(spark, [(0, 1000), (1, 1400), (2, 1000), (3, 1600), (4, 900)])).orderBy("cycle", "from_us").collect()
    assert [(r["cycle"], r["boundary"], r["rejected"], r["from_bp"], r["to_bp"]) for r in got] == [(0, "first", 1, 1000, 1600), (1, "early_reset", 0, None, None)]


def test_value_of_a_whole_allowance(spark):
    a = activity(spark, [(1, 30, "claude-x", None, None), (3, 20, "claude-x", "plus", None), (4, 99, "claude-x", "pro", None)])
    r = value.subscription_value(meters(spark, [(0, 0, "plus"), (2, 600, "plus"), (5, 1100, "plus")]), a, 5.0, "plus").first()
    assert (r["cost_cents"], r["requests"], r["used_bp"], r["unmatched_bp"], r["unknown"], r["archive_timing"], r["complete"]) == (50, 2, 1100, 0, 0, False, False)
    assert (r["per100_cents"], r["x1_cents"], r["low_cents"], r["high_cents"]) == (round(50e4 / 1100, 4), round(round(50e4 / 1100, 4) / 5, 4), round(50e4 / 1200, 4), 500.0)


def test_unmatched_unknown_and_archived_points_void_the_value(spark):
    m = meters(spark, [(0, 0), (2, 600), (5, 1200)])
    whole = activity(spark, [(1, 30, "m", None, None), (3, 30, "m", None, None)])
    cases = {"unmatched_bp": activity(spark, [(1, 30, "m", None, None)]), "unknown": whole.unionByName(activity(spark, [(4, None, "m", None, None)])), "archive_timing": whole.unionByName(activity(spark, [(1, 5, "m", None, 2)]))}
    for column, a in cases.items():
        r = value.subscription_value(m, a).first()
        assert r[column] and r["per100_cents"] is None
    # an archived hour that ends after the interval is unknown there; the next begins inside it
    r = value.subscription_value(m, whole.unionByName(activity(spark, [(1, 5, "m", None, 4)]))).first()
    assert (r["unknown"], r["cost_cents"], r["archive_timing"]) == (1, 60, True)
    assert value.subscription_value(m, whole).first()["per100_cents"] == 500.0


def test_quota_scopes(spark):
    quotas = ["five_hour", "seven_day_sonnet", "seven_day_opus", "antigravity_claude_gpt:weekly", "antigravity_gemini_pro:x", "antigravity_gemini_flash:x", "extra_usage"]
    models = ["claude-sonnet-4", "claude-opus-5", "gpt-5.6", "gemini-3-pro", "gemini-3-flash", "sonnet"]
    q = spark.createDataFrame([(x,) for x in quotas], "quota string").withColumn("scope", value.quota_scope(F.col("quota")))
    m = spark.createDataFrame([(x,) for x in models], "model string").withColumn("scope", F.explode(value.model_scopes(F.col("model"))))
    got = {}
    for r in q.join(m, "scope").collect():
        got.setdefault(r["quota"], set()).add(r["model"])
    assert got == {"five_hour": set(models), "seven_day_sonnet": {"claude-sonnet-4"}, "seven_day_opus": {"claude-opus-5"}, "antigravity_claude_gpt:weekly": {"claude-sonnet-4", "claude-opus-5", "gpt-5.6"}, "antigravity_gemini_pro:x": {"gemini-3-pro", "gemini-3-flash"}, "antigravity_gemini_flash:x": {"gemini-3-flash"}}


def test_models_are_calibrated_by_unmixed_intervals(spark):
    a = activity(spark, [(1, 30, "m", None, None), (3, 20, "m", None, None), (4, 20, "n", None, None)])
    got = value.model_calibration(meters(spark, [(0, 0), (2, 600), (5, 1200)]), a).collect()
    assert [(r["model"], r["quota_bp"], r["matched_cents"], r["per100_cents"]) for r in got] == [("m", 600, 30, 500.0)]


def test_costs(spark):
    schema = "model string, speed_mode string, input_tokens long, cached_input_tokens long, cache_creation_input_tokens long, cache_creation_1h_input_tokens long, output_tokens long, reasoning_output_tokens long, us long"
    rows = [("GPT-5.6-sol ", "fast", 200_000, 72_000, 1, 0, 10, 5, 0), ("gpt-5.6-sol", "fast", 100, 0, 0, 0, 10, 5, 0), ("gpt-6-astra", "fast", 300_000, 0, 0, 0, 0, 0, 0), ("gpt-5.4-mini", "fast", 100, 0, 0, 0, 0, 0, 0), ("claude-opus-4-7", "fast", 0, 0, 100, 60, 0, 0, 0), ("claude-opus-4-7", "standard", 0, 0, 10, 60, 0, 0, 0), ("", "fast", 1, 0, 0, 0, 0, 0, 0)]
    flat = [(m, None, 1.0, 2.0, 0.5, 4.0, 8.0) for m in ("gpt-5.6-sol", "gpt-6-astra", "openai/gpt-5.4-mini", "anthropic/claude-opus-4-7")]
    prices = spark.createDataFrame(flat, "model string, from_us long, input_cost double, output_cost double, cache_read_cost double, cache_write_cost double, cache_write_1h_cost double")
    priced = pricing.price_asof(spark.createDataFrame(rows, schema), prices)
    got = {(r["model"], r["speed_mode"]): r["cost"] for r in pricing.token_cost(priced).collect()}
    expected = {("GPT-5.6-sol ", "fast"): (200_000 + 36_000 + 4) * 2 + 20 * 1.5, ("gpt-5.6-sol", "fast"): (100 + 20) * 2, ("gpt-6-astra", "fast"): 300_000 * 2 * 2, ("gpt-5.4-mini", "fast"): 100, ("claude-opus-4-7", "fast"): (40 * 4 + 60 * 8) * 6, ("claude-opus-4-7", "standard"): 60 * 8}
    assert got.pop(("", "fast")) is None
    assert {k: round(v * 1e6, 6) for k, v in got.items()} == expected
    assert pricing.token_cost(priced.where("model = 'gpt-5.6-sol'"), True).first()["cost"] == (100 + 30) * 2 / 1e6


def test_credits(spark):
    rows = [("gpt-5.4", "fast", 3, 10, 1, 2), ("gpt-5.5", "fast", 3, 10, 1, 2), ("gpt-5.5", "standard", 3, 10, 1, 2), ("gpt-5.5", "", 3, 10, 1, 2), ("gpt-5.5", "unknown", 3, 10, 1, 2), ("other", "fast", 3, 10, 1, 2)]
    df = spark.createDataFrame(rows, "model string, speed_mode string, input_tokens long, cached_input_tokens long, cache_creation_input_tokens long, output_tokens long").coalesce(1)
    one = lambda i, c, o: (4 * i + 10 * c + 2 * o) / 1e6
    assert [r["credits"] for r in pricing.credits(df).collect()] == [round(x, 9) if x else None for x in (2 * one(62.5, 6.25, 375), 2.5 * one(125, 12.5, 750), one(125, 12.5, 750), None, None, None)]


def test_tables_come_back_as_they_were_exported(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", None), (2, None, 3.5)], "id long, name string, x double")
    insights.export_tables({"one": t, "none": t.where("id > 9")}, str(tmp_path / "out"))
    back = insights.import_tables(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back["one"].collect())) == sorted(map(tuple, t.collect())) and back["none"].count() == 0
    t.write.mode("overwrite").parquet(str(tmp_path / "out/none"))
    with pytest.raises(ValueError):
        insights.import_tables(spark, str(tmp_path / "out"))


def test_earlier_tables_win_and_live_alerts_are_seen(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "id long, v string")
    assert sorted(map(tuple, ingest.first_wins(a, b, key="id").collect())) == [(1, "x"), (2, "z")]
    alerts = spark.createDataFrame([(1, "p", False, None), (2, "p", True, None), (3, "q", False, 5), (4, "q", False, 50)], "id long, provider string, dismissed boolean, until_us long")
    assert sorted(r["id"] for r in insights.system_alerts(alerts, 10).collect()) == [1, 4]
    assert [r["id"] for r in insights.system_alerts(alerts, 10, "q").collect()] == [4]


def test_ranges():
    day = 86_400_000_000
    assert insights.named_range("all", 5) == (None, 5) and insights.named_range(None, 10**12)[0] == 10**12 - 6 * 3_600_000_000
    assert insights.explicit_range(1, 2) == (1, 2)
    assert records.insights_range("30d", 0) == (-30 * day, 0) and records.insights_range("x", 0) == (-7 * day, 0)
    assert records.logging_range(3, None, 0) == (-3 * day, 0, 500)
    for bad in (lambda: insights.named_range("2d", 5), lambda: insights.explicit_range(2, 2), lambda: insights.explicit_range(None, 2), lambda: records.logging_range(31, 1, 0), lambda: records.logging_range(1, 50_001, 0)):
        with pytest.raises(ValueError):
            bad()


def test_caps_fail_loudly(spark):
    assert records.not_over(spark.range(5), 5, "rows").count() == 5
    with pytest.raises(ValueError):
        records.not_over(spark.range(6), 5, "rows")
