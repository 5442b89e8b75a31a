"""Provider payloads as quota samples."""

import json

import pytest

from quotalens.sources import payloads

T0 = 1_704_067_200_000_000
CASES = {
    "anthropic": (
        {"five_hour": {"utilization": 12.5, "resets_at": "2024-01-01T05:00:00Z"}, "seven_day": None, "extra_usage": {"utilization": 1, "is_enabled": False}, "novelty": {"utilization": 3}, "spend": {"x": 1},
         "seven_day_sonnet": {"utilization": 7}, "limits": [{"kind": "weekly_scoped", "percent": 44, "scope": {"model": {"display_name": "Big Model"}}}, {"kind": "weekly_scoped", "percent": 9, "scope": {"model": {"display_name": "Sonnet"}}}, {"kind": "session", "percent": 1}]},
        {("five_hour", 12.5, T0 + 5 * 3_600_000_000), ("seven_day_sonnet", 7.0, None), ("seven_day_scoped_big_model", 44.0, None)},
    ),
    "codex": ({"plan_type": "Free ", "rate_limit": {"primary_window": {"used_percent": 5, "reset_at": 1704067200}}}, {("seven_day", 5.0, T0)}),
    "copilot": ({"copilot_plan": "p", "quota_reset_date": "2024-01-01", "quota_snapshots": {"chat": {"unlimited": True, "percent_remaining": 40}, "premium": {"entitlement": 300, "remaining": 75, "percent_remaining": 25}}}, {("chat", 0.0, T0), ("premium", 75.0, T0)}),
    "zai": ({"data": {"limits": [{"type": "TOKENS_LIMIT", "usage": 200, "currentValue": 50, "nextResetTime": 1704067200000}, {"type": "OTHER"}]}}, {("tokens", 25.0, T0)}),
    "gemini": ({"buckets": [{"remainingFraction": 0.25, "resetTime": "2024-01-01T00:00:00Z", "modelId": "g"}]}, {("g", 75.0, T0)}),
    "minimax": ({"model_remains": [{"model_name": "m", "remains_time": 1000, "current_interval_total_count": 10, "current_interval_usage_count": 4}]}, {("m", 60.0, T0 + 1_000_000)}),
    "antigravity": ({"userStatus": {"cascadeModelConfigData": {"clientModelConfigs": [{"label": "L", "modelOrAlias": {"model": "x"}, "quotaInfo": {"remainingFraction": 0.5}}, {"label": "none"}]}}}, {("x", 50.0, None)}),
    "cursor": ({"billingCycleEnd": "1704067200000", "planUsage": {"totalPercentUsed": 12, "apiPercentUsed": 3, "limit": 2000, "totalSpend": 240}}, {("total_usage", 12.0, T0), ("api_usage", 3.0, T0)}),
    "openrouter": ({"data": {"usage": 5, "limit": 20}}, {("credits", 25.0, None)}),
}


@pytest.mark.parametrize("provider", sorted(payloads.DECODERS))
def test_payload(spark, provider):
    body, expected = CASES[provider]
    df = spark.createDataFrame([(json.dumps(body), T0), ("oops", T0), (None, T0)], "payload string, us long")
    got = payloads.DECODERS[provider](df).collect()
    assert {(r["quota_name"], r["used_percent"], r["resets_us"]) for r in got} == expected


def test_batches(spark):
    event = lambda **x: {"event_id": "evt_1", "captured_at": "2024-01-01T00:00:00Z", "payload": {"a": 1}} | x
    batch = lambda *events, **x: json.dumps({"schema_version": 1, "device_id": "d", "events": list(events)} | x)
    cases = [
        (batch(event()), None), ("oops", "bad_json"), (batch(event(), schema_version=2), "schema_version"), (batch(event(), device_id=""), "device"), (batch(), "events"), (batch(event(event_id="1")), "event_id"),
        (batch(event(captured_at="x")), "captured_at"), (batch(event(captured_at="2024-01-01T00:11:00Z")), "clock_skew"), (batch(event(captured_at="2023-01-01T00:00:00Z")), "too_old"), (batch(event(payload={"deep": [{"api_key": 1}]})), "forbidden_key"),
    ]
    got = payloads.validate_batches(spark.createDataFrame([(c[0],) for c in cases], "body string"), T0).collect()
    assert [r["error"] for r in got] == [c[1] for c in cases]


def test_a_payload_is_decoded_once_a_row(spark):
    """No filter on the made array's size, which would make it again, and one lookup of each quota outside any lambda."""
    df = spark.createDataFrame([(json.dumps(CASES["anthropic"][0]), T0)], "payload string, us long")
    for name, decoder in payloads.DECODERS.items():
        assert "size(" not in decoder(df)._jdf.queryExecution().optimizedPlan().toString(), name
