"""Subscription value: meters, allowance cycles, value and calibration. The SQL joins every interval with its requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotalens.operators import rollup
from quotalens.operators import value as val
from quotalens.sources.projection import SAMPLES, quota_samples, usage_events

from .quotas import K, ORD
from .usage import ARCHIVE, CUT_US

PLAN_CHANGE_US = 1_705_500_000_000_000
_METER_PLAN = f"CASE coalesce(account_id, 0) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'plus' ELSE CASE WHEN us < {PLAN_CHANGE_US} THEN 'plus' ELSE 'pro' END END"
_EVENT_PLAN = "CASE event_id % 6 WHEN 0 THEN 'plus' WHEN 1 THEN 'pro' ELSE NULL END"


def _meters(s, d):
    q = quota_samples(s, d).withColumn("plan", F.expr(_METER_PLAN))
    return val.value_meters(q.where("snapshot_id % 2 = 0"), q.where("snapshot_id % 2 = 1"))


def _activity(s, d):
    e = usage_events(s, d)
    return val.value_activity(e.where(f"us >= {CUT_US}").withColumn("plan", F.expr(_EVENT_PLAN)), rollup.compact_hourly(e.where(f"us < {CUT_US}")))


_BOTH = f"""{ARCHIVE}, {SAMPLES[SAMPLES.index('qs AS'):]},
    qp AS (SELECT *, {_METER_PLAN} AS plan, CASE WHEN snapshot_id % 2 = 0 THEN 'poll' ELSE 'rollout' END AS source FROM qs),
    mt AS (SELECT * FROM qp m WHERE source = 'poll' OR NOT EXISTS (SELECT 1 FROM qp p WHERE p.source = 'poll' AND p.provider = m.provider AND p.account_id IS NOT DISTINCT FROM m.account_id AND p.quota_name = m.quota_name AND abs(p.us - m.us) <= 600000000)),
    act AS (SELECT provider, model, reasoning_effort, speed_mode, us, us AS end_us, coalesce({_EVENT_PLAN}, '') AS plan, 1 AS requests, coalesce(cost_cents, 0) AS cents, CAST(cost_cents IS NULL AS BIGINT) AS unknown, output_tokens, false AS archived FROM ue WHERE us >= {CUT_US}
        UNION ALL SELECT provider, model, reasoning_effort, speed_mode, first_us, last_us, '', request_count, cost_cents, unpriced, output_tokens, true FROM archive)"""

_SAME = "(s.plan = f.plan AND ((s.r IS NULL AND f.r IS NULL) OR coalesce(abs(s.r - f.r) <= 60000000, false)))"
_REJ = f"({_SAME} AND s.bp < f.bp AND f.bp - s.bp <= 500)"
_NEW = f"(NOT {_REJ} AND (s.plan <> f.plan OR s.bp < f.bp OR coalesce(abs(s.r - f.r) > 60000000, false)))"
_LAST = "(s.np IS NULL OR s.np <> s.plan OR s.nb < s.bp - 500 OR coalesce(abs(s.nr - s.r) > 60000000, false))"
_HIT = f"(NOT {_REJ} AND NOT {_NEW} AND s.us > f.us AND f.e_bp < 10000 AND (s.bp - f.a_bp >= 500 OR s.bp >= 10000 OR (s.bp > f.a_bp AND {_LAST})))"
_BOUNDARY = "CASE WHEN f.r IS NOT NULL AND s.us >= f.r THEN 'scheduled' WHEN s.bp < f.bp THEN 'early_reset' ELSE 'correction' END"
_IV = f"""{_BOTH}, la AS (SELECT {K}, coalesce(plan, '') AS plan, us, snapshot_id, used_bp AS bp, CAST(reset_us AS BIGINT) AS r, lead(coalesce(plan, '')) OVER w AS np, lead(used_bp) OVER w AS nb, lead(CAST(reset_us AS BIGINT)) OVER w AS nr FROM mt WINDOW w AS (PARTITION BY {K} {ORD})),
    s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {K} {ORD}) AS rn FROM la WHERE bp BETWEEN 0 AND 10000),
    f AS (SELECT {K}, rn, plan, us, bp, r, CAST(0 AS BIGINT) AS cycle, us AS a_us, bp AS a_bp, bp AS e_bp, plan AS c_plan, 'first' AS boundary, us AS c_us, bp AS c_bp, r AS c_r, 0 AS rejects, false AS closed, CAST(NULL AS BIGINT) AS i_us, CAST(NULL AS BIGINT) AS i_bp FROM s WHERE rn = 1
    UNION ALL SELECT s.provider, s.account_id, s.quota_name, s.rn, CASE WHEN {_REJ} THEN f.plan ELSE s.plan END, CASE WHEN {_REJ} THEN f.us ELSE s.us END, CASE WHEN {_REJ} THEN f.bp ELSE s.bp END, CASE WHEN {_REJ} THEN f.r ELSE s.r END,
        CASE WHEN {_NEW} THEN f.cycle + 1 ELSE f.cycle END, CASE WHEN {_NEW} OR {_HIT} THEN s.us ELSE f.a_us END, CASE WHEN {_NEW} OR {_HIT} THEN s.bp ELSE f.a_bp END, CASE WHEN {_NEW} OR {_HIT} THEN s.bp ELSE f.e_bp END,
        CASE WHEN {_NEW} THEN s.plan ELSE f.c_plan END, CASE WHEN {_NEW} THEN {_BOUNDARY} ELSE f.boundary END, CASE WHEN {_NEW} THEN s.us ELSE f.c_us END, CASE WHEN {_NEW} THEN s.bp ELSE f.c_bp END, CASE WHEN {_NEW} THEN s.r ELSE f.c_r END,
        CASE WHEN {_NEW} THEN 0 WHEN {_REJ} THEN f.rejects + 1 ELSE f.rejects END, {_HIT}, f.a_us, f.a_bp
        FROM f JOIN s ON s.provider = f.provider AND s.account_id IS NOT DISTINCT FROM f.account_id AND s.quota_name = f.quota_name AND s.rn = f.rn + 1),
    cy AS (SELECT {K}, cycle, c_plan AS plan, boundary, c_us AS start_us, c_bp AS start_bp, c_r AS reset_us, CAST(max(rejects) AS BIGINT) AS rejected, bool_or(closed) AS any_closed FROM f GROUP BY ALL),
    iv AS (SELECT {K}, cycle, i_us AS from_us, us AS to_us, i_bp AS from_bp, bp AS to_bp FROM f WHERE closed)"""
_SCOPED = """CASE WHEN x.quota_name IN ('five_hour', 'seven_day', 'weekly') THEN true WHEN x.quota_name = 'seven_day_sonnet' THEN starts_with(a.model, 'claude-') AND contains(a.model, 'sonnet')
    WHEN x.quota_name = 'seven_day_opus' THEN starts_with(a.model, 'claude-') AND contains(a.model, 'opus') ELSE false END"""
_SUMS = f"""{_IV}, x AS (SELECT iv.*, cy.plan, cy.boundary, cy.start_us, cy.start_bp, cy.reset_us, cy.rejected FROM iv JOIN cy ON iv.provider = cy.provider AND iv.account_id IS NOT DISTINCT FROM cy.account_id AND iv.quota_name = cy.quota_name AND iv.cycle = cy.cycle),
    su AS (SELECT x.*, coalesce(sum(a.requests) FILTER (a.end_us <= to_us), 0) AS requests, coalesce(sum(a.cents) FILTER (a.end_us <= to_us), 0) AS cents, coalesce(sum(a.output_tokens) FILTER (a.end_us <= to_us), 0) AS output,
        coalesce(sum(CASE WHEN a.end_us <= to_us THEN a.unknown ELSE a.requests END), 0) AS unknown, coalesce(bool_or(a.archived) FILTER (a.end_us <= to_us), false) AS held,
        count(DISTINCT concat_ws('|', a.model, a.reasoning_effort, a.speed_mode)) FILTER (a.end_us <= to_us) AS kinds, min(concat_ws('|', a.model, a.reasoning_effort, a.speed_mode)) FILTER (a.end_us <= to_us) AS kind
        FROM x LEFT JOIN act a ON a.provider = x.provider AND a.us > x.from_us AND a.us <= x.to_us AND (a.plan = '' OR x.plan = '' OR a.plan = x.plan) AND {_SCOPED} GROUP BY ALL),
    st AS (SELECT su.*, held OR EXISTS (SELECT 1 FROM act a WHERE a.archived AND a.provider = su.provider AND a.us <= su.from_us AND a.end_us > su.from_us) AS taint FROM su)"""
_HEAD = f"{K}, cycle, plan, boundary, start_us, start_bp, reset_us, rejected"
_VALUE = f"""WITH RECURSIVE {_SUMS}, c AS (SELECT {_HEAD}, max(to_us) AS end_us, max(to_bp) AS end_bp, CAST(sum(cents) AS BIGINT) AS cost_cents, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(unknown) AS BIGINT) AS unknown,
        CAST(coalesce(sum(to_bp - from_bp) FILTER (requests = 0), 0) AS BIGINT) AS unmatched_bp, bool_or(taint) AS archive_timing FROM st GROUP BY ALL
    UNION ALL SELECT {_HEAD}, start_us, start_bp, 0, 0, 0, 0, false FROM (SELECT * FROM cy WHERE NOT any_closed QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY cycle DESC) = 1)),
    d AS (SELECT *, end_bp - start_bp AS used_bp, unknown = 0 AND unmatched_bp = 0 AND NOT archive_timing AND cost_cents > 0 AS clean FROM c),
    e AS (SELECT *, CASE WHEN clean AND used_bp >= 500 THEN cost_cents * CAST(10000 AS DOUBLE) END AS w FROM d),
    g AS (SELECT * EXCLUDE (clean, w), round(w / used_bp, 4) AS per100_cents, round(w / least(10000, used_bp + 100), 4) AS low_cents, round(w / greatest(100, used_bp - 100), 4) AS high_cents, clean AND start_bp <= 100 AND end_bp >= 9900 AS complete FROM e)
    SELECT *, CASE WHEN plan IN ('', 'pro') THEN round(per100_cents / 5, 4) END AS x1_cents FROM g"""
#: Requests whose speed and price change with the day, so that intervals hold one kind, several, unknown prices, or archived hours.
_DAYS = {"model": "'claude-sonnet'", "reasoning_effort": "'high'", "speed_mode": "CASE WHEN {day} % 3 = 0 THEN 'fast' ELSE 'standard' END", "unknown": "CASE WHEN {day} % 5 = 4 THEN requests ELSE 0 END"}


def _by_day(s, d):
    return _activity(s, d).withColumns({c: F.expr(x.format(day="us DIV 86400000000")) for c, x in _DAYS.items()})


_DAY_SUMS = _SUMS.replace("act AS (", "act0 AS (").replace(", la AS (", ", act AS (SELECT * REPLACE (" + ", ".join(f"{x.format(day='us // 86400000000')} AS {c}" for c, x in _DAYS.items()) + ") FROM act0), la AS (")
_CALIBRATION = f"""WITH RECURSIVE {_DAY_SUMS}, o AS (SELECT split_part(kind, '|', 1) AS model, split_part(kind, '|', 2) AS reasoning_effort, split_part(kind, '|', 3) AS speed_mode, to_bp - from_bp AS bp, cents, output FROM st
        WHERE quota_name IN ('seven_day', 'weekly') AND to_bp - from_bp >= 500 AND kinds = 1 AND unknown = 0 AND requests > 0 AND NOT taint),
    t AS (SELECT model, reasoning_effort, speed_mode, CAST(sum(bp) AS BIGINT) AS quota_bp, CAST(sum(cents) AS BIGINT) AS matched_cents, CAST(sum(output) AS BIGINT) AS matched_output FROM o GROUP BY ALL)
    SELECT *, round(matched_cents * CAST(10000 AS DOUBLE) / quota_bp, 4) AS per100_cents, round(matched_output * CAST(100 AS DOUBLE) / quota_bp, 4) AS output_per_point FROM t"""

QUERIES = {
    "value_activity": (_activity, f"WITH {_BOTH} SELECT provider, model, reasoning_effort, speed_mode, us, end_us, nullif(plan, '') AS plan, requests, cents AS cost_cents, unknown, output_tokens, archived FROM act"),
    "value_meters": (lambda s, d: _meters(s, d).drop("reset_us"), f"WITH {_BOTH} SELECT * EXCLUDE (reset_us) FROM mt"),
    "allowance_cycles": (
        lambda s, d: val.allowance_cycles(_meters(s, d)),
        f"""WITH RECURSIVE {_IV} SELECT {', '.join('cy.' + c for c in _HEAD.split(', '))}, from_us, to_us, from_bp, to_bp FROM cy LEFT JOIN iv
        ON iv.provider = cy.provider AND iv.account_id IS NOT DISTINCT FROM cy.account_id AND iv.quota_name = cy.quota_name AND iv.cycle = cy.cycle""",
    ),
    "subscription_value": (lambda s, d: val.subscription_value(_meters(s, d), _activity(s, d), 5.0, "pro"), _VALUE),
    "model_calibration": (lambda s, d: val.model_calibration(_meters(s, d), _by_day(s, d)), _CALIBRATION),
}
