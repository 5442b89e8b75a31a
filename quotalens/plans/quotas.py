"""Quota queries: samples, boundaries, sessions, cycles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotalens.operators import boundaries as b
from quotalens.operators import cycles as c
from quotalens.operators import samples as sm
from quotalens.sources.projection import QUOTAS, SAMPLES, USAGE, quota_samples, usage_events

FROM_US, TO_US = 1_704_844_800_000_000, 1_705_708_800_000_000
K = "provider, account_id, quota_name"
ORD = "ORDER BY us, snapshot_id"
WK = f"WINDOW w AS (PARTITION BY {K} {ORD})"
NAMES = [q for q, _ in QUOTAS.values()]
POINTS, STRIDE, TIMEOUT_US, GAP_US = 40, 50, 6 * b.HOUR_US, 3 * b.DAY_US

_BOUND = f"""coalesce(lag(us) OVER w IS NOT NULL AND (
    CASE WHEN reset_us IS NOT NULL AND lag(reset_us) OVER w IS NOT NULL THEN abs(reset_us - lag(reset_us) OVER w) > {10 * b.MINUTE_US}
         ELSE reset_us IS NOT NULL OR lag(reset_us) OVER w IS NOT NULL END
    OR (lag(used_bp) OVER w > 2000 AND lag(used_bp) OVER w - used_bp > 2000)
    OR (us - lag(us) OVER w > {b.HOUR_US} AND used_bp < lag(used_bp) OVER w)), false)"""
_STATS = f"""{SAMPLES}, bo AS (SELECT *, {_BOUND} AS is_boundary FROM qs {WK}),
    sg AS (SELECT *, CAST(sum(CAST(is_boundary AS BIGINT)) OVER w AS BIGINT) AS segment FROM bo {WK}),
    rs AS (SELECT *, coalesce(greatest(used_bp - lag(used_bp) OVER (PARTITION BY {K}, segment {ORD}), 0), 0) AS rise FROM sg),
    cy AS (SELECT {K}, segment, min(us) AS start_us, max(us) AS end_us, max(used_bp) AS peak_bp, CAST(sum(rise) AS BIGINT) AS delta_bp, (list(reset_us {ORD}))[1] AS reset_us, count(*) AS samples FROM rs GROUP BY ALL)"""
_BAD = f"""CASE WHEN quota_name = 'five_hour' THEN end_us - start_us > {6 * b.HOUR_US} WHEN starts_with(quota_name, 'seven_day') THEN end_us - start_us > {8 * b.DAY_US}
    WHEN quota_name = 'monthly' THEN end_us - start_us > {32 * b.DAY_US} ELSE false END"""
#: Cycles that a repair is run on: one a key, from its first sample to its last.
_WHOLE = f"wh AS (SELECT {K}, min(us) AS start_us, max(us) AS end_us FROM qs GROUP BY ALL)"


def _whole(rows):
    return rows.groupBy(*sm.KEY).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def cycles_sql(rule: c.Rule) -> str:
    """The rule as a recursive query: one step a sample of each key, in order."""
    h = b.HOUR_US
    old = "f.reset" if rule.shift_from == "stored" else "f.last_reset"
    late = "(f.reset IS NOT NULL AND s.us > f.reset)"
    past = "false" if rule.past_us is None else f"(f.reset IS NOT NULL AND s.us > f.reset + {rule.past_us})"
    if rule.shift_us is None:
        shift = "false"
    else:
        differs = f"s.reset_us // {h} <> {old} // {h}" if rule.whole_hours else f"abs(s.reset_us - {old}) > {rule.shift_us}"
        shift = f"(s.reset_us IS NOT NULL AND {old} IS NOT NULL AND {differs}" + (f" AND f.last - s.used_bp > {rule.fell_bp})" if rule.fell_bp is not None else ")")
    more = []
    if rule.appeared:
        more.append("(s.reset_us IS NOT NULL AND f.reset IS NULL)")
    if rule.drop_bp is not None:
        more.append(f"(f.last - s.used_bp > {rule.drop_bp})")
    if rule.past_fell:
        more.append(f"({late} AND f.last > s.used_bp)")
    if rule.below:
        more.append(f"(s.used_bp * {rule.below[1]} < f.last * {rule.below[0]})")
    if rule.confirm:
        shift = f"coalesce(f.reset IS NOT NULL AND {shift}, false)"
        confirmed = f"({shift} AND coalesce(abs(s.reset_us - f.p_reset) <= 300000000 AND s.used_bp <= f.p_used + 200, false))"
        skip = f"(NOT {past} AND {shift} AND NOT {confirmed})"
        shift = confirmed
    else:
        skip = "false"
    ended = f"(NOT {skip} AND coalesce({' OR '.join([past, shift, *more])}, false))"
    rise = "greatest(s.used_bp - f.last, 0)"
    end = f"CASE WHEN {late} THEN f.reset ELSE s.us END" if rule.ends_at_reset else "s.us"
    peak = "greatest(f.peak, s.used_bp)" if rule.peaks else "f.peak"
    delta = f"f.delta + {rise}" if rule.adds else "f.delta"
    kept = "coalesce(s.reset_us, f.reset)" if rule.rolls else "f.reset"
    last = "s.reset_us" if rule.forgets else "coalesce(s.reset_us, f.last_reset)"
    return f"""WITH RECURSIVE {SAMPLES}, s AS MATERIALIZED (SELECT {K}, us, used_bp, CAST(reset_us AS BIGINT) AS reset_us, row_number() OVER w AS rn FROM qs {WK}),
    f AS (SELECT {K}, rn, us AS start_us, reset_us AS reset, used_bp AS peak, CAST(0 AS BIGINT) AS delta, used_bp AS last, reset_us AS last_reset, CAST(NULL AS BIGINT) AS p_reset, CAST(NULL AS BIGINT) AS p_used,
        false AS ended, CAST(NULL AS BIGINT) AS c_start, CAST(NULL AS BIGINT) AS c_end, CAST(NULL AS BIGINT) AS c_reset, CAST(NULL AS BIGINT) AS c_peak, CAST(NULL AS BIGINT) AS c_delta FROM s WHERE rn = 1
    UNION ALL SELECT s.provider, s.account_id, s.quota_name, s.rn,
        CASE WHEN {ended} THEN s.us ELSE f.start_us END, CASE WHEN {ended} THEN s.reset_us WHEN {skip} THEN f.reset ELSE {kept} END,
        CASE WHEN {ended} THEN s.used_bp WHEN {skip} THEN f.peak ELSE greatest(f.peak, s.used_bp) END, CASE WHEN {ended} THEN 0 WHEN {skip} THEN f.delta ELSE f.delta + {rise} END,
        CASE WHEN {skip} THEN f.last ELSE s.used_bp END, CASE WHEN {skip} THEN f.last_reset ELSE {last} END,
        CASE WHEN {skip} THEN s.reset_us ELSE NULL END, CASE WHEN {skip} THEN s.used_bp ELSE NULL END,
        {ended}, f.start_us, {end}, f.reset, {peak}, {delta}
        FROM f JOIN s ON s.provider = f.provider AND s.account_id IS NOT DISTINCT FROM f.account_id AND s.quota_name = f.quota_name AND s.rn = f.rn + 1)
    SELECT {K}, c_start AS start_us, c_end AS end_us, c_reset AS reset_us, c_peak AS peak_bp, c_delta AS delta_bp FROM f WHERE ended
    UNION ALL SELECT {K}, start_us, NULL, reset, peak, delta FROM f QUALIFY rn = max(rn) OVER (PARTITION BY {K})"""


def _rule(rule):
    return lambda s, d: c.detect_cycles(quota_samples(s, d), rule)


_CARRY = ", ".join(f"last_value(CASE WHEN quota_name = '{n}' THEN used_bp END IGNORE NULLS) OVER w AS {n}" for n in NAMES)
_COUNTERS = ["input_tokens", "cached_input_tokens", "output_tokens"]
_GOES = "coalesce(model = lag(model) OVER w, false)" + "".join(f" AND {x} >= lag({x}) OVER w" for x in _COUNTERS)

def _values(s, d):
    """Values under the id of the first snapshot of their account and day."""
    day = Window.partitionBy("provider", "account_id", F.expr("us DIV 86400000000"))
    return quota_samples(s, d).select(F.min("snapshot_id").over(day).alias("snapshot_id"), "quota_name", "used_bp")


def _headers(s, d):
    return quota_samples(s, d).groupBy("provider", "account_id", F.expr("us DIV 86400000000")).agg(F.min("snapshot_id").alias("snapshot_id"), F.min("us").alias("us")).select("snapshot_id", "us")


_HEADERS = """vl AS (SELECT min(snapshot_id) OVER (PARTITION BY provider, account_id, us // 86400000000) AS snapshot_id, quota_name, used_bp FROM qs),
    hd AS (SELECT min(snapshot_id) AS snapshot_id, min(us) AS us FROM qs GROUP BY provider, account_id, us // 86400000000)"""

QUERIES = {
    "range_scan": (lambda s, d: sm.in_range(quota_samples(s, d), FROM_US, TO_US, 500), f"WITH {SAMPLES} SELECT * FROM qs WHERE us >= {FROM_US} AND us < {TO_US} ORDER BY us DESC, snapshot_id DESC LIMIT 500"),
    "latest_snapshot": (lambda s, d: sm.latest_snapshot(quota_samples(s, d)), f"WITH {SAMPLES} SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY provider, account_id ORDER BY us DESC, snapshot_id DESC) = 1"),
    "latest_per_quota": (
        lambda s, d: sm.latest_per_quota(quota_samples(s, d), 2000),
        f"WITH {SAMPLES} SELECT * FROM (SELECT * FROM qs QUALIFY snapshot_id >= max(snapshot_id) OVER (PARTITION BY provider) - 2000) QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY us DESC, snapshot_id DESC) = 1",
    ),
    "utilization_series": (
        lambda s, d: sm.utilization_series(_headers(s, d), _values(s, d).where("used_bp % 3 != 0"), "left"),
        f"""WITH {SAMPLES}, {_HEADERS} SELECT h.snapshot_id, h.us, quota_name, used_bp FROM hd h LEFT JOIN (SELECT * FROM vl WHERE used_bp % 3 <> 0) v USING (snapshot_id)""",
    ),
    "headers_with_values": (
        lambda s, d: sm.with_values(_headers(s, d), _values(s, d).where("used_bp > 8000")),
        f"WITH {SAMPLES}, {_HEADERS} SELECT snapshot_id, us FROM hd WHERE snapshot_id IN (SELECT snapshot_id FROM vl WHERE used_bp > 8000)",
    ),
    "logging_history": (lambda s, d: sm.logging_history(quota_samples(s, d)), f"WITH {SAMPLES} SELECT {K}, snapshot_id, us, used_bp, used_bp - lag(used_bp) OVER w AS delta_bp FROM qs {WK}"),
    "locf_history": (
        lambda s, d: sm.carry_forward(quota_samples(s, d), NAMES),
        f"WITH {SAMPLES} SELECT provider, account_id, snapshot_id, us, {_CARRY} FROM qs WINDOW w AS (PARTITION BY provider, account_id {ORD} ROWS UNBOUNDED PRECEDING)",
    ),
    "sampled_range": (
        lambda s, d: sm.range_sampled(quota_samples(s, d), POINTS),
        f"""WITH {SAMPLES}, fl AS (SELECT provider, snapshot_id, us, coalesce(used_bp < lag(used_bp) OVER w, false) AS is_reset FROM qs {WK}),
        en AS (SELECT *, min(us) OVER p AS t0, max(us) OVER p AS t1, count(*) OVER p AS n, row_number() OVER (PARTITION BY provider {ORD}) AS i FROM fl WINDOW p AS (PARTITION BY provider)),
        bu AS (SELECT *, CAST(least({POINTS - 1}, (us - t0) * {POINTS - 1} // greatest(t1 - t0, 1)) AS BIGINT) AS bucket FROM en),
        rk AS (SELECT *, row_number() OVER (PARTITION BY provider, bucket ORDER BY is_reset DESC, us DESC, snapshot_id DESC) AS r FROM bu)
        SELECT provider, snapshot_id, us, bucket, is_reset FROM rk WHERE n <= {POINTS} OR i = 1 OR i = n OR (bucket > 0 AND bucket < {POINTS - 1} AND r = 1)""",
    ),
    "row_rank_sampled": (
        lambda s, d: sm.rank_sampled(quota_samples(s, d), POINTS),
        f"""WITH {SAMPLES}, nu AS (SELECT *, row_number() OVER (PARTITION BY provider {ORD}) AS i, count(*) OVER (PARTITION BY provider) AS n FROM qs)
        SELECT * EXCLUDE (i, n) FROM nu WHERE i = 1 OR n <= {POINTS} OR (i - 1) * {POINTS - 1} // greatest(n - 1, 1) > (i - 2) * {POINTS - 1} // greatest(n - 1, 1)""",
    ),
    "stride_downsample": (
        lambda s, d: sm.stride(quota_samples(s, d), STRIDE),
        f"""WITH {SAMPLES}, nu AS (SELECT *, row_number() OVER (PARTITION BY provider {ORD}) AS i, count(*) OVER (PARTITION BY provider) AS n FROM qs)
        SELECT * EXCLUDE (i, n) FROM nu WHERE (i - 1) % greatest(1, (n + {STRIDE - 1}) // {STRIDE}) = 0 OR i = n""",
    ),
    "reset_boundaries": (lambda s, d: b.reset_boundaries(quota_samples(s, d)), f"WITH {SAMPLES} SELECT *, {_BOUND} AS is_boundary FROM qs {WK}"),
    "cycle_stats": (lambda s, d: b.cycle_stats(quota_samples(s, d)), f"WITH {_STATS} SELECT * FROM cy"),
    "bad_cycles": (lambda s, d: b.bad_cycles(_whole(quota_samples(s, d))), f"WITH {SAMPLES}, {_WHOLE} SELECT * FROM wh WHERE {_BAD}"),
    "repaired_cycles": (
        lambda s, d: b.repaired_cycles(_whole(quota_samples(s, d)), quota_samples(s, d)),
        f"""WITH {SAMPLES}, {_WHOLE}, bad AS (SELECT * FROM wh WHERE {_BAD}),
        hd AS (SELECT qs.*, bad.start_us AS cycle_us FROM qs JOIN bad ON qs.provider = bad.provider AND qs.account_id IS NOT DISTINCT FROM bad.account_id AND qs.quota_name = bad.quota_name WHERE us >= start_us AND us <= end_us),
        bo AS (SELECT *, {_BOUND} AS is_boundary, lag(used_bp) OVER w AS before FROM hd {WK}),
        sg AS (SELECT *, CAST(sum(CAST(is_boundary AS BIGINT)) OVER w AS BIGINT) AS segment FROM bo {WK})
        SELECT {K}, cycle_us, segment, min(us) AS start_us, max(used_bp) AS peak_bp, CAST(sum(CASE WHEN is_boundary THEN 0 ELSE greatest(coalesce(used_bp - before, 0), 0) END) AS BIGINT) AS delta_bp, count(*) AS samples FROM sg GROUP BY ALL""",
    ),
    "billing_periods": (
        lambda s, d: b.billing_periods(b.cycle_stats(quota_samples(s, d))),
        f"""WITH RECURSIVE {_STATS}, n AS MATERIALIZED (SELECT {K}, start_us, peak_bp, delta_bp, row_number() OVER (PARTITION BY {K} ORDER BY start_us) AS rn FROM cy),
        f AS (SELECT *, CAST(0 AS BIGINT) AS period, peak_bp AS run FROM n WHERE rn = 1
        UNION ALL SELECT n.*, f.period + CASE WHEN f.run > 500 AND 2 * n.peak_bp < f.run THEN 1 ELSE 0 END, CASE WHEN f.run > 500 AND 2 * n.peak_bp < f.run THEN n.peak_bp ELSE greatest(f.run, n.peak_bp) END
            FROM f JOIN n ON n.provider = f.provider AND n.account_id IS NOT DISTINCT FROM f.account_id AND n.quota_name = f.quota_name AND n.rn = f.rn + 1)
        SELECT {K}, period, min(start_us) AS start_us, count(*) AS cycles, max(peak_bp) AS peak_bp, CAST(sum(delta_bp) AS BIGINT) AS delta_bp FROM f GROUP BY ALL""",
    ),
    "billing_summary": (
        lambda s, d: b.billing_summary(b.billing_periods(b.cycle_stats(quota_samples(s, d)))),
        f"""WITH RECURSIVE {_STATS}, n AS MATERIALIZED (SELECT {K}, start_us, peak_bp, row_number() OVER (PARTITION BY {K} ORDER BY start_us) AS rn FROM cy),
        f AS (SELECT *, CAST(0 AS BIGINT) AS period, peak_bp AS run FROM n WHERE rn = 1
        UNION ALL SELECT n.*, f.period + CASE WHEN f.run > 500 AND 2 * n.peak_bp < f.run THEN 1 ELSE 0 END, CASE WHEN f.run > 500 AND 2 * n.peak_bp < f.run THEN n.peak_bp ELSE greatest(f.run, n.peak_bp) END
            FROM f JOIN n ON n.provider = f.provider AND n.account_id IS NOT DISTINCT FROM f.account_id AND n.quota_name = f.quota_name AND n.rn = f.rn + 1),
        p AS (SELECT {K}, period, max(peak_bp) AS peak_bp FROM f GROUP BY ALL)
        SELECT {K}, count(*) AS periods, CAST(sum(peak_bp) AS BIGINT) AS total_peak_bp, round(avg(peak_bp), 6) AS avg_peak_bp, max(peak_bp) AS max_peak_bp FROM p GROUP BY ALL""",
    ),
    "bad_cycles_synthetic": (
        lambda s, d: b.bad_cycles(_whole(quota_samples(s, d).withColumn("quota_name", F.when(F.col("quota_name") == "five_hour", "search").when(F.col("quota_name") == "daily", "subscription").otherwise(F.col("quota_name")))), "synthetic"),
        f"""WITH {SAMPLES}, {_WHOLE}, n AS (SELECT * REPLACE (CASE quota_name WHEN 'five_hour' THEN 'search' WHEN 'daily' THEN 'subscription' ELSE quota_name END AS quota_name) FROM wh)
        SELECT * FROM n WHERE (quota_name = 'search' AND end_us - start_us > {2 * b.HOUR_US}) OR (quota_name = 'subscription' AND end_us - start_us > {48 * b.HOUR_US})""",
    ),
    "sessions_idle": (
        lambda s, d: b.idle_sessions(quota_samples(s, d), TIMEOUT_US),
        f"""WITH {SAMPLES}, ch AS (SELECT *, coalesce(used_bp <> lag(used_bp) OVER w, false) AS changed, lag(us) OVER w AS before_us, lag(used_bp) OVER w AS before FROM qs {WK}),
        la AS (SELECT *, max(CASE WHEN changed THEN us END) OVER (PARTITION BY {K} {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_us FROM ch),
        op AS (SELECT *, changed AND (last_us IS NULL OR before_us - last_us > {TIMEOUT_US}) AS opens FROM la),
        se AS (SELECT *, CAST(sum(CAST(opens AS BIGINT)) OVER w AS BIGINT) AS session FROM op {WK})
        SELECT {K}, session, min(us) AS start_us, max(CASE WHEN changed THEN us END) + {TIMEOUT_US} AS end_us, max(CASE WHEN opens THEN before END) AS start_bp, max(CASE WHEN changed THEN used_bp END) AS max_bp, count(*) AS samples
        FROM se WHERE session > 0 AND (changed OR us - last_us <= {TIMEOUT_US}) GROUP BY ALL""",
    ),
    "sessions_split": (
        lambda s, d: b.split_sessions(quota_samples(s, d), GAP_US),
        f"""WITH {SAMPLES}, sp AS (SELECT *, CASE WHEN coalesce(us - lag(us) OVER w > {GAP_US} OR used_bp < lag(used_bp) OVER w OR abs(coalesce(reset_us, 0) - coalesce(lag(reset_us) OVER w, 0)) > 1000000, false) THEN 1 ELSE 0 END AS split FROM qs {WK}),
        se AS (SELECT *, CAST(sum(split) OVER w AS BIGINT) AS session FROM sp {WK})
        SELECT {K}, session, min(us) AS start_us, max(us) AS end_us, min(used_bp) AS start_bp, max(used_bp) AS max_bp, count(*) AS samples FROM se GROUP BY ALL""",
    ),
    "cumulative_delta": (
        lambda s, d: b.cumulative_delta(usage_events(s, d)),
        f"""WITH {USAGE} SELECT event_id, source_path, {_GOES} AS goes_on, {', '.join(f'CASE WHEN {_GOES} THEN {x} - lag({x}) OVER w ELSE {x} END AS {x}' for x in _COUNTERS)}
        FROM ue WINDOW w AS (PARTITION BY source_path ORDER BY us, event_id)""",
    ),
    "daily_usage": (
        lambda s, d: b.daily_usage(quota_samples(s, d)),
        f"WITH {SAMPLES}, r AS (SELECT *, used_bp - lag(used_bp) OVER w AS rise FROM qs {WK}) SELECT {K}, us // 86400000000 AS day, CAST(sum(rise) AS BIGINT) AS rise_bp FROM r WHERE rise > 0 GROUP BY ALL",
    ),
    **{f"cycles_{name}": (_rule(rule), cycles_sql(rule)) for name, rule in c.RULES.items()},
}
