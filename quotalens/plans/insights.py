"""Summaries, forecasts, groupings, ingest and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotalens.operators import alerts, boundaries, ingest
from quotalens.operators import analytics as an
from quotalens.operators import samples as sm
from quotalens.sources.projection import SAMPLES, USAGE, quota_samples, usage_events

from .quotas import _STATS, K, ORD, WK

NOW_US = 1_705_708_800_000_000  # 2024-01-20
WINDOW_US, LEAST_US = 5 * an.DAY_US, 300_000_000
HOUR, DAY, WEEK = an.HOUR_US, an.DAY_US, an.WEEK_US
LATEST = f"la AS (SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY us DESC, snapshot_id DESC) = 1)"
STATUS = "CASE WHEN {0} >= 9500 THEN 'critical' WHEN {0} >= 8000 THEN 'danger' WHEN {0} >= 5000 THEN 'warning' ELSE 'healthy' END"
RANK = "CASE WHEN used_bp >= 9500 THEN 3 WHEN used_bp >= 8000 THEN 2 WHEN used_bp >= 5000 THEN 1 ELSE 0 END"


def _q(s, d):
    return quota_samples(s, d)


def _noisy(s, d):
    """Samples whose use does not follow the clock."""
    return _q(s, d).withColumn("used_bp", F.expr("used_bp * 7 % 10000"))


_NOISY = f"{SAMPLES}, qn AS (SELECT * REPLACE (used_bp * 7 % 10000 AS used_bp) FROM qs)"


def _latest(s, d):
    return sm.latest_per_quota(quota_samples(s, d))


def _cycles(s, d):
    return boundaries.cycle_stats(quota_samples(s, d))


def _meters(s, d):
    return _q(s, d).withColumn("source", F.when(F.col("snapshot_id") % 2 == 0, "poll").otherwise("rollout"))


def _arrival():
    return F.col("us") + (F.col("snapshot_id") % 10) * 60_000_000


def _arrivals(s, d):
    """Several arrivals of each (device, event): some with another model, some whose cost comes later, some not owned."""
    e = usage_events(s, d)
    n = F.col("event_id")
    payload = F.concat(F.lit('{"model": "'), F.trim("model"), F.lit('", "cost": '), F.coalesce((F.col("cost_cents") % 3).cast("string"), F.lit("null")), F.when(n % 2 == 0, ', "id": 1}').otherwise(', "id":1}'))
    return e.select(
        n.alias("event_id"), "us", F.concat(F.lit("d"), (n % 7).cast("string")).alias("device_id"), F.concat(F.lit("e"), (n % 350).cast("string")).alias("event_key"), F.when(n % 5 == 0, "quota_snapshot").otherwise("usage_event").alias("kind"),
        F.when(n % 11 == 0, "other").otherwise("same").alias("identity"), payload.alias("payload"), (n % 350 % 4 == 0).alias("stored"), F.when(n % 350 % 10 == 0, F.concat(F.lit("d"), (n % 7).cast("string"))).otherwise("d9").alias("owner"),
    )


def _fingerprinted(s, d):
    e = usage_events(s, d).select("event_id", "us", "integration_name", "model", "input_tokens", "session_id")
    return e.withColumn("fingerprint", ingest.fingerprint(F.col("integration_name"), F.col("model"), F.col("input_tokens"), F.col("session_id")))


_FP = "sha256(concat(integration_name, chr(0), model, chr(0), CAST(input_tokens AS VARCHAR), chr(0), session_id, chr(0)))"
_LINES = """concat('{"ts":"', CASE WHEN event_id % 50 = 1 THEN 'yesterday' ELSE strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') END, '","integration":"', CASE WHEN event_id % 50 = 2 THEN '' ELSE integration_name END,
    '","provider":"', CASE WHEN event_id % 50 = 3 THEN 'nobody' ELSE provider END, '","model":"', model, '","input_tokens":', CAST(CASE WHEN event_id % 50 = 4 THEN -1 ELSE input_tokens END AS VARCHAR), '}')"""


def _lines(s, d):
    e = usage_events(s, d)
    n = F.col("event_id") % 50
    return e.select("event_id", F.to_json(F.struct(
        F.when(n == 1, "yesterday").otherwise(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss")).alias("ts"), F.when(n == 2, "").otherwise(F.col("integration_name")).alias("integration"),
        F.when(n == 3, "nobody").otherwise(F.col("provider")).alias("provider"), "model", F.when(n == 4, F.lit(-1).cast("bigint")).otherwise(F.col("input_tokens")).alias("input_tokens"),
    )).alias("value"))


_PACE = """CASE WHEN delta > -1 AND delta < 1 THEN 'on_pace|' WHEN delta > 0 THEN
        CASE WHEN delta >= 15 THEN 'very_over|flat' WHEN delta >= CAST(0.3 AS DOUBLE) * left_share THEN 'very_over|time_left' WHEN delta >= 10 THEN 'over|flat' WHEN delta >= CAST(0.2 AS DOUBLE) * left_share THEN 'over|time_left' ELSE 'on_pace|' END
    ELSE CASE WHEN -delta >= 15 THEN 'very_under|flat' WHEN -delta >= CAST(0.3 AS DOUBLE) * passed THEN 'very_under|elapsed' WHEN -delta >= 10 THEN 'under|flat' WHEN -delta >= CAST(0.2 AS DOUBLE) * passed THEN 'under|elapsed' ELSE 'on_pace|' END END"""
PACED = """(lower(trim(quota_name)) IN ('seven_day', 'seven_day_sonnet') OR contains(lower(trim(quota_name)), 'weekly') OR starts_with(lower(trim(quota_name)), 'wkly_'))"""
_GEMINI = ["gemini-2.5-pro", "gemini-3-pro", "gemini-2.5-flash", "gemini-3-flash", "gemini-2.5-flash-lite", "Gemini-Lite-Flash", "other"]


def _models(s, d):
    """Snapshots of model quotas: seven models each, some without a reset."""
    names = F.array(*[F.lit(n) for n in _GEMINI])
    m = _q(s, d).select(F.expr("snapshot_id DIV 7").alias("snapshot_id"), (F.col("snapshot_id") % 7).alias("place"), "used_bp", "reset_us")
    return m.withColumn("model", F.element_at(names, (F.col("place") + 1).cast("int")))


_MODELS_SQL = f"md AS (SELECT snapshot_id // 7 AS snapshot_id, snapshot_id % 7 AS place, used_bp, reset_us, {_GEMINI!r}[CAST(snapshot_id % 7 AS INTEGER) + 1] AS model FROM qs)"


def _workdays(start, end):
    return f"""coalesce(list_sum(list_transform(range(0, CAST(greatest(ceil(({end} - {start}) / {DAY}), 1) AS BIGINT)), lambda x:
        CASE WHEN {end} > {start} AND ((({start} + x * {DAY}) // {DAY}) + 3) % 7 < 5 THEN least(CAST(1 AS DOUBLE), ({end} - {start} - x * {DAY}) / CAST({DAY} AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END)), 0)"""


def _asof(name: str, at: str) -> str:
    t = f"{name}_{at}"
    return f"ASOF LEFT JOIN (SELECT provider, coalesce(account_id, -1) AS acc, us, max_by(used_bp, snapshot_id) AS v FROM qs WHERE quota_name = '{name}' GROUP BY ALL) {t} ON o.provider = {t}.provider AND coalesce(o.account_id, -1) = {t}.acc AND o.{at} >= {t}.us"


_NAMED = ("five_hour", "monthly", "seven_day")

QUERIES = {
    "snapshot_asof": (
        lambda s, d: an.asof(usage_events(s, d).select("event_id", "provider", F.expr("CAST(substr(account_name, 6) AS BIGINT)").alias("account_id"), "us"), _q(s, d).where("quota_name = 'five_hour'"), ["provider", "account_id"], "used_bp", "snapshot_id"),
        f"""WITH {SAMPLES}, l AS (SELECT event_id, {'CASE user_id % 3 WHEN 0 THEN' + " 'anthropic' WHEN 1 THEN 'openai' ELSE 'gemini' END"} AS provider, user_id % 10 AS account_id, us FROM ev)
        SELECT l.event_id, l.provider, l.account_id, l.us, r.us AS at_us, r.used_bp FROM l ASOF LEFT JOIN (SELECT * FROM qs WHERE quota_name = 'five_hour') r ON l.provider = r.provider AND l.account_id = r.account_id AND l.us >= r.us""",
    ),
    "usage_summary_quota": (
        lambda s, d: an.quota_summary(an.with_open(_cycles(s, d))),
        f"""WITH {_STATS}, op AS (SELECT *, segment = max(segment) OVER (PARTITION BY {K}) AS is_open FROM cy)
        SELECT provider, quota_name, count(*) FILTER (NOT is_open) AS completed, CAST(coalesce(sum(delta_bp) FILTER (NOT is_open), 0) AS BIGINT) AS total_delta_bp, round(avg(delta_bp) FILTER (NOT is_open), 6) AS avg_delta_bp,
        max(peak_bp) FILTER (NOT is_open) AS max_peak_bp, min(start_us) FILTER (NOT is_open) AS first_start_us, count(*) FILTER (is_open) AS open, max(peak_bp) FILTER (is_open) AS open_peak_bp FROM op GROUP BY ALL""",
    ),
    "burn_rate": (
        lambda s, d: an.burn_rate(_q(s, d), NOW_US, WINDOW_US, LEAST_US),
        f"""WITH {SAMPLES}, a AS (SELECT {K}, min(us) AS t0, max(us) AS t1, arg_min(used_bp, (us, snapshot_id)) AS first_bp, arg_max(used_bp, (us, snapshot_id)) AS last_bp, (list(reset_us ORDER BY us DESC, snapshot_id DESC))[1] AS reset_us, count(*) AS n
            FROM qs WHERE us > {NOW_US - WINDOW_US} AND us <= {NOW_US} GROUP BY ALL),
        b AS (SELECT *, round(CASE WHEN n >= 2 AND t1 - t0 >= {LEAST_US} THEN greatest(last_bp - first_bp, 0) * CAST({HOUR} AS DOUBLE) / (t1 - t0) END, 6) AS rate, round(CASE WHEN reset_us > {NOW_US} THEN (reset_us - {NOW_US}) / CAST({HOUR} AS DOUBLE) WHEN reset_us IS NOT NULL THEN 0 END, 6) AS hours_left FROM a),
        c AS (SELECT *, CASE WHEN rate > 0 THEN (10000 - last_bp) / rate END AS ex, last_bp + rate * hours_left AS reached FROM b)
        SELECT {K}, n, rate, hours_left, round(ex, 4) AS exhaust_hours, round(CASE WHEN reached > 10000 THEN 10000 ELSE reached END, 4) AS projected_bp, ex < hours_left AS exhausts_first FROM c""",
    ),
    "weekly_pace": (
        lambda s, d: an.weekly_pace(_noisy(s, d)),
        f"""WITH {_NOISY}, p AS (SELECT *, round(CASE WHEN reset_us - us > {WEEK} THEN 100 WHEN reset_us < us THEN 0 ELSE (reset_us - us) * CAST(100 AS DOUBLE) / {WEEK} END, 6) AS left_share FROM qn WHERE {PACED} AND reset_us IS NOT NULL),
        q AS (SELECT *, 100 - left_share AS passed, used_bp / CAST(100 AS DOUBLE) - (100 - left_share) AS delta FROM p), t AS (SELECT *, {_PACE} AS pt FROM q)
        SELECT {K}, snapshot_id, left_share, split_part(pt, '|', 1) AS tier, nullif(split_part(pt, '|', 2), '') AS trigger FROM t""",
    ),
    "workday_pace": (
        lambda s, d: an.workday_pace(_q(s, d)),
        f"""WITH {SAMPLES}, p AS (SELECT *, reset_us - {WEEK} AS st FROM qs WHERE starts_with(quota_name, 'seven_day') AND reset_us > us AND reset_us - us <= {WEEK}),
        q AS (SELECT *, round({_workdays('st', 'us')}, 6) AS passed, round({_workdays('st', 'reset_us')}, 6) AS whole FROM p),
        r AS (SELECT *, used_bp / CAST(100 AS DOUBLE) - CAST(100 AS DOUBLE) * passed / whole AS delta FROM q) SELECT {K}, snapshot_id, passed, whole, CASE WHEN delta > 2 THEN 'ahead' WHEN delta < -2 THEN 'behind' ELSE 'on_track' END AS pace FROM r""",
    ),
    "status_ladder": (
        lambda s, d: an.status_ladder(_q(s, d)),
        f"""WITH {SAMPLES} SELECT snapshot_id, {STATUS.format('used_bp')} AS usage_status, CASE WHEN used_bp >= 9500 THEN 'exhausted' WHEN used_bp >= 8000 THEN 'critical' WHEN used_bp >= 6000 THEN 'warning' ELSE 'healthy' END AS cursor_status,
        CASE WHEN used_bp >= 9500 THEN 'negative' WHEN used_bp >= 8000 THEN 'warning' WHEN used_bp >= 5000 THEN 'info' ELSE 'positive' END AS severity_status, CASE WHEN used_bp >= 9000 THEN 'negative' WHEN used_bp >= 7000 THEN 'warning' ELSE 'positive' END AS copilot_insight_status,
        CASE WHEN used_bp >= 9000 THEN 'critical' WHEN used_bp >= 7000 THEN 'warning' ELSE 'healthy' END AS menubar_status, CASE WHEN used_bp >= 9000 THEN 'high' WHEN used_bp >= 7500 THEN 'moderate' ELSE 'low' END AS openrouter_status,
        CASE WHEN 10000 - used_bp <= 500 THEN 'critical' WHEN 10000 - used_bp <= 2000 THEN 'danger' WHEN 10000 - used_bp <= 5000 THEN 'warning' ELSE 'healthy' END AS remaining_status FROM qs""",
    ),
    "provider_cards": (
        lambda s, d: an.provider_cards(_latest(s, d)),
        f"WITH {SAMPLES}, {LATEST} SELECT provider, max(used_bp) AS max_bp, arg_max({STATUS.format('used_bp')}, {RANK}) AS worst, count(*) AS quotas, count(*) FILTER ({RANK} >= 2) AS alarming FROM la GROUP BY 1",
    ),
    "provider_aggregate": (
        lambda s, d: an.provider_aggregate(an.provider_cards(_latest(s, d).where("used_bp < 9000 OR provider = 'openai'"))),
        f"""WITH {SAMPLES}, {LATEST}, c AS (SELECT provider, max(used_bp) AS mx, max({RANK}) AS r FROM la WHERE used_bp < 9000 OR provider = 'openai' GROUP BY 1),
        a AS (SELECT count(*) AS providers, max(mx) AS max_bp, max(r) AS r, count(*) FILTER (r = 3) AS critical, count(*) FILTER (r IN (1, 2)) AS warned FROM c)
        SELECT providers, max_bp, ['healthy', 'warning', 'danger', 'critical'][r + 1] AS status, critical, warned, CASE WHEN critical > 0 THEN critical || ' Critical' WHEN warned > 0 THEN warned || ' Warning' ELSE 'All Good' END AS label FROM a""",
    ),
    "family_rollup": (
        lambda s, d: an.family_rollup(_models(s, d)),
        f"""WITH {SAMPLES}, {_MODELS_SQL}, fm AS (SELECT *, CASE WHEN contains(lower(model), 'flash') AND contains(lower(model), 'lite') THEN 'flash-lite' WHEN contains(lower(model), 'pro') THEN 'pro' WHEN contains(lower(model), 'flash') THEN 'flash' ELSE model END AS family FROM md)
        SELECT snapshot_id, family, arg_min(used_bp, place) AS used_bp, min(reset_us) AS reset_us, string_agg(model, '+' ORDER BY place) AS members, CASE family WHEN 'pro' THEN 0 WHEN 'flash' THEN 1 WHEN 'flash-lite' THEN 2 ELSE 3 END AS rank FROM fm GROUP BY snapshot_id, family""",
    ),
    "pool_groups": (
        lambda s, d: an.pool_groups(_latest(s, d)),
        f"WITH {SAMPLES}, {LATEST} SELECT provider, used_bp, reset_us, count(*) AS n, array_to_string(list_sort(list(DISTINCT quota_name || '@' || coalesce(CAST(account_id AS VARCHAR), ''))), '+') AS pool FROM la GROUP BY 1, 2, 3",
    ),
    "shared_pool": (
        lambda s, d: an.shared_pool(_latest(s, d).withColumn("used_bp", F.expr("used_bp DIV 5000"))),
        f"""WITH {SAMPLES}, {LATEST}, a AS (SELECT provider, account_id, count(*) AS n, count(*) > 1 AND min(used_bp // 5000) = max(used_bp // 5000) AND coalesce(max(reset_us) - min(reset_us), 0) <= 1000000 AS is_shared,
            min(quota_name) AS q, arg_min(used_bp // 5000, quota_name) AS u, (list(reset_us ORDER BY quota_name))[1] AS r FROM la GROUP BY 1, 2)
        SELECT provider, account_id, n, is_shared, CASE WHEN is_shared THEN q END AS merged_quota_name, CASE WHEN is_shared THEN u END AS merged_used_bp, CASE WHEN is_shared THEN r END AS merged_reset_us FROM a""",
    ),
    "grouped_cycles": (
        lambda s, d: an.grouped_cycles(_cycles(s, d)),
        f"WITH {_STATS} SELECT provider, quota_name, start_us - start_us % 60000000 AS minute_us, min(start_us) AS start_us, max(end_us) AS end_us, max(peak_bp) AS peak_bp, CAST(sum(delta_bp) AS BIGINT) AS delta_bp FROM cy GROUP BY 1, 2, 3",
    ),
    "trend_half_split": (
        lambda s, d: an.trend_half_split(boundaries.daily_usage(_q(s, d))),
        f"""WITH {SAMPLES}, r AS (SELECT *, used_bp - lag(used_bp) OVER w AS rise FROM qs {WK}), dy AS (SELECT {K}, us // {DAY} AS day, CAST(sum(rise) AS BIGINT) AS rise_bp FROM r WHERE rise > 0 GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY day) AS i, count(*) OVER (PARTITION BY {K}) AS n FROM dy),
        a AS (SELECT {K}, round(avg(rise_bp) FILTER (i <= n // 2), 6) AS older, round(avg(rise_bp) FILTER (i > n // 2), 6) AS newer FROM n GROUP BY ALL)
        SELECT *, CASE WHEN older IS NULL OR newer IS NULL THEN 'stable' WHEN newer - older > greatest(500, CAST(0.15 AS DOUBLE) * older) THEN 'rising' WHEN older - newer > greatest(500, CAST(0.15 AS DOUBLE) * older) THEN 'falling' ELSE 'stable' END AS trend FROM a""",
    ),
    "cycle_overview": (
        lambda s, d: an.cycle_overview(_cycles(s, d), _q(s, d)),
        f"""WITH {_STATS}, h AS (SELECT cy.provider, cy.account_id, cy.quota_name, cy.start_us, qs.us, used_bp, snapshot_id FROM qs JOIN cy ON qs.provider = cy.provider AND qs.account_id IS NOT DISTINCT FROM cy.account_id AND qs.quota_name = cy.quota_name WHERE us >= cy.start_us AND us <= cy.end_us),
        o AS (SELECT {K}, start_us, arg_max(us, (used_bp, -us)) AS peak_us, max(used_bp) AS peak_bp, arg_min(used_bp, (us, snapshot_id)) AS start_bp FROM h GROUP BY ALL)
        SELECT o.*, {', '.join(f'{n}_peak_us.v AS {n}_bp, {n}_peak_us.v - {n}_start_us.v AS {n}_delta_bp' for n in _NAMED)} FROM o {' '.join(_asof(n, at) for n in _NAMED for at in ('peak_us', 'start_us'))}""",
    ),
    "observed_providers": (lambda s, d: _q(s, d).groupBy("provider").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us")), f"WITH {SAMPLES} SELECT provider, min(us) AS first_us, max(us) AS last_us FROM qs GROUP BY 1"),
    "distinct_names": (lambda s, d: _q(s, d).select("provider", "quota_name").distinct(), f"WITH {SAMPLES} SELECT DISTINCT provider, quota_name FROM qs"),
    "dedupe_events": (
        lambda s, d: ingest.dedupe(_fingerprinted(s, d)),
        f"WITH {USAGE}, f AS (SELECT event_id, us, integration_name, model, input_tokens, session_id, {_FP} AS fingerprint FROM ue) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY us, event_id) = 1",
    ),
    "not_compacted": (
        lambda s, d: ingest.not_compacted(_fingerprinted(s, d), _fingerprinted(s, d).where(f"us < {NOW_US - 10 * DAY}")),
        f"WITH {USAGE}, f AS (SELECT event_id, us, integration_name, model, input_tokens, session_id, {_FP} AS fingerprint FROM ue) SELECT * FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM f WHERE us < {NOW_US - 10 * DAY})",
    ),
    "receipts_status": (
        lambda s, d: ingest.receipts(_arrivals(s, d)),
        f"""WITH RECURSIVE {USAGE}, b AS MATERIALIZED (SELECT event_id, us, 'd' || CAST(event_id % 7 AS VARCHAR) AS device_id, 'e' || CAST(event_id % 350 AS VARCHAR) AS event_key, event_id % 5 = 0 AS quota, event_id % 11 = 0 AS other, trim(model) AS m, cost_cents % 3 AS c,
            event_id % 350 % 4 = 0 AS stored, event_id % 350 % 10 = 0 AS owned, row_number() OVER (PARTITION BY event_id % 7, event_id % 350 ORDER BY us, event_id) AS rn FROM ue),
        f AS (SELECT b.*, CASE WHEN quota AND NOT owned THEN 'rejected:ownership_conflict' WHEN stored AND NOT quota THEN 'duplicate' ELSE 'accepted' END AS st, NOT quota OR owned AS held, other AS h_o, m AS h_m, c AS h_c FROM b WHERE rn = 1
        UNION ALL SELECT b.*, CASE WHEN NOT f.held THEN CASE WHEN b.quota AND NOT b.owned THEN 'rejected:ownership_conflict' WHEN b.stored AND NOT b.quota THEN 'duplicate' ELSE 'accepted' END
                WHEN b.other <> f.h_o THEN 'rejected:event_identity_conflict' WHEN b.m = f.h_m AND b.c IS NOT DISTINCT FROM f.h_c THEN 'duplicate' WHEN NOT b.quota AND b.m = f.h_m AND f.h_c IS NULL THEN 'enriched' ELSE 'rejected:event_payload_conflict' END,
            f.held OR NOT b.quota OR b.owned, CASE WHEN f.held THEN f.h_o ELSE b.other END, CASE WHEN f.held THEN f.h_m ELSE b.m END,
            CASE WHEN f.held AND NOT (NOT b.quota AND b.other = f.h_o AND b.m = f.h_m AND f.h_c IS NULL) THEN f.h_c ELSE b.c END FROM f JOIN b ON b.device_id = f.device_id AND b.event_key = f.event_key AND b.rn = f.rn + 1)
        SELECT event_id, device_id, event_key, split_part(st, ':', 1) AS status, nullif(split_part(st, ':', 2), '') AS code FROM f""",
    ),
    "late_observations": (
        lambda s, d: ingest.late_observations(_q(s, d), _arrival()),
        f"WITH {SAMPLES}, {LATEST} SELECT {K}, snapshot_id, us, (snapshot_id % 10) * 60000000 <= 300000000 AND -(snapshot_id % 10) * 60000000 <= 60000000 AS may_alert FROM la",
    ),
    "meter_thinning": (
        lambda s, d: ingest.thin_meters(_q(s, d).withColumns({"used_bp": F.expr("used_bp DIV 500"), "us": F.expr(f"us - us % {DAY}"), "plan": F.when(F.col("snapshot_id") % 3 == 0, "team").otherwise("plus")}), 5 * DAY),
        f"""WITH RECURSIVE {SAMPLES}, w AS (SELECT * REPLACE (us - us % {DAY} AS us), CASE WHEN snapshot_id % 3 = 0 THEN 'team' ELSE 'plus' END AS plan FROM qs),
        m AS MATERIALIZED (SELECT {K}, snapshot_id, us, used_bp // 500 AS used_bp, plan, coalesce(reset_us, -1) AS r, row_number() OVER (PARTITION BY {K}, used_bp // 500, plan, coalesce(reset_us, -1) ORDER BY us, snapshot_id) AS rn FROM w),
        f AS (SELECT *, us AS kept, true AS stays FROM m WHERE rn = 1 UNION ALL SELECT m.*, CASE WHEN m.us - f.kept > {5 * DAY} THEN m.us ELSE f.kept END, m.us - f.kept > {5 * DAY} FROM f JOIN m
            ON m.provider = f.provider AND m.account_id IS NOT DISTINCT FROM f.account_id AND m.quota_name = f.quota_name AND m.used_bp = f.used_bp AND m.plan = f.plan AND m.r = f.r AND m.rn = f.rn + 1)
        SELECT {K}, snapshot_id, us, used_bp, plan FROM f WHERE stays""",
    ),
    "poll_meter_preference": (
        lambda s, d: ingest.prefer_polled(_meters(s, d), 12 * HOUR),
        f"""WITH {SAMPLES}, m AS (SELECT *, CASE WHEN snapshot_id % 2 = 0 THEN 'poll' ELSE 'rollout' END AS source FROM qs)
        SELECT * FROM m WHERE source = 'poll' OR NOT EXISTS (SELECT 1 FROM m p WHERE p.source = 'poll' AND p.provider = m.provider AND p.account_id IS NOT DISTINCT FROM m.account_id AND p.quota_name = m.quota_name AND abs(p.us - m.us) <= {12 * HOUR})""",
    ),
    "upsert_hourly": (
        lambda s, d: ingest.upsert_hourly(*[usage_events(s, d).where(f"event_id % 2 = {k}").select("integration_name", F.expr(f"us - us % {HOUR}").alias("hour_us"), "output_tokens", F.col("us").alias("first_us"), F.col("us").alias("last_us")) for k in (0, 1)], ["integration_name", "hour_us"], ["output_tokens"]),
        f"WITH {USAGE} SELECT integration_name, us - us % {HOUR} AS hour_us, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, min(us) AS first_us, max(us) AS last_us FROM ue GROUP BY 1, 2",
    ),
    "merge_mutable": (
        lambda s, d: ingest.merge_mutable(_q(s, d).where("snapshot_id % 2 = 0"), _q(s, d).where("snapshot_id % 2 = 1")),
        f"WITH {SAMPLES}, {LATEST}, p AS (SELECT {K}, max(used_bp) AS peak_bp FROM qs GROUP BY ALL) SELECT la.provider, la.account_id, la.quota_name, reset_us, snapshot_id, peak_bp, us FROM la JOIN p ON la.provider = p.provider AND la.account_id IS NOT DISTINCT FROM p.account_id AND la.quota_name = p.quota_name",
    ),
    "ingest_health": (
        lambda s, d: ingest.ingest_health(usage_events(s, d).select("source_path").distinct(), usage_events(s, d).where("source_path <> 'p3'")),
        f"WITH {USAGE}, c AS (SELECT DISTINCT source_path FROM ue), e AS (SELECT source_path, count(*) AS events, max(us) AS newest_us FROM ue WHERE source_path <> 'p3' GROUP BY 1) SELECT source_path, coalesce(events, 0) AS events, newest_us FROM c LEFT JOIN e USING (source_path)",
    ),
    "usage_event_lines": (
        lambda s, d: ingest.parse_lines(_lines(s, d)).select("event_id", "model", "input_tokens", F.when(F.col("error").isNull(), F.col("us")).alias("us"), "error"),
        f"""WITH {USAGE} SELECT event_id, model, CASE WHEN event_id % 50 = 4 THEN -1 ELSE input_tokens END AS input_tokens, CASE WHEN event_id % 50 IN (1, 2, 3, 4) THEN NULL ELSE us // 1000000 * 1000000 END AS us,
        CASE event_id % 50 WHEN 1 THEN 'bad_ts' WHEN 2 THEN 'no_integration' WHEN 3 THEN 'provider' WHEN 4 THEN 'negative_tokens' END AS error FROM ue""",
    ),
    "threshold_alerts": (
        lambda s, d: alerts.threshold_alerts(_q(s, d)),
        f"""WITH {_STATS}, l AS (SELECT *, CASE WHEN used_bp >= 9500 THEN 2 WHEN used_bp >= 8000 THEN 1 ELSE 0 END AS level FROM rs),
        m AS (SELECT *, coalesce(max(level) OVER (PARTITION BY {K}, segment {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM l)
        SELECT {K}, segment, snapshot_id, us, CASE level WHEN 2 THEN 'critical' ELSE 'warning' END AS alert FROM m WHERE level > sent""",
    ),
    "pace_alerts": (
        lambda s, d: alerts.pace_alerts(_noisy(s, d)),
        f"""WITH RECURSIVE {_NOISY}, p AS (SELECT {K}, snapshot_id, us, reset_us, used_bp - 10000 + (reset_us - us) * 10000 // {WEEK} AS over_bp FROM qn WHERE starts_with(quota_name, 'seven_day') AND reset_us > us AND reset_us - us <= {WEEK}),
        n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {K} {ORD}) AS rn FROM p),
        f AS (SELECT *, CASE WHEN over_bp >= 1500 THEN over_bp END AS sent, over_bp >= 1500 AS fires FROM n WHERE rn = 1
        UNION ALL SELECT n.*, CASE WHEN n.over_bp < 1000 THEN NULL WHEN n.over_bp >= 1500 AND (f.sent IS NULL OR n.over_bp >= f.sent + 1000) THEN n.over_bp ELSE f.sent END, n.over_bp >= 1500 AND (f.sent IS NULL OR n.over_bp >= f.sent + 1000)
            FROM f JOIN n ON n.provider = f.provider AND n.account_id IS NOT DISTINCT FROM f.account_id AND n.quota_name = f.quota_name AND n.rn = f.rn + 1)
        SELECT {K}, snapshot_id, us, over_bp FROM f WHERE fires""",
    ),
    "missed_polls": (
        lambda s, d: alerts.missed_polls(_q(s, d), NOW_US, DAY, 10_000_000),
        f"""WITH {SAMPLES}, l AS (SELECT provider, account_id, max(us) AS last_us FROM qs WHERE us <= {NOW_US} GROUP BY 1, 2)
        SELECT *, CASE WHEN {NOW_US} >= last_us + {DAY} + 10000000 THEN 1 + ({NOW_US} - last_us - {DAY} - 10000000) // {DAY} ELSE 0 END AS missed FROM l""",
    ),
    "quiet_weekly": (
        lambda s, d: alerts.quiet_weekly(_noisy(s, d)),
        f"""WITH {_NOISY} SELECT {K}, reset_us, snapshot_id, us, used_bp FROM qn WHERE starts_with(quota_name, 'seven_day') AND reset_us > us AND reset_us - us <= {WEEK // 2} AND used_bp < 5000
        QUALIFY row_number() OVER (PARTITION BY {K}, reset_us {ORD}) = 1""",
    ),
    "threshold_overrides": (
        lambda s, d: alerts.threshold_alerts(_q(s, d), overrides=s.createDataFrame([("openai", "five_hour", 30.0, 60.0, None), ("gemini", "daily", 40.0, None, 80.0)], "provider string, quota_name string, warning double, critical double, quota_limit double")),
        f"""WITH {_STATS}, l AS (SELECT *, CASE WHEN used_bp >= CASE WHEN provider = 'openai' AND quota_name = 'five_hour' THEN 6000 ELSE 9500 END THEN 2
            WHEN used_bp >= CASE WHEN provider = 'openai' AND quota_name = 'five_hour' THEN 3000 WHEN provider = 'gemini' AND quota_name = 'daily' THEN 5000 ELSE 8000 END THEN 1 ELSE 0 END AS level FROM rs),
        m AS (SELECT *, coalesce(max(level) OVER (PARTITION BY {K}, segment {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM l)
        SELECT {K}, segment, snapshot_id, us, CASE level WHEN 2 THEN 'critical' ELSE 'warning' END AS alert FROM m WHERE level > sent""",
    ),
    "reset_alerts": (
        lambda s, d: alerts.reset_alerts(_q(s, d), 3 * DAY),
        f"""WITH RECURSIVE {_STATS}, n AS MATERIALIZED (SELECT {K}, snapshot_id, us, row_number() OVER (PARTITION BY {K} {ORD}) AS rn FROM bo WHERE is_boundary),
        f AS (SELECT *, us AS told, true AS tells FROM n WHERE rn = 1 UNION ALL SELECT n.*, CASE WHEN n.us - f.told >= {3 * DAY} THEN n.us ELSE f.told END, n.us - f.told >= {3 * DAY}
            FROM f JOIN n ON n.provider = f.provider AND n.account_id IS NOT DISTINCT FROM f.account_id AND n.quota_name = f.quota_name AND n.rn = f.rn + 1)
        SELECT {K}, snapshot_id, us FROM f WHERE tells""",
    ),
    "metrics_long": (
        lambda s, d: alerts.metrics_long(
            _latest(s, d), NOW_US, 3 * DAY, _q(s, d).select("provider", "account_id", (F.col("snapshot_id") % 3 == 0).alias("failed"), F.when(F.col("snapshot_id") % 2 == 0, "timeout").otherwise("http").alias("reason")), usage_events(s, d),
            _latest(s, d).where("quota_name = 'daily'").select("provider", "account_id", F.lit("usd").alias("unit"), (F.col("used_bp") / 4.0).alias("balance")), _latest(s, d).select("provider", "account_id", F.concat(F.lit("n"), F.col("account_id").cast("string")).alias("account_name")).distinct(),
            _q(s, d).where("snapshot_id % 40 = 0").select("provider", F.lit("query").alias("error_type")), "1.0",
        ),
        f"""WITH {USAGE}, {SAMPLES[SAMPLES.index('qs AS'):]}, {LATEST}, nw AS (SELECT provider, account_id, max(us) AS us FROM la GROUP BY 1, 2), r AS (
        SELECT 'quota_utilization_percent' AS metric, provider, account_id, quota_name, NULL AS integration, NULL AS unit, NULL AS reason, NULL AS name, used_bp / CAST(100 AS DOUBLE) AS value FROM la
        UNION ALL SELECT 'quota_reset_timestamp_seconds', provider, account_id, quota_name, NULL, NULL, NULL, NULL, reset_us / CAST(1000000 AS DOUBLE) FROM la
        UNION ALL SELECT 'agent_last_cycle_age_seconds', provider, account_id, NULL, NULL, NULL, NULL, NULL, ({NOW_US} - us) / CAST(1000000 AS DOUBLE) FROM nw UNION ALL SELECT 'agent_healthy', provider, account_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN {NOW_US} - us > {3 * DAY} THEN 0 ELSE 1 END FROM nw
        UNION ALL SELECT 'cycles_completed_total', provider, account_id, NULL, NULL, NULL, NULL, NULL, count(*) FILTER (snapshot_id % 3 <> 0) FROM qs GROUP BY 2, 3
        UNION ALL SELECT 'cycles_failed_total', provider, account_id, NULL, NULL, NULL, CASE WHEN snapshot_id % 2 = 0 THEN 'timeout' ELSE 'http' END, NULL, count(*) FROM qs WHERE snapshot_id % 3 = 0 GROUP BY 2, 3, 7
        UNION ALL SELECT 'api_integration_requests', NULL, NULL, NULL, integration_name, NULL, NULL, NULL, count(*) FROM ue GROUP BY 5 UNION ALL SELECT 'api_integration_spend_usd', NULL, NULL, NULL, integration_name, NULL, NULL, NULL, coalesce(sum(cost_cents), 0) / CAST(100 AS DOUBLE) FROM ue GROUP BY 5
        UNION ALL SELECT 'credits_balance', provider, account_id, NULL, NULL, 'usd', NULL, NULL, used_bp / CAST(4 AS DOUBLE) FROM la WHERE quota_name = 'daily' UNION ALL SELECT DISTINCT 'account_info', provider, account_id, NULL, NULL, NULL, NULL, 'n' || account_id, 1 FROM la
        UNION ALL SELECT 'scrape_errors_total', provider, NULL, NULL, NULL, NULL, 'query', NULL, count(*) FROM qs WHERE snapshot_id % 40 = 0 GROUP BY 2 UNION ALL SELECT 'build_info', NULL, NULL, NULL, NULL, NULL, NULL, '1.0', 1)
        SELECT metric, provider, CAST(account_id AS VARCHAR) AS account_id, quota_name, integration, unit, reason, name, CAST(value AS DOUBLE) AS value FROM r WHERE value IS NOT NULL""",
    ),
}
