"""Insights, display forms and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotalens.operators import analytics as an
from quotalens.operators import documents as doc
from quotalens.operators import insights as ins
from quotalens.operators import rollup
from quotalens.sources.projection import SAMPLES, USAGE, usage_events

from .insights import DAY, HOUR, LATEST, LEAST_US, NOW_US, WINDOW_US, K, QUERIES as _OTHERS, _cycles, _latest, _q
from .quotas import _STATS, ORD
from .usage import ARCHIVE, CUT_US

_OPEN = f"{_STATS}, op AS (SELECT *, segment = max(segment) OVER (PARTITION BY {K}) AS is_open FROM cy)"
_BURN = _OTHERS["burn_rate"][1]
_SHORT = lambda x: f"CASE WHEN {x} >= 1000000000 THEN printf('%.1fB', floor({x} * 10 / 1000000000) / 10.0) WHEN {x} >= 1000000 THEN printf('%.1fM', floor({x} * 10 / 1000000) / 10.0) WHEN {x} >= 1000 THEN printf('%.1fK', floor({x} * 10 / 1000) / 10.0) ELSE CAST({x} AS VARCHAR) END"
_MIN = "(output_tokens * 37)"
_KIND = f"CASE WHEN reset_us IS NULL THEN 'unknown' WHEN reset_us - us > {6 * HOUR} THEN 'weekly' ELSE 'five_hour' END"


def _accounts(s, d):
    return _q(s, d).groupBy("account_id").agg(F.max(F.col("snapshot_id") % 4 == 0).alias("is_deleted")).withColumn("external_id", F.col("account_id") % 40)


def _documents(s, d):
    """Pairs of payloads: a nested value that is null or changes, a list that may grow, a member that may go, some no JSON."""
    n = F.col("event_id")
    value = F.when(n % 4 == 0, "null").otherwise((n % 4).cast("string"))
    old = F.concat(F.lit('{"a":{"k":'), value, F.lit('},"l":[1,{"x":null}]'), F.when(n % 7 == 2, ',"gone":true}').otherwise("}"))
    new = F.concat(F.lit('{"b":1,"l":[1,{"x":2}'), F.when(n % 5 == 1, ",3").otherwise(""), F.lit('],"a":{"more":[],"k":'), (n % 3 + 1).cast("string"), F.lit("}}"))
    return usage_events(s, d).select("event_id", old.alias("old"), F.when(n % 20 == 7, "oops").otherwise(new).alias("new"))


def _slots(hour):
    return f"CAST(floor((us - {hour * HOUR} + {DAY // 2}) / {DAY}) AS BIGINT) * {DAY} + {hour * HOUR}"


_PATH = """CASE event_id % 6 WHEN 0 THEN '/Users/' WHEN 1 THEN 'C:\\logs' WHEN 2 THEN 'D:/logs' WHEN 3 THEN 'device:7' WHEN 4 THEN 'import:x' ELSE '' END"""
_REPORT = f"""{ARCHIVE}, rr AS (SELECT model, reasoning_effort, speed_mode, {_PATH} AS path, 1 AS request_count, coalesce(cost_cents, 0) AS cost_cents, CAST(cost_cents IS NULL AS BIGINT) AS unpriced, false AS archived FROM ue WHERE us >= {CUT_US}
    UNION ALL SELECT model, reasoning_effort, speed_mode, '', request_count, cost_cents, unpriced, true FROM archive)"""


def _report_rows(s, d):
    e = usage_events(s, d)
    n = F.col("event_id") % 6
    path = F.when(n == 0, "/Users/").when(n == 1, "C:\\logs").when(n == 2, "D:/logs").when(n == 3, "device:7").when(n == 4, "import:x").otherwise("")
    raw = e.where(f"us >= {CUT_US}").select("model", "reasoning_effort", "speed_mode", path.alias("source_path"), F.lit(1).cast("bigint").alias("request_count"), F.coalesce("cost_cents", F.lit(0)).cast("bigint").alias("cost_cents"), F.col("cost_cents").isNull().cast("bigint").alias("unpriced"), F.lit(False).alias("archived"))
    old = rollup.compact_hourly(e.where(f"us < {CUT_US}"))
    return raw.unionByName(old.select("model", "reasoning_effort", "speed_mode", F.lit("").alias("source_path"), "request_count", "cost_cents", "unpriced", F.lit(True).alias("archived")))


QUERIES = {
    "display_mode": (lambda s, d: ins.display_mode(_latest(s, d), "available").select("snapshot_id", "shown_bp"), f"WITH {SAMPLES}, {LATEST} SELECT snapshot_id, greatest(10000 - used_bp, 0) AS shown_bp FROM la"),
    "normalized_plan": (
        lambda s, d: ins.normalize_plan(_latest(s, d), F.col("account_id") % 2 == 0),
        f"""WITH {SAMPLES}, {LATEST}, n AS (SELECT * REPLACE (CASE WHEN account_id % 2 = 0 AND quota_name = 'five_hour' THEN 'seven_day' ELSE quota_name END AS quota_name) FROM la)
        SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY used_bp DESC, us DESC, snapshot_id DESC) = 1""",
    ),
    "duplicate_accounts": (
        lambda s, d: ins.duplicate_accounts(_accounts(s, d)),
        f"""WITH {SAMPLES}, a AS (SELECT account_id, bool_or(snapshot_id % 4 = 0) AS is_deleted, account_id % 40 AS external_id FROM qs GROUP BY 1)
        SELECT external_id, count(*) AS n, arg_min(account_id, (is_deleted, account_id)) AS survivor FROM a GROUP BY 1 HAVING count(*) > 1""",
    ),
    "logical_groups": (
        lambda s, d: ins.logical_groups(ins.window_kind(_latest(s, d))),
        f"""WITH {SAMPLES}, {LATEST}, w AS (SELECT *, 10000 - used_bp AS left_bp, {_KIND} AS window_kind FROM la),
        a AS (SELECT provider, account_id, window_kind, min(left_bp) AS left_bp, (list(reset_us ORDER BY left_bp, -coalesce(reset_us, 0)))[1] AS reset_us, bool_or(left_bp <= 0) AS exhausted FROM w GROUP BY 1, 2, 3)
        SELECT provider, account_id, window_kind, left_bp, reset_us, bool_or(exhausted) OVER (PARTITION BY provider, account_id) AS exhausted FROM a
        QUALIFY row_number() OVER (PARTITION BY provider, account_id ORDER BY left_bp, CASE WHEN window_kind = 'weekly' THEN 0 ELSE 1 END, window_kind) = 1""",
    ),
    "formatted_usage": (
        lambda s, d: ins.formatted(usage_events(s, d)),
        f"""WITH {USAGE} SELECT event_id, {_SHORT('(output_tokens * 977)')} AS tokens, CASE WHEN {_MIN} < 1 THEN 'now' WHEN {_MIN} >= 1440 THEN CAST({_MIN} // 1440 AS VARCHAR) || 'd ' || CAST({_MIN} // 60 % 24 AS VARCHAR) || 'h'
        WHEN {_MIN} >= 60 THEN CAST({_MIN} // 60 AS VARCHAR) || 'h ' || CAST({_MIN} % 60 AS VARCHAR) || 'm' ELSE CAST({_MIN} AS VARCHAR) || 'm' END AS time FROM ue""",
    ),
    "active_first": (
        lambda s, d: ins.active_first(an.with_open(_cycles(s, d)), 3),
        f"WITH {_OPEN} SELECT {K}, start_us, is_open, row_number() OVER (PARTITION BY {K} ORDER BY NOT is_open, start_us DESC) AS place FROM op QUALIFY place <= 3",
    ),
    "trimmed_cycles": (
        lambda s, d: ins.trim_empty(_cycles(s, d)),
        f"WITH {_STATS} SELECT {K}, start_us, delta_bp FROM cy QUALIFY delta_bp > 0 OR row_number() OVER (PARTITION BY {K} ORDER BY delta_bp > 0, start_us DESC) = 1",
    ),
    "report_totals": (
        lambda s, d: ins.report_totals(_report_rows(s, d)),
        f"""WITH {_REPORT}, k AS (SELECT *, unnest([{{'kind': 'report', 'name': ''}}, {{'kind': 'model', 'name': concat_ws('|', model, reasoning_effort, speed_mode)}}, {{'kind': 'device', 'name': CASE WHEN contains(path, '/Users/') THEN 'macOS source' WHEN contains(path, ':\\') OR contains(path, ':/') THEN 'Windows source'
            WHEN starts_with(path, 'device:') OR starts_with(path, 'import:') THEN 'Imported source' ELSE 'Other / unknown source' END}}]) AS k FROM rr),
        t AS (SELECT k.kind AS kind, k.name AS name, CAST(sum(cost_cents) AS BIGINT) AS cost_cents, CAST(sum(request_count) AS BIGINT) AS requests, CAST(sum(unpriced) AS BIGINT) AS unknown, CAST(coalesce(sum(request_count) FILTER (archived), 0) AS BIGINT) AS archived FROM k GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY kind ORDER BY cost_cents DESC, name) AS place FROM t""",
    ),
    "burn_insights": (
        # projected use in steps of 10 points, so that some is just at the limit
        lambda s, d: ins.burn_insights(an.burn_rate(_q(s, d), NOW_US, WINDOW_US, LEAST_US).withColumns({"provider": F.when(F.col("provider") == "gemini", "cursor").otherwise(F.col("provider")), "projected_bp": F.round("projected_bp", -3), "exhausts_first": F.col("exhausts_first") & (F.col("n") % 2 == 0)})),
        f"""WITH br AS ({_BURN}), x AS (SELECT * REPLACE (CASE WHEN provider = 'gemini' THEN 'cursor' ELSE provider END AS provider, round(projected_bp, -3) AS projected_bp, exhausts_first AND n % 2 = 0 AS exhausts_first) FROM br)
        SELECT {K}, CASE WHEN rate IS NULL THEN 'analysing' WHEN rate < 1 THEN 'idle' WHEN coalesce(exhausts_first, false) THEN 'negative' WHEN projected_bp > 8000 OR (provider = 'cursor' AND projected_bp >= 8000) THEN 'warning' ELSE 'positive' END AS insight FROM x""",
    ),
    "cycle_rate": (
        lambda s, d: ins.cycle_rate(an.with_open(_cycles(s, d)), NOW_US),
        f"""WITH {_OPEN}, r AS (SELECT *, CASE WHEN {NOW_US} - start_us >= {HOUR // 2} AND delta_bp > 0 THEN delta_bp * CAST({HOUR} AS DOUBLE) / ({NOW_US} - start_us) END AS rt FROM op WHERE is_open)
        SELECT {K}, round(rt, 6) AS rate, round(CASE WHEN reset_us IS NULL OR rt IS NULL THEN NULL ELSE least(10000, peak_bp + rt * CASE WHEN reset_us > {NOW_US} THEN reset_us - {NOW_US} ELSE 0 END / CAST({HOUR} AS DOUBLE)) END, 4) AS projected_bp FROM r""",
    ),
    "variance_insight": (
        lambda s, d: ins.variance_insight(an.with_open(_cycles(s, d))),
        f"""WITH {_OPEN}, a AS (SELECT provider, quota_name, count(*) AS n, round(avg(peak_bp), 6) AS avg_bp, max(peak_bp) AS max_bp FROM op WHERE NOT is_open GROUP BY 1, 2 HAVING count(*) >= 3 AND avg(peak_bp) > 100),
        o AS (SELECT provider, quota_name, n, round((max_bp - avg_bp) * 100 / avg_bp, 4) AS over_percent FROM a) SELECT *, CASE WHEN over_percent > 50 THEN 'spiky' WHEN over_percent > 10 THEN 'uneven' ELSE 'steady' END AS insight FROM o""",
    ),
    "underuse_slots": (
        lambda s, d: ins.underuse_slots(_q(s, d)),
        f"""WITH {SAMPLES}, u AS (SELECT *, unnest([{_slots(10)}, {_slots(22)}]) AS slot_us FROM qs WHERE used_bp < 3000)
        SELECT {K}, slot_us, arg_min(snapshot_id, (us, snapshot_id)) AS snapshot_id FROM u WHERE abs(us - slot_us) <= {90 * 60_000_000} GROUP BY ALL""",
    ),
    "poll_failures": (
        lambda s, d: ins.poll_failures(_q(s, d).withColumn("failed", F.col("snapshot_id") % 5 != 0), 2, 2 * DAY, 4 * DAY),
        f"""WITH RECURSIVE {SAMPLES}, p AS MATERIALIZED (SELECT provider, account_id, snapshot_id, us, snapshot_id % 5 <> 0 AS failed, row_number() OVER (PARTITION BY provider, account_id {ORD}) AS rn FROM qs),
        f AS (SELECT *, CASE WHEN failed THEN 1 ELSE 0 END AS run, CASE WHEN failed THEN us END AS first_us, CAST(NULL AS BIGINT) AS sent, false AS tells FROM p WHERE rn = 1
        UNION ALL SELECT p.*, CASE WHEN p.failed THEN f.run + 1 ELSE 0 END, CASE WHEN p.failed THEN coalesce(f.first_us, p.us) END, CASE WHEN NOT p.failed THEN NULL WHEN f.run >= 1 AND p.us - f.first_us >= {2 * DAY} AND (f.sent IS NULL OR p.us - f.sent >= {4 * DAY}) THEN p.us ELSE f.sent END,
            coalesce(p.failed AND f.run >= 1 AND p.us - f.first_us >= {2 * DAY} AND (f.sent IS NULL OR p.us - f.sent >= {4 * DAY}), false) FROM f JOIN p ON p.provider = f.provider AND p.account_id IS NOT DISTINCT FROM f.account_id AND p.rn = f.rn + 1)
        SELECT provider, account_id, snapshot_id, us, run AS failures FROM f WHERE tells""",
    ),
    "json_enrichment": (
        lambda s, d: _documents(s, d).select("event_id", doc.is_enrichment(F.col("old"), F.col("new")).alias("adds")),
        f"""WITH {USAGE} SELECT event_id, CASE WHEN event_id % 20 = 7 THEN NULL ELSE (event_id % 4 = 0 OR event_id % 4 = event_id % 3 + 1) AND (event_id % 5 <> 1) AND event_id % 7 <> 2 END AS adds FROM ue""",
    ),
    "retention": (lambda s, d: ins.older_than(usage_events(s, d), NOW_US)[0].select("event_id", "us"), f"WITH {USAGE} SELECT event_id, us FROM ue WHERE us >= {NOW_US}"),
}
