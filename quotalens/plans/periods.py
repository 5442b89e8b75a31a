"""Insights over billing periods and pools, model names, ages, alert logs, exports and guarded reads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quotalens.operators import analytics as an
from quotalens.operators import boundaries as b
from quotalens.operators import ingest, periods, records
from quotalens.session import work_dir
from quotalens.sources import logs
from quotalens.sources.projection import SAMPLES, USAGE, usage_events

from .current import _BURN, _rates
from .insights import DAY, HOUR, NOW_US, K, _cycles, _q
from .quotas import _STATS

MINUTE = 60_000_000
_SAME = "n.provider = f.provider AND n.account_id IS NOT DISTINCT FROM f.account_id AND n.quota_name = f.quota_name"


def _fold(name: str, source: str) -> str:
    """T8 in SQL: ``name`` holds the periods of the cycles of ``source`` (no cycle twice at one time)."""
    return f"""{name}_n AS MATERIALIZED (SELECT {K}, start_us, peak_bp, row_number() OVER (PARTITION BY {K} ORDER BY start_us) AS rn FROM {source}),
    {name}_f AS (SELECT *, CAST(0 AS BIGINT) AS period, peak_bp AS run FROM {name}_n WHERE rn = 1
    UNION ALL SELECT n.*, f.period + CASE WHEN f.run > 500 AND 2 * n.peak_bp < f.run THEN 1 ELSE 0 END, CASE WHEN f.run > 500 AND 2 * n.peak_bp < f.run THEN n.peak_bp ELSE greatest(f.run, n.peak_bp) END
        FROM {name}_f f JOIN {name}_n n ON {_SAME} AND n.rn = f.rn + 1),
    {name} AS (SELECT {K}, period, count(*) AS cycles, max(peak_bp) AS peak_bp FROM {name}_f GROUP BY ALL)"""


_COMPLETED = f"op AS (SELECT *, segment = max(segment) OVER (PARTITION BY {K}) AS is_open FROM cy), cc AS (SELECT * FROM op WHERE NOT is_open QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY start_us DESC) <= 50)"
_NAMES = "CASE quota_name WHEN 'five_hour' THEN 'search' WHEN 'seven_day' THEN 'subscription' WHEN 'monthly' THEN 'toolcall' ELSE quota_name END"


def _counted(s, d):
    """Cycles of counters: the quotas under other names, peaks in requests."""
    return _cycles(s, d).withColumns({"quota_name": F.expr(_NAMES), "peak_bp": F.expr("peak_bp DIV 10")})


def _limits(s, d):
    return _q(s, d).groupBy("provider", "account_id").agg((F.max("snapshot_id") % 4 * 400).cast("bigint").alias("usage_limit"))


_PLAN_SQL = f"""WITH RECURSIVE {_STATS}, cn AS (SELECT * REPLACE ({_NAMES} AS quota_name, peak_bp // 10 AS peak_bp) FROM cy),
    cd AS (SELECT cn.* REPLACE (quota_name || chr(10) || span AS quota_name) FROM cn, (VALUES ('range', {3 * DAY}), ('month', {30 * DAY}), ('week', {7 * DAY})) AS v(span, us) WHERE start_us >= {NOW_US} - v.us), {_fold('pp', 'cd')},
    pq AS (SELECT *, split_part(quota_name, chr(10), 1) AS q, split_part(quota_name, chr(10), 2) AS span FROM pp),
    li AS (SELECT provider, account_id, max(snapshot_id) % 4 * 400 AS lim FROM qs GROUP BY 1, 2),
    a AS (SELECT provider, account_id, CAST(coalesce(sum(peak_bp) FILTER (span = 'range' AND q = 'subscription'), 0) AS BIGINT) AS used_range, CAST(coalesce(sum(peak_bp) FILTER (span = 'range'), 0) AS BIGINT) AS all_range,
        CAST(coalesce(sum(peak_bp) FILTER (span = 'month' AND q = 'subscription'), 0) AS BIGINT) AS used_month, CAST(coalesce(sum(peak_bp) FILTER (span = 'week' AND q = 'subscription'), 0) AS BIGINT) AS used_week,
        avg(peak_bp) FILTER (span = 'month' AND q = 'subscription') AS av, coalesce(sum(cycles) FILTER (span = 'month' AND q = 'subscription'), 0) AS n FROM pq GROUP BY 1, 2),
    f AS (SELECT a.*, lim, round(CASE WHEN av > 0 AND lim > 0 THEN av * 100 / lim END, 4) AS fit FROM a LEFT JOIN li ON a.provider = li.provider AND a.account_id IS NOT DISTINCT FROM li.account_id)
    SELECT provider, account_id, used_range, all_range, used_month, used_week, CASE WHEN used_week > 0 THEN round(used_week * CAST(30 AS DOUBLE) / 7, 4) END AS month_at_pace,
    CASE WHEN used_week > 0 THEN coalesce(lim > 0 AND n > 0 AND used_week * CAST(30 AS DOUBLE) / 7 > lim * n * CAST(0.8 AS DOUBLE), false) END AS pace_high, fit AS average_percent,
    CASE WHEN fit < 25 THEN 'much_too_large' WHEN fit < 50 THEN 'roomy' WHEN fit < 80 THEN 'fits' WHEN fit < 95 THEN 'tight' WHEN fit IS NOT NULL THEN 'over' END AS plan_fit FROM f"""


def _pool(s, d):
    return _q(s, d).select(*K.split(", "), "snapshot_id", "us", F.expr("used_bp DIV 10").alias("used"), F.lit(1000).cast("bigint").alias("total"), (F.col("snapshot_id") % 900).alias("weekly_used"), F.when(F.col("account_id") % 3 != 0, F.lit(900).cast("bigint")).alias("weekly_total"))


def _pool_cycles(s, d):
    return _cycles(s, d).select(*K.split(", "), "end_us", F.expr("delta_bp DIV 10").alias("delta"))


_POOL_SQL = f"""WITH {_STATS}, po AS (SELECT {K}, snapshot_id, us, used_bp // 10 AS used, 1000 AS total, snapshot_id % 900 AS weekly_used, CASE WHEN account_id % 3 <> 0 THEN 900 END AS weekly_total FROM qs WHERE us <= {NOW_US} AND us >= {NOW_US - 10 * DAY}),
    ri AS (SELECT *, used - lag(used) OVER (PARTITION BY {K} ORDER BY us, snapshot_id) AS rise FROM po), da AS (SELECT {K}, us // {DAY} AS day, sum(rise) AS used FROM ri WHERE rise >= 0 GROUP BY ALL),
    dn AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY day) <= count(*) OVER (PARTITION BY {K}) // 2 AS old FROM da),
    dd AS (SELECT {K}, count(*) AS days, round(avg(used), 6) AS day_average, CAST(max(used) AS BIGINT) AS day_peak, arg_max(day, (used, -day)) AS peak_day, avg(used) FILTER (old) AS o, avg(used) FILTER (NOT old) AS w FROM dn GROUP BY ALL),
    la AS (SELECT * FROM po QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY us DESC, snapshot_id DESC) = 1), ce AS (SELECT {K}, arg_max(delta_bp // 10, end_us) AS lst FROM cy WHERE end_us <= {NOW_US} GROUP BY ALL),
    j AS (SELECT la.*, days, day_average, day_peak, peak_day, o, w, lst, used * CAST(100 AS DOUBLE) / total AS up, weekly_used * CAST(100 AS DOUBLE) / weekly_total AS wp FROM la
        LEFT JOIN dd ON dd.provider = la.provider AND dd.account_id IS NOT DISTINCT FROM la.account_id AND dd.quota_name = la.quota_name LEFT JOIN ce ON ce.provider = la.provider AND ce.account_id IS NOT DISTINCT FROM la.account_id AND ce.quota_name = la.quota_name)
    SELECT {K}, coalesce(days, 0) AS days, day_average, day_peak, peak_day, CASE WHEN w - o > greatest(5, 0.15 * coalesce(o, 0)) THEN 'rising' WHEN o - w > greatest(5, 0.15 * coalesce(o, 0)) THEN 'falling' ELSE 'stable' END AS trend,
    round(up, 4) AS used_percent, round(lst * CAST(100 AS DOUBLE) / total, 4) AS last_cycle_percent, CASE WHEN wp > 0 THEN round(up / wp, 6) WHEN weekly_total > 0 THEN 0 END AS interval_for_week FROM j"""


def _models(s, d):
    e = usage_events(s, d)
    return e.groupBy("provider", F.col("account_name").alias("account_id"), F.col("session_id").alias("model")).agg((F.sum("output_tokens") % 1000).alias("used"), (F.count("*") % 4 * 333).cast("bigint").alias("total"))


# Names as tools write them, from the parts of names in the part table.
def _named(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    words = F.split(F.initcap("p_name"), " ")
    a, c = F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit("x"))
    k = F.col("p_partkey")
    anti = F.concat(F.when(k % 3 == 0, "custom:").otherwise(" "), a, F.when(k % 4 == 0, " [Beta [x]] ").when(k % 4 == 1, ". -").otherwise("."), c, F.when(k % 5 == 0, " [Open").when(k % 5 == 1, "]-").otherwise(" "))
    cur = F.concat(F.lit(" "), F.when(k % 2 == 0, "Claude-4.6-").otherwise("GPT-"), a, F.when(k % 3 == 0, "-Thinking ").when(k % 3 == 1, "-thinking-2").otherwise(""))
    return p.select("p_partkey", periods.antigravity_model(anti).alias("antigravity"), periods.cursor_model(cur).alias("cursor"))


_NAMED_SQL = r"""WITH w AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, lower(coalesce(nullif(split_part(p_name, ' ', 2), ''), 'x')) AS c FROM part)
    SELECT p_partkey, trim(regexp_replace(a || '-' || c, '[.\- ]+', '-', 'g'), '-') AS antigravity,
    CASE WHEN p_partkey % 2 = 0 THEN 'claude-4-6-' ELSE 'gpt-' END || a || CASE WHEN p_partkey % 3 = 1 THEN '-thinking-2' ELSE '' END AS cursor FROM w"""


# Every event an alert, in two goes; some are dismissed, old ones cleared.
def _alert_log(s, d):
    e = usage_events(s, d).select(F.col("event_id").alias("alert_id"), "provider", "us", (F.col("us") + 6 * HOUR).alias("until_us"), F.lit(False).alias("dismissed"))
    return periods.alert_log(e.where("alert_id % 3 = 0"), e.where("alert_id % 2 = 0"), e.where("alert_id % 5 < 2"), NOW_US, 12 * DAY)


# Events written as JSON lines and CSV, and read back.
def _written(s, d):
    path = f"{work_dir(s)}/quotalens-events-{uuid.uuid4().hex}"
    logs.write_events(usage_events(s, d).select("event_id", "us", "provider", "output_tokens"), path)
    back = s.read.schema("event_id long, us long, provider string, output_tokens long, day date").json(path)
    return back.groupBy(F.col("day").cast("string").alias("day"), "provider").agg(F.count("*").alias("events"), F.sum("output_tokens").alias("output_tokens"))


def _csv(s, d):
    path = f"{work_dir(s)}/quotalens-csv-{uuid.uuid4().hex}"
    e = usage_events(s, d).select(
        F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("Date"), F.concat(F.lit(" m"), F.col("event_id").cast("string"), F.lit(" ")).alias("Model Name"), F.format_number(F.col("input_tokens") * 1000, 0).alias("Input_Tokens"),
        F.col("output_tokens").alias("OUTPUT-tokens"), F.col("cached_input_tokens").alias("cached"), F.concat(F.lit("$"), F.format_number(F.col("event_id") / 4, 2)).alias("Cost (USD)"),
    )
    e.write.option("header", True).csv(path)
    return logs.cursor_csv(s, path).select("model", "us", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens", F.round("cost_usd", 2).alias("cost_usd"))


def _guarded(s, d):
    return records.not_over(usage_events(s, d).select("event_id", "us"), 250_000_000, "events")


def _first_wins(s, d):
    q = _q(s, d).select("snapshot_id", "provider", "us")
    return ingest.first_wins(q.where("snapshot_id % 3 = 0").withColumn("us", F.col("us") + 1), q.where("snapshot_id % 2 = 0").withColumn("us", F.col("us") + 2), q, key="snapshot_id")


QUERIES = {
    "period_insights": (
        lambda s, d: periods.period_insights(b.billing_periods(periods.newest_cycles(an.with_open(_cycles(s, d))))),
        f"""WITH RECURSIVE {_STATS}, {_COMPLETED}, {_fold('pp', 'cc')}, h AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY period DESC) <= count(*) OVER (PARTITION BY {K}) // 2 AS new FROM pp),
        a AS (SELECT {K}, count(*) AS periods, round(avg(peak_bp), 6) AS avg_bp, max(peak_bp) AS max_bp, avg(peak_bp) FILTER (new) AS w, avg(peak_bp) FILTER (NOT new) AS o FROM h GROUP BY ALL),
        c AS (SELECT *, round(CASE WHEN periods >= 3 AND avg_bp > 100 THEN (max_bp - avg_bp) * 100 / avg_bp END, 4) AS over_percent, round(CASE WHEN periods >= 4 AND o > 0 THEN (w - o) * 100 / o END, 4) AS change_percent FROM a)
        SELECT * EXCLUDE (w, o), CASE WHEN over_percent > 50 THEN 'spiky' WHEN over_percent > 10 THEN 'uneven' WHEN over_percent IS NOT NULL THEN 'steady' END AS spread, CASE WHEN change_percent > 15 THEN 'rising' WHEN change_percent < -15 THEN 'falling' WHEN change_percent IS NOT NULL THEN 'steady' END AS trend FROM c""",
    ),
    "rate_ratio": (
        lambda s, d: periods.rate_ratio(_rates(s, d)),
        f"""WITH br AS ({_BURN}), a AS (SELECT provider, account_id, max(rate) FILTER (quota_name = 'five_hour') AS short_rate, max(rate) FILTER (quota_name = 'seven_day') AS long_rate FROM br GROUP BY 1, 2)
        SELECT *, round(short_rate / long_rate, 6) AS ratio FROM a WHERE short_rate >= 1 AND long_rate >= 1""",
    ),
    "plan_use": (lambda s, d: periods.plan_use(_counted(s, d), _limits(s, d), NOW_US, 3 * DAY), _PLAN_SQL),
    "pool_history": (lambda s, d: periods.pool_history(_pool(s, d), _pool_cycles(s, d), NOW_US, 10 * DAY), _POOL_SQL),
    "model_use": (
        lambda s, d: periods.model_use(_models(s, d)),
        f"""WITH {USAGE}, m AS (SELECT provider, account_name AS account_id, session_id AS model, CAST(sum(output_tokens) AS BIGINT) % 1000 AS used, count(*) % 4 * 333 AS total FROM ue GROUP BY 1, 2, 3), p AS (SELECT *, CASE WHEN total > 0 THEN used * CAST(100 AS DOUBLE) / total ELSE 0 END AS p FROM m)
        SELECT provider, account_id, count(*) AS models, round(avg(p), 4) AS avg_percent, round(max(p), 4) AS max_percent, CAST(sum(used) AS BIGINT) AS used, CAST(sum(total) AS BIGINT) AS total,
        coalesce(string_agg(model || CASE WHEN p >= 95 THEN ':critical' ELSE ':warning' END, ',' ORDER BY model || CASE WHEN p >= 95 THEN ':critical' ELSE ':warning' END) FILTER (p >= 80), '') AS high FROM p GROUP BY 1, 2""",
    ),
    "model_names": (_named, _NAMED_SQL),
    "time_ago": (
        lambda s, d: usage_events(s, d).select("event_id", periods.time_ago(F.when(F.col("event_id") % 40 != 0, NOW_US - (F.lit(NOW_US) - F.col("us")) / (F.col("event_id") % 7 * 300 + 1)).cast("bigint"), NOW_US).alias("age")),
        f"""WITH {USAGE}, a AS (SELECT event_id, CASE WHEN event_id % 40 <> 0 THEN {NOW_US} - CAST(trunc({NOW_US} - ({NOW_US} - us) / CAST(event_id % 7 * 300 + 1 AS DOUBLE)) AS BIGINT) END AS g FROM ue)
        SELECT event_id, CASE WHEN g IS NULL THEN '' WHEN g < {MINUTE} THEN 'just now' WHEN g < {HOUR} THEN (g // {MINUTE}) || 'm ago' WHEN g < {DAY} THEN (g // {HOUR}) || 'h ago' ELSE (g // {DAY}) || 'd ago' END AS age FROM a""",
    ),
    "alert_log": (
        _alert_log,
        f"WITH {USAGE} SELECT event_id AS alert_id, provider, us, us + {6 * HOUR} AS until_us, event_id % 5 < 2 AS dismissed FROM ue WHERE (event_id % 3 = 0 OR event_id % 2 = 0) AND us > {NOW_US - 12 * DAY}",
    ),
    "written_events": (_written, f"WITH {USAGE} SELECT CAST(CAST(make_timestamp(us) AS DATE) AS VARCHAR) AS day, provider, count(*) AS events, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM ue GROUP BY 1, 2"),
    "csv_usage": (
        _csv,
        f"""WITH {USAGE} SELECT 'm' || event_id AS model, us // 1000000 * 1000000 AS us, greatest(input_tokens * 1000 - cached_input_tokens, 0) AS input_tokens, cached_input_tokens, output_tokens, input_tokens * 1000 + output_tokens AS total_tokens, round(event_id / CAST(4 AS DOUBLE), 2) AS cost_usd
        FROM ue WHERE input_tokens * 1000 + output_tokens > 0""",
    ),
    "guarded_events": (_guarded, f"WITH {USAGE} SELECT event_id, us FROM ue"),
    "first_wins": (_first_wins, f"WITH {SAMPLES} SELECT snapshot_id, provider, us + CASE WHEN snapshot_id % 3 = 0 THEN 1 WHEN snapshot_id % 2 = 0 THEN 2 ELSE 0 END AS us FROM qs"),
}
