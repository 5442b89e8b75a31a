"""Current state, provider insights, metadata, lookups and bounds. Inputs that the test tables lack are made from samples and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotalens.operators import analytics as an
from quotalens.operators import cycles
from quotalens.operators import current as cur
from quotalens.operators import insights as ins
from quotalens.operators import records as rec
from quotalens.sources.projection import QUOTAS, SAMPLES, USAGE, usage_events

from .insights import DAY, HOUR, LATEST, LEAST_US, NOW_US, PACED, STATUS, WEEK, WINDOW_US, K, QUERIES as _OTHERS, _cycles, _latest, _q
from .quotas import _STATS, ORD, cycles_sql

NAMES = sorted(q for q, _ in QUOTAS.values())
_BURN = _OTHERS["burn_rate"][1]
_RATES = f"br AS ({_BURN})"
_EQ = lambda a, b: f"{a}.provider = {b}.provider AND {a}.account_id IS NOT DISTINCT FROM {b}.account_id AND {a}.quota_name = {b}.quota_name"
_AEQ = lambda a, b: f"{a}.provider = {b}.provider AND {a}.account_id IS NOT DISTINCT FROM {b}.account_id"
_PACED_STATUS = """CASE WHEN delta > -1 AND delta < 1 THEN 'healthy' WHEN delta > 0 THEN CASE WHEN delta >= 15 OR delta >= CAST(0.3 AS DOUBLE) * ls THEN 'critical' WHEN delta >= 10 OR delta >= CAST(0.2 AS DOUBLE) * ls THEN 'warning' ELSE 'healthy' END
    ELSE CASE WHEN -delta >= 15 OR -delta >= CAST(0.3 AS DOUBLE) * (100 - ls) THEN 'very_underuse' WHEN -delta >= 10 OR -delta >= CAST(0.2 AS DOUBLE) * (100 - ls) THEN 'underuse' ELSE 'healthy' END END"""
_TIER = """CASE st WHEN 'critical' THEN 'very_over' WHEN 'warning' THEN 'over' WHEN 'very_underuse' THEN 'very_under' WHEN 'underuse' THEN 'under' ELSE 'on_pace' END"""


def _rates(s, d):
    return an.burn_rate(_q(s, d), NOW_US, WINDOW_US, LEAST_US)


def _cycles_of(s, d, provider: str):
    return cycles.detect_cycles(_q(s, d), cycles.RULES[provider])


_CDC = f"cdc AS ({cycles_sql(cycles.RULES['codex'])})"
_GDC = f"dc AS ({cycles_sql(cycles.RULES['gemini'])})"
_ADC = f"dc AS ({cycles_sql(cycles.RULES['antigravity'])})"
#: The test tables have no code reviews: what is monthly there.
_CNAME = "CASE quota_name WHEN 'monthly' THEN 'code_review' ELSE quota_name END"


def _codex_names(df):
    return df.withColumn("quota_name", F.expr(_CNAME))


def _plans(s, d):
    return _q(s, d).groupBy("provider", "account_id").agg(F.when(F.max(F.col("snapshot_id") % 5 == 0), " Free").otherwise("team").alias("plan"))


def _windows(s, d):
    return _q(s, d).select("provider", "account_id", "quota_name", "snapshot_id", "us", "reset_us", (F.col("reset_us") - 5 * HOUR).alias("window_start_us"), F.expr("used_bp DIV 10").alias("used"), F.lit(1000).cast("bigint").alias("total"))


_WINDOWS = f"ws AS (SELECT {K}, snapshot_id, us, reset_us, reset_us - {5 * HOUR} AS window_start_us, used_bp // 10 AS used, CAST(1000 AS BIGINT) AS total FROM qs)"
_IN_WINDOW = f"""nw AS (SELECT {K}, arg_max(snapshot_id, (us, snapshot_id)) AS newest FROM ws GROUP BY ALL), wl AS (SELECT ws.* FROM ws JOIN nw ON {_EQ('ws', 'nw')} AND ws.snapshot_id = nw.newest),
    wi AS (SELECT ws.*, (wl.window_start_us IS NULL OR ws.us >= wl.window_start_us) AND (wl.reset_us IS NULL OR coalesce(abs(wl.reset_us - ws.reset_us) <= 1000000, false)) AS inside FROM ws JOIN wl ON {_EQ('ws', 'wl')}),
    cw AS (SELECT * FROM wi QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY {K}))"""


def _zai(s, d):
    e = usage_events(s, d)
    n = F.col("event_id")
    details = F.when(n % 5 != 0, F.concat(F.lit('[{"modelCode":"search","usage":'), (n % 7).cast("string"), F.lit('},{"modelCode":"read","usage":'), (n % 3).cast("string"), F.lit("}]")))
    return e.select("provider", F.col("account_name").alias("account_id"), n.alias("snapshot_id"), "us", F.expr(f"us % {DAY} DIV 1000").alias("tokens_used"), F.lit(100_000_000).cast("bigint").alias("tokens_budget"), F.when(n % 4 != 0, F.expr(f"us - us % {DAY} + {DAY}") + DAY).alias("reset_us"), details.alias("details"))


_ZAI = f"""zs AS (SELECT provider, account_name AS account_id, event_id AS snapshot_id, us, us % {DAY} // 1000 AS tokens_used, CAST(100000000 AS BIGINT) AS tokens_budget, CASE WHEN event_id % 4 <> 0 THEN us - us % {DAY} + {2 * DAY} END AS reset_us,
    event_id % 7 AS search, event_id % 3 AS read, event_id % 5 <> 0 AS has_details FROM ue WHERE us <= {NOW_US} AND us > {NOW_US - 7 * DAY})"""


def _span(cond: str, n: str) -> str:
    return f"arg_min(us, (us, snapshot_id)) FILTER ({cond}) AS {n}_t0, arg_max(us, (us, snapshot_id)) FILTER ({cond}) AS {n}_t1, arg_min(tokens_used, (us, snapshot_id)) FILTER ({cond}) AS {n}_v0, arg_max(tokens_used, (us, snapshot_id)) FILTER ({cond}) AS {n}_v1"


_RATE = lambda n: f"CASE WHEN {n}_t1 > {n}_t0 AND {n}_v1 > {n}_v0 THEN ({n}_v1 - {n}_v0) * CAST({HOUR} AS DOUBLE) / ({n}_t1 - {n}_t0) END"


def _copilot(s, d):
    return _latest(s, d).select("provider", "account_id", "quota_name", "reset_us", F.lit(300).cast("bigint").alias("entitlement"), F.expr("300 - used_bp * 3 DIV 100").alias("remaining"), (F.col("snapshot_id") % 6 == 0).alias("unlimited"))


def _metadata(s, d):
    """Events with metadata as agents write it: some keys missing, blank or padded, some rows without an object."""
    e = usage_events(s, d)
    n = F.col("event_id")
    text = F.concat(
        F.lit('{"session_id":" '), F.col("session_id"), F.lit(' ","source_path":"'), F.col("source_path"), F.lit('"'), F.when(n % 3 == 0, F.concat(F.lit(',"fast_mode":'), F.when(n % 2 == 0, "true").otherwise("false"))).otherwise(""),
        F.when(n % 4 == 0, ',"reasoning_effort":" high "').otherwise(""), F.when(n % 5 == 0, ',"speed_mode":"turbo"').otherwise(',"speed_mode":" "'), F.when(n % 6 == 0, ',"input_tokens":7').otherwise(""),
        F.lit(',"quota_telemetry":{"plan":"'), F.when(n % 7 == 0, "team").otherwise("plus"), F.lit('","seven_day":{"used":'), ((n % 120) / 1).cast("int").cast("string"), F.lit(',"reset":'), F.expr("us DIV 1000000 + 3600").cast("string"), F.lit('},"five_hour":{"used":12.5,"reset":'), (n % 2 * 1700000000).cast("string"), F.lit("}}}"),
    )
    return e.select(n.alias("event_id"), "us", F.col("account_name").alias("account"), F.when(n % 8 == 0, "Codex CLI").otherwise("other").alias("integration"), "input_tokens", "output_tokens", F.when(n % 50 == 1, "oops").when(n % 50 == 2, F.lit(None).cast("string")).otherwise(text).alias("metadata"))


_META = "md AS (SELECT *, event_id % 50 NOT IN (1, 2) AS has FROM ue)"


def _places(s, d):
    """Rows of two tables with a key, and their provenance."""
    e = usage_events(s, d)
    rows = e.select(F.when(F.col("event_id") % 2 == 0, "events").otherwise("hours").alias("table_name"), F.expr("event_id DIV 2").alias("row_key"))
    origin = e.where("event_id % 3 = 0").select(F.when(F.col("event_id") % 2 == 0, "events").otherwise("hours").alias("table_name"), F.expr("event_id DIV 4").alias("row_key"), F.col("event_id").alias("seq"), F.concat(F.lit("o"), (F.col("event_id") % 5).cast("string")).alias("origin"))
    return rows, origin


QUERIES = {
    "current_state": (
        lambda s, d: cur.current_state(_q(s, d).withColumn("used_bp", F.expr("used_bp * 7 % 10000")), NOW_US, WINDOW_US, LEAST_US),
        f"""WITH {SAMPLES.replace('qs AS (', 'qz AS (')}, qs AS (SELECT * REPLACE (used_bp * 7 % 10000 AS used_bp) FROM qz), la AS (SELECT * FROM qs WHERE us <= {NOW_US} QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY us DESC, snapshot_id DESC) = 1),
        br AS (WITH {_BURN[_BURN.index('a AS (SELECT'):]}),
        p AS (SELECT la.*, rate, hours_left, exhaust_hours, projected_bp, exhausts_first, round(CASE WHEN la.reset_us - {NOW_US} > {WEEK} THEN 100 WHEN la.reset_us < {NOW_US} THEN 0 ELSE (la.reset_us - {NOW_US}) * CAST(100 AS DOUBLE) / {WEEK} END, 6) AS ls FROM la LEFT JOIN br ON {_EQ('la', 'br')}),
        r AS (SELECT *, used_bp / CAST(100 AS DOUBLE) - (100 - ls) AS delta, {PACED} AND reset_us IS NOT NULL AS paced FROM p), t AS (SELECT *, CASE WHEN paced THEN {_PACED_STATUS} ELSE {STATUS.format('used_bp')} END AS st FROM r)
        SELECT {K}, snapshot_id, us, {NOW_US} - us AS age_us, used_bp, reset_us, rate, hours_left, exhaust_hours, projected_bp, exhausts_first, CASE WHEN paced THEN {_TIER} END AS pace, st AS status,
        row_number() OVER (PARTITION BY provider, account_id ORDER BY CASE WHEN provider = 'anthropic' THEN coalesce(list_position(['five_hour', 'seven_day', 'seven_day_sonnet', 'monthly_limit', 'extra_usage'], quota_name) - 1, 100) WHEN provider = 'openai' THEN coalesce(list_position(['five_hour', 'seven_day', 'code_review'], quota_name) - 1, 100) ELSE 100 END, quota_name) AS place FROM t""",
    ),
    "current_window": (lambda s, d: cur.current_window(_windows(s, d)), f"WITH {SAMPLES}, {_WINDOWS}, {_IN_WINDOW} SELECT * EXCLUDE (inside) FROM cw"),
    "minimax_insights": (
        lambda s, d: cur.minimax_insights(_windows(s, d), NOW_US),
        f"""WITH {SAMPLES}, {_WINDOWS.replace("FROM qs", f"FROM qs WHERE us <= {NOW_US}")}, {_IN_WINDOW},
        a AS (SELECT {K}, min(us) AS t0, max(us) AS t1, arg_min(used, (us, snapshot_id)) AS u0, arg_max(used, (us, snapshot_id)) AS used, max(total) AS total, (list(reset_us ORDER BY us DESC, snapshot_id DESC))[1] AS reset_us FROM cw GROUP BY ALL),
        b AS (SELECT *, round(CASE WHEN t1 > t0 AND used > u0 THEN (used - u0) * CAST({HOUR} AS DOUBLE) / (t1 - t0) END, 6) AS rate, (reset_us - {NOW_US}) / CAST({HOUR} AS DOUBLE) AS h FROM a),
        c AS (SELECT *, CAST(floor(CASE WHEN h > 0 THEN used + coalesce(rate, 0) * h END + 0.5) AS BIGINT) AS reached, CASE WHEN rate > 0 THEN (total - used) / rate END AS ex FROM b)
        SELECT {K}, used, total, rate, CASE WHEN reached > total THEN total ELSE reached END AS projected, round(ex, 4) AS exhaust_hours, CASE WHEN used >= total THEN 'exhausted' WHEN coalesce(ex < h, false) THEN 'over_pace' WHEN used * 10 >= total * 8 THEN 'high' ELSE 'safe' END AS level FROM c""",
    ),
    "hidden_insights": (
        lambda s, d: cur.hide_insights(_q(s, d).select("snapshot_id", F.concat("provider", F.lit(":"), "quota_name").alias("key")), _q(s, d).where("used_bp > 9900 AND quota_name LIKE 'five%' AND provider != 'anthropic'").select(F.concat("provider", F.lit(":"), "quota_name").alias("key")), s.createDataFrame([("openai:five_hour", "openai:seven_day"), ("gemini:daily", "anthropic:daily")], "key string, other string")),
        f"""WITH {SAMPLES}, h AS (SELECT DISTINCT provider || ':' || quota_name AS key FROM qs WHERE used_bp > 9900 AND quota_name LIKE 'five%' AND provider <> 'anthropic'), c AS (SELECT * FROM (VALUES ('openai:five_hour', 'openai:seven_day'), ('gemini:daily', 'anthropic:daily')) AS t(key, other))
        SELECT snapshot_id, provider || ':' || quota_name AS key FROM qs WHERE provider || ':' || quota_name NOT IN (SELECT key FROM h UNION SELECT other FROM c WHERE key IN (SELECT key FROM h))""",
    ),
    "logging_pivot": (
        lambda s, d: cur.logging_pivot(_q(s, d).withColumn("snapshot_id", F.expr("snapshot_id DIV 4")).withColumn("us", F.expr(f"us - us % {DAY}")).groupBy("provider", "account_id", "quota_name", "snapshot_id", "us").agg(F.max("used_bp").alias("used_bp")), NAMES),
        f"""WITH {SAMPLES}, g AS (SELECT {K}, snapshot_id // 4 AS snapshot_id, us - us % {DAY} AS us, max(used_bp) AS used_bp FROM qs GROUP BY ALL), l AS (SELECT *, used_bp - lag(used_bp) OVER (PARTITION BY {K} {ORD}) AS delta FROM g)
        SELECT provider, account_id, snapshot_id, us, {', '.join(f"max(used_bp) FILTER (quota_name = '{n}') AS {n}_bp, max(delta) FILTER (quota_name = '{n}') AS {n}_delta_bp" for n in NAMES)} FROM l GROUP BY 1, 2, 3, 4""",
    ),
    "zai_rate": (
        lambda s, d: cur.zai_rate(_latest(s, d).withColumn("start_us", F.col("us") - HOUR), NOW_US),
        f"""WITH {SAMPLES}, {LATEST}, r AS (SELECT *, CASE WHEN {NOW_US} > us - {HOUR} AND used_bp > 0 THEN used_bp * CAST({HOUR} AS DOUBLE) / ({NOW_US} - us + {HOUR}) END AS rt FROM la)
        SELECT {K}, round(rt, 6) AS rate, round(CASE WHEN reset_us > {NOW_US} THEN used_bp + rt * (reset_us - {NOW_US}) / CAST({HOUR} AS DOUBLE) END, 4) AS projected_bp FROM r""",
    ),
    "zai_insights": (
        lambda s, d: cur.zai_insights(_zai(s, d), NOW_US),
        f"""WITH {USAGE}, {_ZAI}, zn AS (SELECT *, row_number() OVER (PARTITION BY provider, account_id, us > {NOW_US - DAY} ORDER BY us, snapshot_id) AS nth, count(*) OVER (PARTITION BY provider, account_id, us > {NOW_US - DAY}) AS n_all FROM zs),
        a AS (SELECT provider, account_id, {_span(f'us > {NOW_US - DAY}', 'd')}, {_span(f'us > {NOW_US - DAY} AND n_all >= 4 AND nth <= n_all // 2', 'o')}, {_span(f'us > {NOW_US - DAY} AND n_all >= 4 AND nth > n_all // 2', 'n')}, {_span('true', 'w')},
            arg_max(tokens_used, (us, snapshot_id)) AS used, max(tokens_budget) AS budget, (list(reset_us ORDER BY us DESC, snapshot_id DESC))[1] AS reset_us, arg_max(search, (us, snapshot_id)) AS search, arg_max(read, (us, snapshot_id)) AS read, arg_max(has_details, (us, snapshot_id)) AS hd FROM zn GROUP BY 1, 2),
        b AS (SELECT *, round({_RATE('d')}, 6) AS rate, {_RATE('o')} AS old, CASE WHEN n_t1 > n_t0 THEN (n_v1 - n_v0) * CAST({HOUR} AS DOUBLE) / (n_t1 - n_t0) END AS new, CASE WHEN w_t1 > w_t0 AND w_v1 > w_v0 THEN w_v1 - w_v0 END AS week_tokens, round({_RATE('w')} * 24, 4) AS day_tokens,
            (reset_us - {NOW_US}) / CAST({HOUR} AS DOUBLE) AS h, CASE WHEN hd THEN CAST(search + read AS DOUBLE) END AS calls FROM a),
        c AS (SELECT *, round(CASE WHEN h > 0 THEN (used + rate * h) * 10000 / budget END, 4) AS projected_bp, (new - old) * 100 / old AS change FROM b)
        SELECT provider, account_id, rate, projected_bp, CASE WHEN projected_bp >= 9500 THEN 'negative' WHEN projected_bp >= 8000 THEN 'warning' WHEN projected_bp >= 5000 THEN 'info' WHEN projected_bp IS NOT NULL THEN 'positive' END AS severity,
        CASE WHEN change > 25 THEN 'rising' WHEN change < -25 THEN 'falling' WHEN change IS NOT NULL THEN 'steady' END AS trend, week_tokens, day_tokens, budget * 30 AS month_capacity, calls AS tool_calls, round(CASE WHEN calls > 0 THEN used / calls END, 4) AS tokens_a_call,
        CASE WHEN NOT hd THEN NULL WHEN search > read THEN 'search' ELSE 'read' END AS top_tool FROM c""",
    ),
    "copilot_insights": (
        lambda s, d: cur.copilot_insights(_copilot(s, d), _rates(s, d), _q(s, d), NOW_US, NOW_US - 7 * DAY, "monthly"),
        f"""WITH {SAMPLES}, {LATEST}, {_RATES}, n AS (SELECT provider, account_id, count(*) AS snapshots FROM qs WHERE quota_name = 'monthly' AND us >= {NOW_US - 7 * DAY} GROUP BY 1, 2),
        c AS (SELECT *, round((used_bp * 3 // 100) * CAST(10000 AS DOUBLE) / 300, 4) AS u FROM la WHERE snapshot_id % 6 <> 0)
        SELECT c.provider, c.account_id, c.quota_name, u AS used_bp, CASE WHEN rate > 0 THEN 'forecast' ELSE 'current' END AS kind, CASE WHEN rate > 0 THEN rate END AS rate, CASE WHEN u >= 9000 THEN 'negative' WHEN u >= 7000 THEN 'warning' ELSE 'positive' END AS severity,
        CASE WHEN c.reset_us > {NOW_US} THEN c.reset_us - {NOW_US} END AS reset_in_us, coalesce(snapshots, 0) AS snapshots FROM c LEFT JOIN br ON {_EQ('c', 'br')} LEFT JOIN n ON {_AEQ('c', 'n')}""",
    ),
    "codex_insights": (
        lambda s, d: cur.codex_insights(_codex_names(_latest(s, d)), _codex_names(_cycles_of(s, d, "codex")), _codex_names(_rates(s, d)), _plans(s, d), NOW_US, 5, "5-day"),
        f"""WITH {SAMPLES}, {LATEST}, {_CDC}, {_RATES}, pl AS (SELECT provider, account_id, bool_or(snapshot_id % 5 = 0) AS free FROM qs GROUP BY 1, 2),
        cy AS (SELECT * REPLACE ({_CNAME} AS quota_name) FROM cdc), lc AS (SELECT la.* REPLACE ({_CNAME} AS quota_name) FROM la), rc AS (SELECT * REPLACE ({_CNAME} AS quota_name) FROM br),
        own AS (SELECT cy.*, free, CASE WHEN free THEN CASE quota_name WHEN 'seven_day' THEN 0 WHEN 'five_hour' THEN 1 END WHEN quota_name = 'five_hour' THEN 0 END + CASE WHEN end_us IS NULL THEN 2 ELSE 0 END AS place FROM cy JOIN pl ON {_AEQ('cy', 'pl')} WHERE end_us IS NULL OR start_us >= {NOW_US - 5 * DAY}),
        best AS (SELECT * FROM own WHERE place IS NOT NULL QUALIFY place = min(place) OVER (PARTITION BY provider, account_id)),
        hi AS (SELECT provider, account_id, count(*) FILTER (end_us IS NOT NULL) AS cycles, round(avg(delta_bp), 4) AS avg_delta_bp, max(peak_bp) AS peak_bp FROM best GROUP BY 1, 2),
        nw AS (SELECT lc.provider, lc.account_id, free, CASE WHEN free AND quota_name = 'five_hour' THEN 'seven_day' ELSE quota_name END AS name, used_bp, us, snapshot_id, reset_us FROM lc JOIN pl ON {_AEQ('lc', 'pl')}),
        nn AS (SELECT * FROM nw QUALIFY row_number() OVER (PARTITION BY provider, account_id, name ORDER BY used_bp DESC, us DESC, snapshot_id DESC) = 1),
        rn AS (SELECT rc.provider, rc.account_id, CASE WHEN free AND quota_name = 'five_hour' THEN 'seven_day' ELSE quota_name END AS name, quota_name, rate, projected_bp FROM rc JOIN pl ON {_AEQ('rc', 'pl')}),
        r1 AS (SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY provider, account_id, name ORDER BY name <> quota_name) = 1),
        j AS (SELECT nn.*, rate, CASE WHEN rate > 1 THEN greatest(used_bp, projected_bp) END AS fc, CASE WHEN coalesce(rate, 0) <= 1 THEN 'info' WHEN nn.name = 'code_review' THEN CASE WHEN used_bp >= 9500 THEN 'critical' WHEN used_bp >= 8000 THEN 'danger' WHEN used_bp >= 5000 THEN 'warning' ELSE 'healthy' END ELSE {STATUS.format('used_bp')} END AS st FROM nn LEFT JOIN r1 ON {_AEQ('nn', 'r1')} AND nn.name = r1.name),
        o AS (SELECT provider, account_id, free, {', '.join(f"max(CAST(fc AS DOUBLE)) FILTER (name = '{q}') AS {q}_forecast_bp, max(st) FILTER (name = '{q}') AS {q}_status" for q in cur.FORECASTS)}, max(used_bp) FILTER (name = 'seven_day') AS used, max(reset_us) FILTER (name = 'seven_day') AS reset_us FROM j GROUP BY 1, 2, 3),
        dd AS (SELECT o.*, sum(CASE WHEN dow BETWEEN 1 AND 5 THEN greatest(0, least({NOW_US} - b, {DAY})) ELSE 0 END) AS done, sum(CASE WHEN dow BETWEEN 1 AND 5 THEN {DAY} ELSE 0 END) AS whole FROM o LEFT JOIN (SELECT provider AS p2, account_id AS a2, reset_us - {7 * DAY} + k * {DAY} AS b, dayofweek(make_timestamp(reset_us - {7 * DAY} + k * {DAY})) AS dow FROM o, range(7) AS t(k)) ON p2 = provider AND a2 IS NOT DISTINCT FROM account_id GROUP BY ALL),
        pc AS (SELECT *, CASE WHEN reset_us > {NOW_US} AND reset_us - {NOW_US} <= {7 * DAY} THEN round(used - done * CAST(10000 AS DOUBLE) / whole, 4) END AS pace_bp FROM dd)
        SELECT pc.provider, pc.account_id, CASE WHEN free THEN 'seven_day' ELSE 'five_hour' END AS primary_quota, coalesce(cycles, 0) AS cycles, avg_delta_bp, peak_bp, {', '.join(f'{q}_forecast_bp, {q}_status' for q in cur.FORECASTS)}, pace_bp, CASE WHEN pace_bp BETWEEN -200 AND 200 THEN 'on_pace' WHEN pace_bp > 200 THEN 'over' WHEN pace_bp < -200 THEN 'reserve' END AS pace
        FROM pc LEFT JOIN hi ON {_AEQ('pc', 'hi')}""",
    ),
    "gemini_insights": (
        lambda s, d: cur.gemini_insights(_latest(s, d).withColumn("model", _gemini_model()), _cycles_of(s, d, "gemini").withColumn("model", _gemini_model()), NOW_US),
        f"""WITH {SAMPLES}, {LATEST}, {_GDC}, c AS (SELECT *, {{0}} AS model FROM dc), cf AS (SELECT *, {{1}} AS family, row_number() OVER (PARTITION BY provider, account_id, model, end_us IS NULL ORDER BY start_us DESC) AS nth FROM c),
        g AS (SELECT provider, account_id, family, round(max(CASE WHEN end_us IS NULL AND {NOW_US} - start_us >= {HOUR // 6} AND delta_bp > 0 THEN delta_bp * CAST({HOUR} AS DOUBLE) / ({NOW_US} - start_us) END), 6) AS rate, count(*) FILTER (end_us IS NOT NULL AND nth <= 50) AS completed,
            round(avg(peak_bp) FILTER (end_us IS NOT NULL AND nth <= 50), 4) AS avg_peak_bp, max(peak_bp) FILTER (end_us IS NOT NULL AND nth <= 50) AS max_peak_bp FROM cf GROUP BY 1, 2, 3),
        lm AS (SELECT *, {{0}} AS model FROM la), lf AS (SELECT *, {{1}} AS family FROM lm), f AS (SELECT provider, account_id, family, arg_min(used_bp, model) AS used_bp, min(reset_us) AS reset_us FROM lf GROUP BY 1, 2, 3),
        j AS (SELECT f.*, rate, coalesce(completed, 0) AS completed, avg_peak_bp, max_peak_bp, (10000 - used_bp) / rate AS h FROM f LEFT JOIN g ON {_AEQ('f', 'g')} AND f.family = g.family)
        SELECT * EXCLUDE (h), round(h, 4) AS exhaust_hours, CASE WHEN rate IS NULL THEN 'info' WHEN coalesce(h < (reset_us - {NOW_US}) / CAST({HOUR} AS DOUBLE), false) THEN 'negative' WHEN rate >= 500 THEN 'warning' ELSE 'positive' END AS severity FROM j""".replace(
            "{0}", "CASE quota_name WHEN 'five_hour' THEN 'gemini-3-pro' WHEN 'seven_day' THEN 'gemini-3-flash' WHEN 'monthly' THEN 'gemini-2-pro' ELSE quota_name END"
        ).replace("{1}", "CASE WHEN contains(model, 'pro') THEN 'pro' WHEN contains(model, 'flash') THEN 'flash' ELSE model END"),
    ),
    "openrouter_insights": (
        lambda s, d: cur.openrouter_insights(_latest(s, d).select("provider", "account_id", (F.col("used_bp") / 100.0).alias("usage"), F.when(F.col("snapshot_id") % 3 != 0, F.col("account_id") % 2 * 100.0).alias("usage_limit"), F.when(F.col("snapshot_id") % 2 == 0, True).alias("free_tier"))),
        f"""WITH {SAMPLES}, {LATEST}, o AS (SELECT provider, account_id, used_bp / CAST(100 AS DOUBLE) AS usage, CASE WHEN snapshot_id % 3 <> 0 THEN account_id % 2 * CAST(100 AS DOUBLE) END AS lim, snapshot_id % 2 = 0 AS free_tier FROM la),
        p AS (SELECT *, round(CASE WHEN lim > 0 THEN usage * 10000 / lim END, 4) AS u FROM o)
        SELECT provider, account_id, usage, CASE WHEN lim > 0 THEN greatest(lim - usage, 0) END AS remaining, u AS used_bp, CASE WHEN u >= 9000 THEN 'high' WHEN u >= 7500 THEN 'moderate' END AS level, free_tier FROM p""",
    ),
    "antigravity_insights": (
        lambda s, d: cur.antigravity_insights(_latest(s, d).withColumn("group", _group()), _cycles_of(s, d, "antigravity").withColumn("group", _group()).withColumn("model", F.col("quota_name")), NOW_US, NOW_US - 20 * DAY),
        f"""WITH {SAMPLES}, {LATEST}, {_ADC}, c AS (SELECT provider, account_id, CASE WHEN starts_with(quota_name, 'seven') THEN 'week' ELSE 'other' END AS "group", quota_name, start_us, end_us, CASE WHEN delta_bp > 0 AND coalesce(end_us, {NOW_US}) > start_us THEN delta_bp * CAST({HOUR} AS DOUBLE) / (coalesce(end_us, {NOW_US}) - start_us) END AS rt FROM dc),
        m AS (SELECT provider, account_id, "group", quota_name, avg(rt) FILTER (end_us IS NOT NULL AND start_us >= {NOW_US - 20 * DAY}) AS dn, max(rt) FILTER (end_us IS NULL) AS op FROM c GROUP BY 1, 2, 3, 4),
        g AS (SELECT provider, account_id, "group", round(sum(dn), 4) AS completed_rate, round(sum(op), 4) AS open_rate FROM m GROUP BY 1, 2, 3),
        l AS (SELECT provider, account_id, CASE WHEN starts_with(quota_name, 'seven') THEN 'week' ELSE 'other' END AS "group", max(used_bp) AS used_bp, min(reset_us) AS reset_us FROM la GROUP BY 1, 2, 3),
        j AS (SELECT l.*, completed_rate, open_rate, CASE WHEN open_rate > 0 THEN open_rate ELSE completed_rate END AS rate FROM l LEFT JOIN g ON {_AEQ('l', 'g')} AND l."group" = g."group"),
        h AS (SELECT *, CASE WHEN rate > 0 THEN (10000 - used_bp) / rate END AS hh FROM j), e AS (SELECT * EXCLUDE (hh), round(hh, 4) AS exhaust_hours, CASE WHEN coalesce(hh > 0 AND hh < (reset_us - {NOW_US}) / CAST({HOUR} AS DOUBLE), false) THEN 'critical' WHEN hh <= 0 THEN 'info' WHEN rate >= 500 THEN 'warning' ELSE 'info' END AS level FROM h)
        SELECT *, min(exhaust_hours) FILTER (level = 'critical') OVER (PARTITION BY provider, account_id) AS earliest_hours FROM e""",
    ),
    "normalized_metadata": (
        lambda s, d: rec.normalized_metadata(_metadata(s, d)).select("event_id", "session_id", "source_path", "reasoning_effort", "mode", "speed_mode", "input_tokens", "output_tokens"),
        f"""WITH {USAGE}, {_META} SELECT event_id, CASE WHEN has THEN session_id ELSE '' END AS session_id, CASE WHEN has THEN source_path ELSE '' END AS source_path, CASE WHEN has AND event_id % 4 = 0 THEN 'high' ELSE 'unknown' END AS reasoning_effort, 'unknown' AS mode,
        CASE WHEN NOT has THEN 'unknown' WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'fast' ELSE 'standard' END WHEN event_id % 5 = 0 THEN 'turbo' ELSE 'unknown' END AS speed_mode, CASE WHEN has AND event_id % 6 = 0 THEN 7 ELSE input_tokens END AS input_tokens, output_tokens FROM md""",
    ),
    "event_meters": (
        lambda s, d: rec.meters_from_events(_metadata(s, d)),
        f"""WITH {USAGE}, {_META}, m AS (SELECT * FROM md WHERE has AND event_id % 8 = 0 AND event_id % 7 <> 0)
        SELECT account_name AS account, us, 'seven_day' AS quota_name, 'plus' AS plan, event_id % 120 * 100 AS used_bp, (us // 1000000 + 3600) * 1000000 AS reset_us FROM m WHERE event_id % 120 <= 100
        UNION ALL SELECT account_name, us, 'five_hour', 'plus', 1250, 1700000000000000 FROM m WHERE event_id % 2 = 1""",
    ),
    "resolved_accounts": (
        lambda s, d: rec.resolved_accounts(usage_events(s, d).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ext"), (F.col("event_id") % 30).cast("string"))).when(F.col("event_id") % 3 == 1, (F.col("event_id") % 9).cast("string")).otherwise("none").alias("external")), s.createDataFrame([(5, "ext3"), (4, "ext3"), (9, "ext6")], "account_id long, external_id string")),
        f"""WITH {USAGE}, r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ext' || CAST(event_id % 30 AS VARCHAR) WHEN 1 THEN CAST(event_id % 9 AS VARCHAR) ELSE 'none' END AS external FROM ue)
        SELECT event_id, external, coalesce(CASE external WHEN 'ext3' THEN 4 WHEN 'ext6' THEN 9 END, TRY_CAST(external AS BIGINT), 1) AS account_id FROM r""",
    ),
    "snapshot_receipts": (
        lambda s, d: rec.with_receipts(_q(s, d).select("snapshot_id", "us"), usage_events(s, d).where("event_id % 4 = 0").select(F.col("event_id").cast("string").alias("entity_id"), F.col("source_path").alias("device_id"), (F.col("event_id") * 2).alias("receipt_id"))),
        f"WITH {USAGE}, {SAMPLES[SAMPLES.index('qs AS'):]} SELECT snapshot_id, qs.us, ue.source_path AS device_id, ue.event_id * 2 AS receipt_id FROM qs LEFT JOIN ue ON ue.event_id = snapshot_id AND ue.event_id % 4 = 0",
    ),
    "provenance": (
        lambda s, d: rec.with_provenance(*_places(s, d)),
        f"""WITH {USAGE}, t AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'events' ELSE 'hours' END AS table_name, event_id FROM ue), p AS (SELECT table_name, event_id // 4 AS row_key, arg_min('o' || CAST(event_id % 5 AS VARCHAR), event_id) AS origin FROM t WHERE event_id % 3 = 0 GROUP BY 1, 2)
        SELECT t.table_name, event_id // 2 AS row_key, origin FROM t LEFT JOIN p ON p.table_name = t.table_name AND p.row_key = event_id // 2""",
    ),
    "history_bounds": (
        lambda s, d: rec.history_bounds({"events": usage_events(s, d), "samples": _q(s, d).where("used_bp < 0"), "late": _q(s, d).where(f"us > {NOW_US}")}),
        f"""WITH {USAGE}, {SAMPLES[SAMPLES.index('qs AS'):]} SELECT 'events' AS name, min(us) AS first_us, max(us) AS last_us FROM ue UNION ALL SELECT 'late', min(us), max(us) FROM qs WHERE us > {NOW_US}
        UNION ALL SELECT '*', least((SELECT min(us) FROM ue), (SELECT min(us) FROM qs WHERE us > {NOW_US})), greatest((SELECT max(us) FROM ue), (SELECT max(us) FROM qs WHERE us > {NOW_US}))""",
    ),
    "origins": (
        lambda s, d: rec.origins(usage_events(s, d).select(F.col("session_id").alias("origin")), usage_events(s, d).select(F.col("source_path").alias("origin"))),
        f"WITH {USAGE} SELECT session_id AS origin FROM ue WHERE trim(session_id) <> '' UNION SELECT source_path FROM ue WHERE trim(source_path) <> ''",
    ),
    "ranked_providers": (
        lambda s, d: rec.observed({"samples": _q(s, d), "events": usage_events(s, d)}, ("openai", "anthropic")),
        f"WITH {SAMPLES}, p AS (SELECT DISTINCT provider FROM qs) SELECT provider, row_number() OVER (ORDER BY CASE provider WHEN 'openai' THEN 0 WHEN 'anthropic' THEN 1 ELSE 2 END, provider) AS place FROM p",
    ),
    "burn_rate_of_cycles": (
        lambda s, d: an.burn_rate(_q(s, d), NOW_US, 2 * DAY, LEAST_US, ins.cycle_rate(an.with_open(_cycles(s, d)), NOW_US)).select("provider", "account_id", "quota_name", "n", "rate"),
        f"""WITH {_STATS}, op AS (SELECT *, segment = max(segment) OVER (PARTITION BY {K}) AS is_open FROM cy), cr AS (SELECT {K}, round(CASE WHEN {NOW_US} - start_us >= {HOUR // 2} AND delta_bp > 0 THEN delta_bp * CAST({HOUR} AS DOUBLE) / ({NOW_US} - start_us) END, 6) AS rt FROM op WHERE is_open),
        a AS (SELECT {K}, min(us) AS t0, max(us) AS t1, arg_min(used_bp, (us, snapshot_id)) AS b0, arg_max(used_bp, (us, snapshot_id)) AS b1, count(*) AS n FROM qs WHERE us > {NOW_US - 2 * DAY} AND us <= {NOW_US} GROUP BY ALL)
        SELECT a.provider, a.account_id, a.quota_name, n, coalesce(round(CASE WHEN n >= 2 AND t1 - t0 >= {LEAST_US} THEN greatest(b1 - b0, 0) * CAST({HOUR} AS DOUBLE) / (t1 - t0) END, 6), CASE WHEN rt > 0 THEN rt END) AS rate FROM a LEFT JOIN cr ON {_EQ('a', 'cr')}""",
    ),
}


def _gemini_model():
    return F.when(F.col("quota_name") == "five_hour", "gemini-3-pro").when(F.col("quota_name") == "seven_day", "gemini-3-flash").when(F.col("quota_name") == "monthly", "gemini-2-pro").otherwise(F.col("quota_name"))


def _group():
    return F.when(F.col("quota_name").startswith("seven"), "week").otherwise("other")
