"""Usage queries: rollups, prices, credits."""

from __future__ import annotations

from quotalens.functions import pricing
from quotalens.operators import rollup
from quotalens.sources.projection import PRICES_SQL, USAGE, prices, usage_events

FROM_US, TO_US = 1_704_844_800_000_000, 1_705_708_800_000_000  # 2024-01-10 to 2024-01-20
#: Events before this are archived by hour, later ones stay raw.
CUT_US = 1_705_276_800_000_000

_TOK = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in rollup.TOKENS)
MEASURES = f"count(*) AS request_count, {_TOK}, CAST(coalesce(sum(cost_cents), 0) AS BIGINT) AS cost_cents, count(*) FILTER (cost_cents IS NULL) AS unpriced"
_DIM = ", ".join(rollup.DIMENSIONS)
_HOUR = f"us - us % {rollup.HOUR_US}"
ARCHIVE = f"{USAGE}, archive AS (SELECT {_HOUR} AS hour_us, {_DIM}, {MEASURES}, min(us) AS first_us, max(us) AS last_us FROM ue WHERE us < {CUT_US} GROUP BY ALL)"
UNITED = f"""{ARCHIVE}, united AS (SELECT {_DIM}, us AS first_us, us AS last_us, 1 AS request_count, {', '.join(rollup.TOKENS)}, coalesce(cost_cents, 0) AS cost_cents,
    CAST(cost_cents IS NULL AS BIGINT) AS unpriced FROM ue WHERE us >= {CUT_US}
    UNION ALL SELECT {_DIM}, first_us, last_us, request_count, {', '.join(rollup.TOKENS)}, cost_cents, unpriced FROM archive)"""
REMEASURES = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ["request_count", *rollup.TOKENS, "cost_cents", "unpriced"])


def _united(spark, d):
    events = usage_events(spark, d)
    return rollup.with_archive(events.where(f"us >= {CUT_US}"), rollup.compact_hourly(events.where(f"us < {CUT_US}")))


_SIZE = rollup.bucket_seconds(86_400)
_B = _SIZE * 1_000_000

QUERIES = {
    "usage_buckets": (lambda s, d: rollup.usage_buckets(usage_events(s, d), _SIZE), f"WITH {USAGE} SELECT integration_name, us - us % {_B} AS bucket_us, {MEASURES} FROM ue GROUP BY ALL"),
    "usage_summary": (lambda s, d: rollup.usage_summary(usage_events(s, d)), f"WITH {USAGE} SELECT integration_name, provider, account_name, model, {MEASURES}, max(us) AS last_us FROM ue GROUP BY ALL"),
    "hourly_compaction": (lambda s, d: rollup.compact_hourly(usage_events(s, d)), f"WITH {USAGE} SELECT {_HOUR} AS hour_us, {_DIM}, {MEASURES}, min(us) AS first_us, max(us) AS last_us FROM ue GROUP BY ALL"),
    "raw_union_archive": (_united, f"WITH {UNITED} SELECT * FROM united"),
    "usage_effort_summary": (lambda s, d: rollup.effort_summary(_united(s, d)), f"WITH {USAGE} SELECT {_DIM}, {MEASURES}, max(us) AS last_us FROM ue GROUP BY ALL"),
    "usage_effort_totals": (lambda s, d: rollup.effort_totals(_united(s, d), FROM_US, TO_US, "purchase"), f"WITH {UNITED} SELECT {_DIM}, {REMEASURES} FROM united WHERE first_us < {TO_US} AND last_us >= {FROM_US} AND integration_name = 'purchase' GROUP BY ALL"),
    "usage_totals": (lambda s, d: rollup.usage_totals(_united(s, d), FROM_US, TO_US), f"WITH {UNITED} SELECT integration_name, {REMEASURES} FROM united WHERE first_us < {TO_US} AND last_us >= {FROM_US} GROUP BY ALL"),
    "usage_sessions": (
        lambda s, d: rollup.usage_sessions(usage_events(s, d)),
        f"WITH {USAGE} SELECT integration_name, coalesce(nullif(session_id, ''), nullif(source_path, ''), 'unknown') AS session, us // 86400000000 AS day, {MEASURES}, min(us) AS start_us, max(us) AS end_us FROM ue GROUP BY 1, 2, 3",
    ),
    "usage_hierarchy": (
        lambda s, d: rollup.usage_hierarchy(usage_events(s, d)),
        f"WITH {USAGE} SELECT integration_name, provider, account_name, model, CAST(grouping_id(integration_name, provider, account_name, model) AS BIGINT) AS level, {MEASURES} FROM ue GROUP BY ROLLUP (integration_name, provider, account_name, model)",
    ),
    "usage_cumulative": (
        lambda s, d: rollup.usage_cumulative(rollup.usage_buckets(usage_events(s, d), _SIZE)),
        f"""WITH {USAGE}, b AS (SELECT integration_name, us - us % {_B} AS bucket_us, {MEASURES} FROM ue GROUP BY 1, 2)
        SELECT integration_name, bucket_us, CAST(sum(cost_cents) OVER w AS BIGINT) AS cum_cost_cents, CAST(sum(output_tokens) OVER w AS BIGINT) AS cum_output_tokens FROM b
        WINDOW w AS (PARTITION BY integration_name ORDER BY bucket_us ROWS UNBOUNDED PRECEDING)""",
    ),
    "usage_cumulative_totals": (
        lambda s, d: rollup.usage_cumulative(rollup.usage_buckets(usage_events(s, d), _SIZE), rollup.usage_totals(_united(s, d), FROM_US, TO_US).where("integration_name != 'error'")),
        f"""WITH {UNITED}, b AS (SELECT integration_name, us - us % {_B} AS bucket_us, {MEASURES} FROM ue GROUP BY 1, 2),
        t AS (SELECT integration_name, {REMEASURES} FROM united WHERE first_us < {TO_US} AND last_us >= {FROM_US} AND integration_name <> 'error' GROUP BY 1),
        r AS (SELECT integration_name, bucket_us, CAST(sum(cost_cents) OVER w AS BIGINT) AS c, CAST(sum(output_tokens) OVER w AS BIGINT) AS o, bucket_us = max(bucket_us) OVER (PARTITION BY integration_name) AS last FROM b WINDOW w AS (PARTITION BY integration_name ORDER BY bucket_us ROWS UNBOUNDED PRECEDING))
        SELECT r.integration_name, bucket_us, CASE WHEN last AND t.cost_cents IS NOT NULL THEN t.cost_cents ELSE c END AS cum_cost_cents, CASE WHEN last AND t.output_tokens IS NOT NULL THEN t.output_tokens ELSE o END AS cum_output_tokens FROM r LEFT JOIN t ON r.integration_name = t.integration_name""",
    ),
    "archive_reconciled": (
        lambda s, d: rollup.reconciled(usage_events(s, d), rollup.compact_hourly(usage_events(s, d).where("event_id % 5 != 0 OR integration_name != 'click'"))),
        f"WITH {USAGE} SELECT integration_name, count(*) AS events, count(*) FILTER (event_id % 5 <> 0 OR integration_name <> 'click') AS archived, integration_name <> 'click' AS adds_up FROM ue GROUP BY 1",
    ),
    "token_cost": (
        lambda s, d: pricing.token_cost(pricing.price_asof(usage_events(s, d), prices(s))).select("event_id", "price_model", "cost"),
        pricing.sql(f"WITH {USAGE}, {PRICES_SQL}", "SELECT event_id, price_model, cost FROM costed"),
    ),
    "price_asof": (
        lambda s, d: pricing.price_asof(usage_events(s, d), prices(s)).select("event_id", "model", "price_model", "from_us", "input_cost"),
        pricing.sql(f"WITH {USAGE}, {PRICES_SQL}", "SELECT event_id, model, price_model, from_us, input_cost FROM priced"),
    ),
    "credits": (lambda s, d: pricing.credits(usage_events(s, d)).select("event_id", "credits"), f"WITH {USAGE} SELECT event_id, {pricing.CREDITS_SQL} AS credits FROM ue LEFT JOIN {pricing.CREDIT_RATES_SQL} ON r.model = ue.model"),
}
