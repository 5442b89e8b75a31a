"""Documents, merged accounts, imports, retention, poll health, and streams that are drained over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.operators import accounts, poll_health, records, retention, rollup, transfer
from quotalens.operators import documents as doc
from quotalens.session import work_dir
from quotalens.sources.projection import SAMPLES, USAGE, usage_events
from quotalens.sources.tail import tail_lines
from quotalens.streaming import keyed

from .insights import DAY, HOUR, NOW_US, K, _arrivals, _q
from .insights import QUERIES as _OTHERS
from .quotas import ORD
from .usage import MEASURES

MINUTE = 60_000_000
INTERVAL_US, GRACE_US = 8 * HOUR, 5 * MINUTE
TIMEOUT_US, FORGET_US = 12 * HOUR, 3 * DAY
SESSION_GROUPS = 2048


def _folder(s: SparkSession, name: str) -> str:
    return f"{work_dir(s)}/quotalens-{name}-{uuid.uuid4().hex}"


# Documents: nested objects of numbers, a list and a text that a patch changes, removes and adds to. A row takes some 200 µs and a scan has
# no more busy tasks than its files have row groups, so the ids are dealt to all cores first.
def _json_changes(s, d):
    n = F.col("event_id").cast("string")
    old = F.concat(F.lit('{"id":'), n, F.lit(',"in":{"keep":1.5,"k":{"x":'), (F.col("event_id") % 7).cast("string"), F.lit(',"y":true},"l":[1,{"z":null}]},"t":"5"}'))
    patch = F.concat(
        F.lit('{"in":{"k":{"x":'), F.when(F.col("event_id") % 3 == 0, "null").otherwise((F.col("event_id") % 5).cast("string")), F.lit(',"n":{"a":'), n, F.lit("}}"),
        F.when(F.col("event_id") % 4 == 0, ',"l":null').otherwise(""), F.lit("},"), F.when(F.col("event_id") % 5 == 0, '"t":null,').otherwise(""), F.lit('"z":[]}'),
    )
    e = usage_events(s, d).select("event_id").repartition(4 * s.sparkContext.defaultParallelism, "event_id").select("event_id", old.alias("old"), patch.alias("patch"))
    return e.select("event_id", doc.patched(F.col("old"), F.col("patch")).alias("patched"), doc.without_keys(F.col("old"), "in.k.x", "t").alias("removed"), doc.with_key(F.col("old"), "in.k.y", F.col("event_id")).alias("set_"))


_JSON_SQL = f"""WITH {USAGE}, v AS (SELECT event_id, CAST(event_id AS VARCHAR) AS n, CAST(event_id % 7 AS VARCHAR) AS x, CAST(event_id % 5 AS VARCHAR) AS p FROM ue)
    SELECT event_id,
    '{{"id":' || n || ',"in":{{"k":{{"n":{{"a":' || n || '}}' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"x":' || p END || ',"y":true}},"keep":1.5' || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"l":[1,{{"z":null}}]' END || '}}' || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"t":"5"' END || ',"z":[]}}' AS patched,
    '{{"id":' || n || ',"in":{{"k":{{"y":true}},"keep":1.5,"l":[1,{{"z":null}}]}}}}' AS removed,
    '{{"id":' || n || ',"in":{{"k":{{"x":' || x || ',"y":' || n || '}},"keep":1.5,"l":[1,{{"z":null}}]}},"t":"5"}}' AS set_ FROM v"""


# Every 97th event merges its account into another: chains, accounts that come back, and cycles.
def _merged(s, d):
    e = usage_events(s, d)
    merges = e.where("event_id % 97 = 0").select(F.col("account_name").alias("source"), F.concat(F.lit("acct-"), F.expr("event_id DIV 97 % 10").cast("string")).alias("target"), "us")
    return accounts.resolved(e.select("event_id", "account_name", "us"), merges, "account_name")


_MERGED_SQL = f"""WITH RECURSIVE {USAGE}, m AS (SELECT source, us, min(target) AS target FROM (SELECT account_name AS source, 'acct-' || CAST(event_id // 97 % 10 AS VARCHAR) AS target, us FROM ue WHERE event_id % 97 = 0) WHERE source <> target GROUP BY 1, 2),
    n AS MATERIALIZED (SELECT a.source, a.us, a.target, min(b.us) AS next_us FROM m a LEFT JOIN m b ON b.source = a.target AND b.us > a.us GROUP BY ALL),
    e AS (SELECT source, us, target, next_us FROM n UNION ALL SELECT e.source, e.us, n.target, n.next_us FROM e JOIN n ON n.source = e.target AND n.us = e.next_us),
    x AS (SELECT source, us, target FROM e WHERE next_us IS NULL)
    SELECT ue.event_id, ue.account_name, ue.us, coalesce(x.target, ue.account_name) AS resolved FROM ue ASOF LEFT JOIN x ON ue.account_name = x.source AND ue.us <= x.us"""


# Another store's customers and orders, under its own ids, beside a store that has some of both.
_GRAPH = [transfer.Table("orders", "id", ("customer", "at", "price"), {"customer": "customers"}), transfer.Table("customers", "id", ("name",))]


def _imported(s, d):
    c, o = s.read.parquet(f"{d}/customer.parquet"), s.read.parquet(f"{d}/orders.parquet")
    customers, orders = c.selectExpr("c_custkey AS id", "c_name AS name"), o.selectExpr("o_orderkey AS id", "o_custkey AS customer", "o_orderdate AS at", "o_totalprice AS price")
    here = {"customers": customers.where("id % 3 != 0"), "orders": orders.where("customer % 3 != 0 AND id % 2 = 0")}
    there = {"customers": customers.withColumn("id", F.expr("id * 2 + 7")), "orders": orders.selectExpr("id * 2 + 1 AS id", "customer * 2 + 7 AS customer", "at", "price")}
    added, origins = transfer.imported(here, there, _GRAPH, "other", s.createDataFrame([], transfer.PROVENANCE))
    return origins.select("table_name", "old_id", "new_id")


_IMPORTED_SQL = """WITH ec AS (SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey % 3 <> 0), ic AS (SELECT c_custkey * 2 + 7 AS old_id, c_name, e.id AS there FROM customer LEFT JOIN ec e USING (c_name)),
    nc AS (SELECT old_id, row_number() OVER (ORDER BY old_id) + (SELECT coalesce(max(id), 0) FROM ec) AS new_id FROM ic WHERE there IS NULL), cm AS (SELECT ic.old_id, coalesce(there, new_id) AS new_id FROM ic LEFT JOIN nc USING (old_id)),
    eo AS (SELECT o_custkey AS customer, o_orderdate, o_totalprice, min(o_orderkey) AS there, max(o_orderkey) AS top FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 2 = 0 GROUP BY 1, 2, 3),
    io AS (SELECT o_orderkey * 2 + 1 AS old_id, cm.new_id AS customer, o_orderdate, o_totalprice FROM orders JOIN cm ON cm.old_id = o_custkey * 2 + 7),
    fo AS (SELECT io.old_id, eo.there, min(io.old_id) OVER (PARTITION BY io.customer, io.o_orderdate, io.o_totalprice) AS first_id FROM io LEFT JOIN eo ON eo.customer = io.customer AND eo.o_orderdate = io.o_orderdate AND eo.o_totalprice = io.o_totalprice),
    no AS (SELECT old_id, row_number() OVER (ORDER BY old_id) + (SELECT coalesce(max(top), 0) FROM eo) AS new_id FROM fo WHERE there IS NULL AND old_id = first_id)
    SELECT 'customers' AS table_name, old_id, new_id FROM cm UNION ALL SELECT 'orders', fo.old_id, coalesce(there, new_id) FROM fo LEFT JOIN no ON no.old_id = fo.first_id"""


# A retention job that is stopped after two of its steps while more events arrive; what readers see is all events, once.
def _retained(s, d):
    names = [*rollup.DIMENSIONS, *rollup.TOKENS, "cost_cents"]
    e = usage_events(s, d).select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("fingerprint"), "event_id", "us", *names)
    store = retention.Store(s, _folder(s, "retention"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema))
    store.add_events(e.where("event_id % 3 != 0"))
    store.compact(NOW_US, "first", until="archive")
    store.add_events(e.where("event_id % 3 = 0"))
    store.compact(NOW_US, "second")
    return store.usage().groupBy((F.col("first_us") - F.pmod("first_us", F.lit(HOUR))).alias("hour_us"), "integration_name").agg(*rollup.remeasures())


def _polls(s, d):
    n = F.col("snapshot_id") % 5
    return _q(s, d).select("provider", "account_id", "snapshot_id", "us", F.when(n < 2, "failure").when(n == 2, "skipped").otherwise("success").alias("outcome"))


_RUNS = f"""po AS (SELECT provider, account_id, snapshot_id, us, CASE WHEN snapshot_id % 5 < 2 THEN 'failure' WHEN snapshot_id % 5 = 2 THEN 'skipped' ELSE 'success' END AS outcome, 0 AS fin FROM qs WHERE us <= {NOW_US}
        UNION ALL SELECT provider, account_id, NULL, {NOW_US}, 'now', 1 FROM qs WHERE us <= {NOW_US} GROUP BY 1, 2),
    pd AS (SELECT *, lag(us) OVER w + {INTERVAL_US + GRACE_US} AS dl, coalesce(sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY provider, account_id ORDER BY us, fin, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM po WINDOW w AS (PARTITION BY provider, account_id ORDER BY us, fin, snapshot_id)),
    pm AS (SELECT *, CASE WHEN dl IS NULL OR us < dl OR (us = dl AND fin = 0) THEN 0 ELSE 1 + (us - dl - (1 - fin)) // {INTERVAL_US} END AS missed FROM pd),
    pr AS (SELECT provider, account_id, CAST(run AS BIGINT) AS run, count(*) FILTER (outcome = 'failure') AS failed, CAST(sum(missed) AS BIGINT) AS missed, min(least(CASE WHEN missed > 0 THEN dl END, CASE WHEN outcome = 'failure' THEN us END)) AS first_us,
        max(greatest(CASE WHEN missed > 0 THEN dl + (missed - 1) * {INTERVAL_US} END, CASE WHEN outcome = 'failure' THEN us END)) AS last_us, max(CASE WHEN outcome = 'failure' THEN us END) AS f_us, max(CASE WHEN outcome = 'success' THEN us END) AS ended_us FROM pm GROUP BY ALL),
    ru AS (SELECT provider, account_id, run, failed, missed, first_us, last_us, ended_us, CASE WHEN f_us = last_us THEN 'failing' ELSE 'stalled' END AS state, CASE WHEN failed + missed >= 3 THEN 'error' ELSE 'warning' END AS severity FROM pr WHERE failed + missed > 0)"""


def _messages(s, d):
    told = _q(s, d).where("snapshot_id % 3 = 0").select("provider", "account_id", (F.col("us") + 10 * MINUTE).alias("us"), (F.col("snapshot_id") % 2 == 0).alias("sent"))
    return poll_health.poll_messages(_polls(s, d), told, NOW_US, INTERVAL_US, GRACE_US)


# Times as texts with zones, fractions of any length, and some that are no times.
def _times(s, d):
    e = usage_events(s, d)
    n = F.col("event_id")
    zone = (n % 5 - 2) * 90  # minutes
    at = F.date_format(F.timestamp_micros(F.expr("us DIV 7200000000 * 7200000000") + zone * 60_000_000), "yyyy-MM-dd'T'HH:mm:ss")
    sign = F.when(zone < 0, "-").otherwise("+")
    of = F.concat(sign, F.lpad(F.floor(F.abs(zone) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(zone) % 60).cast("string"), 2, "0"))
    nanos = F.lpad((n * 7919 % 1_000_000_000).cast("string"), 9, "0")
    text = F.when(n % 50 == 0, F.concat(F.lit("day "), n.cast("string"))).otherwise(F.concat(at, F.lit("."), F.when(n % 3 == 0, F.substring(nanos, 1, 6)).otherwise(nanos), F.when((zone == 0) & (n % 2 == 0), "Z").otherwise(of)))
    t = e.select("event_id", text.alias("text")).withColumn("key", records.time_order(F.col("text")))
    return t.select("event_id", "text", F.col("key.no_time").alias("no_time"), F.col("key.s").alias("s"), F.col("key.ns").cast("bigint").alias("ns"))


_TIMES_SQL = f"""WITH {USAGE}, t AS (SELECT event_id, provider, us // 7200000000 * 7200 AS s, CASE WHEN event_id % 3 = 0 THEN event_id * 7919 % 1000000000 // 1000 * 1000 ELSE event_id * 7919 % 1000000000 END AS ns, (event_id % 5 - 2) * 90 AS z, lpad(CAST(event_id * 7919 % 1000000000 AS VARCHAR), 9, '0') AS d FROM ue),
    x AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 'day ' || CAST(event_id AS VARCHAR) ELSE strftime(make_timestamp((s + z * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.' || CASE WHEN event_id % 3 = 0 THEN substr(d, 1, 6) ELSE d END
        || CASE WHEN z = 0 AND event_id % 2 = 0 THEN 'Z' ELSE CASE WHEN z < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(z) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(z) % 60 AS VARCHAR), 2, '0') END END AS txt FROM t)
    SELECT event_id, txt AS "text", event_id % 50 = 0 AS no_time, CASE WHEN event_id % 50 = 0 THEN 0 ELSE s END AS s, CASE WHEN event_id % 50 = 0 THEN 0 ELSE ns END AS ns FROM x"""


def _tree(s, d):
    t = rollup.usage_tree(usage_events(s, d))
    return t.select("integration_name", "request_count", "output_tokens", "cost_cents", "unpriced", "last_us", F.to_json("providers").alias("providers"))


_SUMS = "CAST(sum(request_count) AS BIGINT) AS request_count, " + ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in rollup.TOKENS) + ", CAST(sum(cost_cents) AS BIGINT) AS cost_cents, CAST(sum(unpriced) AS BIGINT) AS unpriced, max(last_us) AS last_us"
_FIELDS = ", ".join(f"{c} := {c}" for c in ["request_count", *rollup.TOKENS, "cost_cents", "unpriced", "last_us"])
_TREE_SQL = f"""WITH {USAGE}, l4 AS (SELECT integration_name, provider, account_name, model, {MEASURES}, max(us) AS last_us FROM ue GROUP BY ALL),
    l3 AS (SELECT integration_name, provider, account_name, {_SUMS}, list(struct_pack(model := model, {_FIELDS}) ORDER BY model) AS models FROM l4 GROUP BY 1, 2, 3),
    l2 AS (SELECT integration_name, provider, {_SUMS}, list(struct_pack(account_name := account_name, {_FIELDS}, models := models) ORDER BY account_name) AS accounts FROM l3 GROUP BY 1, 2),
    l1 AS (SELECT integration_name, {_SUMS}, list(struct_pack(provider := provider, {_FIELDS}, accounts := accounts) ORDER BY provider) AS providers FROM l2 GROUP BY 1)
    SELECT integration_name, request_count, output_tokens, cost_cents, unpriced, last_us, CAST(to_json(providers) AS VARCHAR) AS providers FROM l1"""


def _drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """What a stream gives until its input is used up."""
    s = stream.sparkSession
    out = f"{folder}/out"
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


def _in_batches(made: Callable[[DataFrame], DataFrame], rows: DataFrame, folder: str, mode: str, parts: int = 3) -> DataFrame:
    """What a stream made of the rows gives in ``parts`` batches, one range of times each. A range is written by all tasks, as files of
    the stream's folder; then the stream goes on from its checkpoint and takes them as one batch."""
    s = rows.sparkSession
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    if low is None:
        low = high = 0
    part = F.expr(f"(us - {low}) * {parts} DIV {high - low + 1}")
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(f"{folder}/in")
        found = _drained(made(s.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder, mode)
    return found


def _stream_sessions(s, d):
    keyed.prepare_state(s)
    samples = _q(s, d).select(*K.split(", "), "snapshot_id", "us", "used_bp")
    return _in_batches(lambda rows: keyed.closing_sessions(rows, TIMEOUT_US, FORGET_US, groups=SESSION_GROUPS), samples, _folder(s, "sessions"), "append").drop("session")


_STREAM_SQL = f"""WITH {SAMPLES}, ch AS (SELECT *, coalesce(used_bp <> lag(used_bp) OVER w AND us - lag(us) OVER w <= {FORGET_US}, false) AS changed, lag(used_bp) OVER w AS before FROM qs WINDOW w AS (PARTITION BY {K} {ORD})),
    la AS (SELECT *, max(CASE WHEN changed THEN us END) OVER (PARTITION BY {K} {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_us FROM ch),
    op AS (SELECT *, changed AND (last_us IS NULL OR us - last_us > {TIMEOUT_US}) AS opens FROM la), se AS (SELECT *, sum(CAST(opens AS BIGINT)) OVER (PARTITION BY {K} {ORD}) AS session FROM op),
    gr AS (SELECT {K}, session, min(us) AS start_us, max(CASE WHEN changed THEN us END) + {TIMEOUT_US} AS end_us, max(CASE WHEN opens THEN before END) AS start_bp, max(CASE WHEN changed THEN used_bp END) AS max_bp, count(*) AS samples FROM se WHERE session > 0 AND (changed OR us - last_us <= {TIMEOUT_US}) GROUP BY ALL)
    SELECT * EXCLUDE (session) FROM gr g WHERE end_us // 1000 + 1 <= (SELECT max(us) // 1000 - 300000 FROM qs) OR EXISTS (SELECT 1 FROM qs n WHERE n.provider = g.provider AND n.account_id IS NOT DISTINCT FROM g.account_id AND n.quota_name = g.quota_name AND n.us > g.end_us)"""


def _stream_receipts(s, d):
    keyed.prepare_state(s)
    return _in_batches(keyed.receipt_stream, _arrivals(s, d), _folder(s, "receipts"), "update").drop("payload")


# Usage as JSON lines in four folders of files, followed by byte offsets.
def _tailed(s, d):
    folder = _folder(s, "tail")
    lines = usage_events(s, d).select(F.to_json(F.struct("event_id", "provider", "output_tokens")).alias("value"), F.expr("event_id % 4").alias("file"))
    lines.repartition("file").write.option("fileExtension", "jsonl").partitionBy("file").text(f"{folder}/logs")
    found = _drained(tail_lines(s, f"{folder}/logs", "part-"), folder, "append")
    e = found.select(F.from_json("value", "event_id long, provider string, output_tokens long").alias("e")).select("e.*")
    return e.groupBy("provider").agg(F.count("*").alias("lines"), F.countDistinct("event_id").alias("events"), F.sum("output_tokens").alias("output_tokens"))


QUERIES = {
    "json_changes": (_json_changes, _JSON_SQL),
    "merged_accounts": (_merged, _MERGED_SQL),
    "imported_keys": (_imported, _IMPORTED_SQL),
    "retained_usage": (_retained, f"WITH {USAGE} SELECT us - us % {HOUR} AS hour_us, integration_name, {MEASURES} FROM ue GROUP BY 1, 2"),
    "poll_runs": (lambda s, d: poll_health.poll_runs(_polls(s, d), NOW_US, INTERVAL_US, GRACE_US), f"WITH {SAMPLES}, {_RUNS} SELECT * FROM ru"),
    "poll_health": (
        lambda s, d: poll_health.poll_health(_polls(s, d), NOW_US, INTERVAL_US, GRACE_US),
        f"""WITH {SAMPLES}, {_RUNS}, se AS (SELECT provider, account_id, max(us) AS polled_us, max(CASE WHEN outcome = 'success' THEN us END) AS success_us FROM po WHERE fin = 0 GROUP BY ALL)
        SELECT se.*, coalesce(state, 'healthy') AS state, coalesce(failed + missed, 0) AS failures, first_us, last_us, severity FROM se LEFT JOIN ru ON ru.provider = se.provider AND ru.account_id IS NOT DISTINCT FROM se.account_id AND ended_us IS NULL""",
    ),
    "poll_messages": (_messages, None),
    "poll_backoff": (
        lambda s, d: poll_health.backoff(_polls(s, d).withColumn("retry_after_us", F.when(F.col("snapshot_id") % 10 == 0, F.col("snapshot_id") % 3 * HOUR)), 2 * HOUR, 24 * HOUR),
        f"""WITH {SAMPLES}, po AS (SELECT provider, account_id, snapshot_id, us, CASE WHEN snapshot_id % 5 < 2 THEN 'failure' WHEN snapshot_id % 5 = 2 THEN 'skipped' ELSE 'success' END AS outcome, CASE WHEN snapshot_id % 10 = 0 THEN snapshot_id % 3 * {HOUR} END AS asked FROM qs),
        ru AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER w AS run, lead(us) OVER w AS nxt FROM po WINDOW w AS (PARTITION BY provider, account_id {ORD})),
        fa AS (SELECT *, row_number() OVER (PARTITION BY provider, account_id, run {ORD}) AS failures FROM ru WHERE outcome = 'failure'),
        re AS (SELECT *, CASE WHEN asked > 0 THEN asked ELSE least({24 * HOUR}, {2 * HOUR} * CAST(pow(2, least(failures - 1, 10)) AS BIGINT)) END AS rest_us FROM fa)
        SELECT provider, account_id, snapshot_id, us, failures, rest_us, us + rest_us AS resume_us, coalesce(nxt < us + rest_us, false) AS early FROM re""",
    ),
    "time_order": (_times, _TIMES_SQL),
    "usage_tree": (_tree, _TREE_SQL),
    "stream_sessions": (_stream_sessions, _STREAM_SQL),
    "stream_receipts": (_stream_receipts, _OTHERS["receipts_status"][1]),
    "tailed_lines": (_tailed, f"WITH {USAGE} SELECT provider, count(*) AS lines, count(DISTINCT event_id) AS events, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM ue GROUP BY 1"),
}
