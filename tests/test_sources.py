"""Log formats and streams."""

import json

from pyspark.sql import functions as F

from quotalens.operators import cycles
from quotalens.sources import logs
from quotalens.streaming import usage


def lines(spark, rows, path="/logs/abc.jsonl"):
    made = [(r if isinstance(r, str) else json.dumps(r), path, k) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, "value string, source_path string, line_no long")


def test_claude(spark):
    got = logs.claude_lines(lines(spark, [
        {"type": "user", "message": {"role": "user"}},
        {"timestamp": "2024-01-02T03:04:05Z", "sessionId": "s", "message": {"id": "m1", "model": "claude-x", "usage": {"input_tokens": 10, "cache_read_input_tokens": 3, "output_tokens": 4, "speed": "fast"}}},
        {"ts": 1704164645, "model": "claude-y", "usage": {"input": "7", "total": 9, "service_tier": "standard"}, "costUSD": 0.5},
        "not json",
    ])).orderBy("model").collect()
    assert [(r["session_id"], r["request_id"], r["model"], r["input_tokens"], r["total_tokens"], r["speed_mode"], r["us"], r["cost_usd"]) for r in got] == [
        ("s", "m1", "claude-x", 10, 17, "fast", 1704164645_000000, None), ("abc", None, "claude-y", 7, 9, "standard", 1704164645_000000, 0.5)]


def test_codex_carries_settings_and_counts_a_usage_once(spark):
    count = lambda n: {"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "cached_input_tokens": 4, "output_tokens": 2}}}}
    got = logs.codex_lines(lines(spark, [
        count(1), {"type": "turn_context", "payload": {"model": "gpt-x", "effort": "high", "fast_mode": True}}, count(10), count(10), count(3),
        {"type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": {"service_tier": "default"}}}, {"type": "turn_context", "payload": {"model": "gpt-y"}}, count(10),
    ])).collect()
    assert sorted((r["model"], r["reasoning_effort"], r["speed_mode"], r["input_tokens"], r["total_tokens"]) for r in got) == [("gpt-x", "high", "fast", 0, 5), ("gpt-x", "high", "fast", 6, 12), ("gpt-y", "high", "standard", 6, 12)]


def test_gemini_and_antigravity(spark):
    got = logs.gemini_documents(lines(spark, [{"model": "gemini-x", "tokens": {"input": 10, "cached": 4, "output": 3, "thoughts": 2}}, {"index": 1}])).collect()
    assert [(r["input_tokens"], r["total_tokens"]) for r in got] == [(6, 15)]
    got = logs.antigravity_settings(lines(spark, [{"model": "M", "providerLock": "claude-lock", "tokenUsage": {"inputTokens": 5, "cacheReadTokens": 9, "outputTokens": 1}}, {}], "/x/a.settings.json")).collect()
    assert [(r["provider"], r["session_id"], r["input_tokens"], r["total_tokens"]) for r in got] == [("anthropic", "a", 0, 15)]


def test_cursor(spark, tmp_path):
    (tmp_path / "u.csv").write_text('Date,Model,"Input Tokens",Cached-Tokens,Output Tokens,Cost\n2024-01-01T00:00:00Z,m,"1,000",200,5,$1.25\n2024-01-01,,1,0,0,\n')
    got = logs.cursor_csv(spark, str(tmp_path / "u.csv")).collect()
    assert [(r["model"], r["input_tokens"], r["cached_input_tokens"], r["total_tokens"], r["cost_usd"]) for r in got] == [("m", 800, 200, 1005, 1.25)]
    pairs = [("composerData:c1", '{"modelConfig":{"modelName":"Big"}}'), ("bubbleId:c1:b1", '{"tokenCount":{"inputTokens":3,"outputTokens":4}}'), ("bubbleId:c2:b2", '{"tokenCount":{"inputTokens":1}}'), ("bubbleId:c1:b3", "{}"), ("other", None)]
    got = logs.cursor_state(spark.createDataFrame(pairs, "key string, value string")).collect()
    assert sorted((r["session_id"], r["model"], r["total_tokens"]) for r in got) == [("c1", "big", 7), ("c2", "cursor-unknown", 1)]


def line(hour, n, **more):
    return json.dumps({"ts": f"2024-01-01T0{hour}:00:01Z", "integration": "i", "provider": "openai", "model": "m", "input_tokens": n, "output_tokens": 1} | more)


def test_stream_of_lines_counts_each_event_once(spark, tmp_path):
    key = {"metadata": json.dumps({"event_key": "k"})}
    (tmp_path / "in").mkdir()
    # the same line twice in a file, the same event in two files, and one moment with two requests
    (tmp_path / "in/a.jsonl").write_text("\n".join([line(1, 5), line(1, 5), line(1, 6), "oops", line(2, 7, **key)]))
    (tmp_path / "in/b.jsonl").write_text("\n".join([line(2, 7, **key), line(2, 8, request_id="x"), line(2, 8, request_id="y"), line(9, 1)]))
    sums = usage.hourly(usage.valid_events(usage.read_lines(spark, str(tmp_path / "in"), 1)))
    for _ in range(2):  # started again, the stream adds nothing
        usage.write_hourly(sums, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("hour_us").collect()
    assert [(r["request_count"], r["input_tokens"]) for r in got] == [(2, 11), (3, 23)]


def test_fingerprints_tell_requests_accounts_and_files_apart(spark):
    rows = [line(1, 5), line(1, 5), line(1, 5, account="a"), line(1, 5, request_id="r"), line(1, 5, total_tokens=9)]
    e = usage.parse_lines(spark.createDataFrame([(r, f"p{k % 2}") for k, r in enumerate(rows)], "value string, source_path string"))
    got = e.withColumn("f", usage.event_fingerprint(F.col("source_path"), F.col("us"), F.col("metadata"))).collect()
    assert len({r["f"] for r in got}) == len(rows)
    claude = {"provider": "anthropic", "request_id": "r", "metadata": json.dumps({"source": "claude", "session_id": "s", "source_path": "x"})}
    e = usage.parse_lines(spark.createDataFrame([(line(1, 5, **claude), "p"), (line(2, 5, **claude), "q")], "value string, source_path string"))
    assert e.select(usage.event_fingerprint(F.col("source_path"), F.col("us"), F.col("metadata"))).distinct().count() == 1


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    rows = [json.dumps({"type": "turn_context", "payload": {"model": f"m{k}"}}) + " " * 200 for k in range(3000)]
    (tmp_path / "big.jsonl").write_text("\n".join(rows))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = logs.text_lines(spark, str(tmp_path / "big.jsonl"))
        assert read.rdd.getNumPartitions() > 1
        got = [r["value"] for r in read.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == rows


def test_late_stream_samples_change_nothing(spark, tmp_path):
    minute = 60_000_000
    schema = "provider string, account_id long, quota_name string, snapshot_id long, us long, used_bp long, reset_us long"
    big = 9_007_199_254_740_993
    batches = [
        [("p", a, "q", k, k * minute, 100 * k, 300 * minute) for k in (1, 2, 5) for a in (None, big)],
        [("p", a, "q", 3, 3 * minute, 9_000, 300 * minute) for a in (None, big)],
        [("p", a, "q", 6, 6 * minute, 50, 900 * minute) for a in (None, big)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = usage.closed_cycles(stream, cycles.RULES["anthropic"]).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(map(tuple, spark.table("late").select("account_id", "start_us", "end_us", "peak_bp", "delta_bp").collect()), key=str)
    assert got == sorted([(None, minute, 6 * minute, 500, 400), (big, minute, 6 * minute, 500, 400)], key=str)


def test_streamed_cycles_equal_those_of_the_batch(spark, tmp_path):
    minute = 60_000_000
    rows = [("p", a, "q", k * 2 + a, k * 30 * minute, (k * 977) % 10_000, None if k % 9 == 0 else 300 * minute * (1 + k // 10)) for k in range(60) for a in (0, 1)]
    schema = "provider string, account_id long, quota_name string, snapshot_id long, us long, used_bp long, reset_us long"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[3] // 40 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rule = cycles.RULES["codex"]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = usage.closed_cycles(stream, rule).writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    batch = cycles.detect_cycles(spark.createDataFrame(rows, schema), rule).where("end_us IS NOT NULL")
    assert sorted(map(tuple, spark.table("closed").collect())) == sorted(map(tuple, batch.collect()))


def test_a_settings_document_is_looked_up_once_for_each_key(spark):
    df = spark.createDataFrame([('{"tokenUsage":{"inputTokens":1}}', "/x/a.settings.json")], "value string, source_path string")
    plan = logs.antigravity_settings(df)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"$.{key})") for key in ("inputTokens", "cacheReadTokens", "outputTokens", "totalTokens")] == [1, 1, 1, 1]
