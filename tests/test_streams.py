"""Streams: files that grow, sessions that time out, receipts across batches."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotalens.operators import boundaries, ingest
from quotalens.plans import stores
from quotalens.sources.tail import TailReader, tail_lines
from quotalens.streaming import keyed

MINUTE = 60_000_000


def drained(df, out, checkpoint, mode="append", fmt="parquet"):
    q = df.writeStream.outputMode(mode).format(fmt).option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return q


@pytest.fixture
def tail(spark, tmp_path):
    os.makedirs(tmp_path / "logs")

    def run():
        drained(tail_lines(spark, str(tmp_path / "logs")), tmp_path / "out", tmp_path / "cp")
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return tmp_path / "logs", run


def write(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def test_growing_file_gives_each_line_once(tail):
    """Appended to in the middle of a line, across restarts of the stream; then rotated, truncated and written anew."""
    logs, run = tail
    write(logs / "a.jsonl", '{"n":1}\n{"n":2}\n{"n"')
    write(logs / "skipped.txt", "no\n")
    write(logs / ".a.jsonl.crc", "no\nno\n")
    assert run() == ['{"n":1}', '{"n":2}']
    write(logs / "a.jsonl", ':3}\n{"n":4}')
    assert run() == ['{"n":1}', '{"n":2}', '{"n":3}']
    write(logs / "a.jsonl", '\n{"n":5}\n')
    os.rename(logs / "a.jsonl", logs / "a.jsonl.1")  # rotated with lines that were not yet read
    write(logs / "a.jsonl", '{"n":6}\n')
    assert run() == [f'{{"n":{k}}}' for k in range(1, 7)]
    write(logs / "a.jsonl.1", '{"n":7}\n')
    write(logs / "a.jsonl", '{"m":8}\n{"m":9}\n', "w")  # another file of that name
    assert run() == [*(f'{{"m":{k}}}' for k in (8, 9)), *(f'{{"n":{k}}}' for k in range(1, 8))]
    assert len(run()) == 9
    os.truncate(logs / "a.jsonl.1", len('{"n":1}\n'))  # shorter with the same first line: read anew
    assert run().count('{"n":1}') == 2


def test_ranges_of_a_file_share_no_line(tmp_path, monkeypatch):
    import quotalens.sources.tail as module

    lines = [f"line {k} " + "x" * (k * 7 % 90) + ("ü" if k % 3 else "") for k in range(300)]
    write(tmp_path / "b.jsonl", "".join(x + "\n" for x in lines) + "unfinished")
    reader = TailReader(str(tmp_path), ".jsonl")
    end = reader.latestOffset()
    for size in (64 << 20, 1000, 64, 7):
        monkeypatch.setattr(module, "RANGE", size)
        parts = reader.partitions({}, end)
        found = [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()]
        assert found == lines
    middle = {p: [h, len((lines[0] + "\n").encode())] for p, (h, _) in end.items()}
    assert [v for p in reader.partitions(middle, end) for b in reader.read(p) for v in b.column(0).to_pylist()] == lines[1:]


def test_blank_and_missing_folders(tmp_path):
    assert TailReader(str(tmp_path / "none"), ".jsonl").latestOffset() == {}
    write(tmp_path / "c.jsonl", "")
    write(tmp_path / "d.jsonl", "no end")
    assert TailReader(str(tmp_path), ".jsonl").latestOffset() == {}
    write(tmp_path / "d.jsonl", "\n\n")
    reader = TailReader(str(tmp_path), ".jsonl")
    assert [v for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p) for v in b.column(0).to_pylist()] == ["no end", ""]


def samples(seed, n):
    """Keys that rise, rest, fall silent for longer than the timeout, and come back after they were forgotten."""
    rng, rows, at, used = random.Random(seed), [], {}, {}
    clock = 0
    for k in range(n):
        clock += rng.choice([1, 2, 3]) * MINUTE
        key = rng.choice([("p", 1, "five"), ("p", None, "five"), ("q", 2**60, "week"), ("q", 7, "day")])
        if clock // (300 * MINUTE) % 2 and key[1] == 7:
            continue
        at[key] = clock
        used[key] = used.get(key, 0) + rng.choice([0, 0, 0, 5])
        rows.append((*key, k, clock, used[key]))
    return rows


SAMPLES = "provider string, account_id long, quota_name string, snapshot_id long, us long, used_bp long"


@pytest.mark.parametrize("files", [3, 11])
def test_sessions_on_a_stream_equal_those_of_the_batch(spark, tmp_path, files):
    keyed.prepare_state(spark)
    rows = samples(4, 900)
    timeout, forget = 10 * MINUTE, 120 * MINUTE
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], SAMPLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = rows[-1][4]
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drained(keyed.closing_sessions(stream, timeout, forget), tmp_path / "out", tmp_path / "cp")
    drop = lambda r: (r.provider, r.account_id, r.quota_name, r.start_us, r.end_us, r.start_bp, r.max_bp, r.samples)
    key = lambda r: tuple(map(str, r))
    got = sorted(map(drop, spark.read.parquet(str(tmp_path / "out")).collect()), key=key)
    batch = boundaries.idle_sessions(spark.createDataFrame(rows, SAMPLES), timeout, True, forget)
    done = last - 5 * MINUTE  # the watermark at the end
    want = sorted(map(drop, batch.collect()), key=key)
    assert len(got) > 40 and set(got) <= set(want)
    assert {r for r in want if r[4] < done - MINUTE} <= set(got) and len(got) == len(set(got))


def test_silent_keys_leave_no_state(spark, tmp_path):
    keyed.prepare_state(spark)
    rows = [("p", k, "five", k, MINUTE * (60 + k % 5), 10) for k in range(200)] + [("p", k, "five", 1000 + k, MINUTE * (66 + k % 3), 20) for k in range(200)]
    rows += [("q", 1, "five", 5000 + k, MINUTE * 60 * k, k) for k in range(2, 7)]
    for part in (rows[:400], rows[400:402], rows[402:404], rows[404:]):
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = drained(keyed.closing_sessions(stream, 10 * MINUTE, 30 * MINUTE), tmp_path / "out", tmp_path / "cp")
    kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(kept) >= 200 and kept[-1] <= 6, kept  # a key has a value and a timer
    assert spark.read.parquet(str(tmp_path / "out")).where("provider = 'p'").count() == 200


def test_keys_in_groups_share_a_state(spark, tmp_path):
    """Many keys in a few groups, some uses unknown: the sessions of the batch, and no more states than groups."""
    keyed.prepare_state(spark)
    rng = random.Random(6)
    rows = [("p", rng.choice([None, 2**60 + k % 90]), f"q{k % 3}", k, MINUTE * (60 + k // 20), rng.choice([1, 2, 2, None])) for k in range(1800)]
    whole = spark.createDataFrame(rows, SAMPLES)
    made = lambda stream: keyed.closing_sessions(stream, 10 * MINUTE, 20 * MINUTE, groups=5)
    got = [tuple(r) for r in stores._in_batches(made, whole, str(tmp_path), "append").drop("session").collect()]
    want = {tuple(r) for r in boundaries.idle_sessions(whole, 10 * MINUTE, True, 20 * MINUTE).drop("session").collect()}
    done = rows[-1][4] - 6 * MINUTE
    assert len(got) == len(set(got)) and set(got) <= want and {r for r in want if r[4] < done} <= set(got) and len(got) > 100
    state = spark.read.format("statestore").load(f"{tmp_path}/checkpoint")
    assert 0 < state.count() <= 5
    assert len([f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")]) > 3  # a batch is written by more than one task


ARRIVALS = "event_id long, device_id string, event_key string, us long, kind string, identity string, payload string, stored boolean, owner string"


def arrivals(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        payload = {"a": 1, **{x: rng.choice([None, 1, 1]) for x in "bcd" if rng.random() < 0.5}}
        text = rng.choice([json.dumps(payload), json.dumps(payload, sort_keys=True, indent=1), "no json"]) if rng.random() < 0.9 else None
        rows.append((k, rng.choice(["d1", "d2"]), f"evt_{rng.randrange(n // 8)}", k * 10, rng.choice(["usage_event"] * 4 + ["quota_snapshot"]), rng.choice(["i"] * 9 + ["j"]), text, rng.random() < 0.1, rng.choice(["d1", "d2"])))
    return rows


@pytest.mark.parametrize("files", [1, 4, 9])
def test_receipts_on_a_stream_equal_those_of_the_batch(spark, tmp_path, files):
    keyed.prepare_state(spark)
    rows = arrivals(2, 400)
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], ARRIVALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = keyed.receipt_stream(stream)
    q = made.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    key = lambda r: tuple(map(str, r))
    want = sorted(map(tuple, ingest.receipts(spark.createDataFrame(rows, ARRIVALS)).collect()), key=key)
    assert sorted((tuple(r)[:5] for r in got), key=key) == want
    statuses = {r.status for r in got}
    assert statuses == {"accepted", "duplicate", "enriched", "rejected"} and all((r.payload is None) or r.status in ("accepted", "enriched") for r in got)


def test_receipts_take_frames_and_keep_large_ids_and_nulls():
    """Arrivals of a key come as whole frames, not as single rows; ids beyond 2^53 and nulls stay as they are."""

    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    columns = ["us", "event_id", "kind", "identity", "payload", "stored", "owner"]
    rows = [("9", str(2**60 + 1), "usage_event", "i", None, None, "d"), ("10", None, "usage_event", "i", '{"a":1}', True, None), ("9", str(2**60), "usage_event", "i", '{"a":null}', False, "d")]
    p = keyed._Receipts(None)
    p.held = Held()
    frames = [pd.DataFrame(part, columns=columns) for part in (rows[:1], rows[1:])]
    [got] = [f.astype("object").to_dict("split")["data"] for f in p.handleInputRows(("d", "e"), iter(frames), None)]
    assert [(r[0], r[3], r[4]) for r in got] == [(str(2**60), "accepted", None), (str(2**60 + 1), "rejected", "event_payload_conflict"), (None, "enriched", None)]
    assert [r[5] for r in got] == ['{"a":null}', None, '{"a":1}'] and p.held.value == ("i", '{"a":1}')
