"""Structured Streaming: usage lines to hourly sums, and reset cycles with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quotalens.operators.cycles import Cycle, Rule
from quotalens.operators.ingest import event_fingerprint, parse_lines
from quotalens.operators.samples import KEY

LATE = "5 minutes"


def read_lines(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Closed JSON-lines files as they arrive; the checkpoint remembers which were read."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(path).select("value", F.col("_metadata.file_path").alias("source_path"))


def valid_events(lines: DataFrame) -> DataFrame:
    """Valid events with their fingerprint (F9, by file, time, names, counts and request); each once within the watermark."""
    path = F.col("source_path") if "source_path" in lines.columns else F.lit("")
    e = parse_lines(lines).where("error IS NULL").withColumn("ts", F.timestamp_micros("us"))
    e = e.withColumn("fingerprint", event_fingerprint(path, F.col("us"), F.col("metadata")))
    return e.select("ts", "us", "fingerprint", "integration", "provider", "model", "account", "request_id", "input_tokens", "output_tokens").withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["fingerprint"])


def hourly(events: DataFrame) -> DataFrame:
    """A7 on a stream: tumbling hours per integration and model, closed once the watermark has passed them."""
    return events.groupBy(F.window("ts", "1 hour"), "integration", "model").agg(F.count("*").alias("request_count"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


STATE = "seen_us long, seen_id long, start_us long, reset_us long, peak long, delta long, last long, last_reset long, pending_reset long, pending_used long"
_MADE = "provider string, _account string, quota_name string, start_us long, end_us long, reset_us long, peak_bp long, delta_bp long"
CLOSED = "provider string, account_id long, quota_name string, start_us long, end_us long, reset_us long, peak_bp long, delta_bp long"


def closed_cycles(samples: DataFrame, rule: Rule) -> DataFrame:
    """T1-T7 on a stream of samples: the open cycle of a key is its state; closed cycles are the output.

    Samples of one micro-batch are taken in order of time and id; one at or before the last that the state has seen is
    dropped, as its cycle may be closed. A null account is keyed like any other; ids above 2^53 stay whole, as keys are
    strings on the way (pandas would turn a nullable one into a float).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["us", "snapshot_id"])
        cycle, made, seen = None, [], (-1, -1)
        if state.exists:
            s = [None if v is None or v == -1 else v for v in state.get]
            seen = tuple(state.get[:2])
            cycle = Cycle(rule, s[2], s[6], s[3])
            cycle.peak, cycle.delta, cycle.last_reset = s[4], s[5], s[7]
            cycle.pending = None if s[8] is None else (s[8], s[9])
        for us, snapshot, used, reset in zip(rows["us"].tolist(), rows["snapshot_id"].tolist(), rows["used_bp"].tolist(), rows["_reset"].tolist()):
            reset = None if reset == -1 else reset
            if (us, snapshot) <= seen:
                continue
            seen = (us, snapshot)
            if cycle is None:
                cycle = Cycle(rule, us, used, reset)
            elif closed := cycle.take(us, used, reset):
                made.append((*key, *closed))
        pending = cycle.pending or (None, None)
        values = (*seen, cycle.start, cycle.reset, cycle.peak, cycle.delta, cycle.last, cycle.last_reset, *pending)
        state.update(tuple(-1 if v is None else int(v) for v in values))
        names = [c.split()[0] for c in _MADE.split(", ")]
        yield pd.DataFrame({n: pd.array([m[k] for m in made], dtype="Int64" if k > 2 else "object") for k, n in enumerate(names)})

    keyed = samples.select("provider", F.coalesce(F.col("account_id").cast("string"), F.lit("")).alias("_account"), "quota_name", "us", "snapshot_id", "used_bp", F.coalesce("reset_us", F.lit(-1)).alias("_reset"))
    closed = keyed.groupBy("provider", "_account", "quota_name").applyInPandasWithState(step, _MADE, STATE, "append", GroupStateTimeout.NoTimeout)
    return closed.withColumn("account_id", F.nullif(F.col("_account"), F.lit("")).cast("bigint")).select(*[c.split()[0] for c in CLOSED.split(", ")])


def write_hourly(sums: DataFrame, path: str, checkpoint: str):
    """M3: hours that the watermark has closed, appended as Parquet; each hour is final, and the file sink's log and the
    checkpoint see to it that a batch that runs again adds nothing. Returns the query's writer, not yet started."""
    flat = sums.select(F.unix_micros("window.start").alias("hour_us"), "integration", "model", "request_count", "input_tokens", "output_tokens")
    return flat.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
