"""T17 as a job: old events become hourly sums, their fingerprints tombstones, and only then the events go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rollup import DIMENSIONS, HOUR_US, compact_hourly, measures, remeasures, with_archive

STEPS = ("tombstones", "archive", "commit", "drop")
_TOMBSTONES = "fingerprint string, us long, part_us long, batch string"
_COMMITS = "request_count long, part_us long, batch string"


@dataclass(frozen=True)
class Store:
    """Four Parquet tables below ``base``: events in folders of ``unit_us`` (whole hours); tombstones, archive and commits in folders of
    these and batches. The archive's rows are hours; with days for folders a year has 365, not 8 760."""

    spark: SparkSession
    base: str
    events_schema: str
    unit_us: int = 24 * HOUR_US

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.base}/{name}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        """Replaces the partitions that ``rows`` has and leaves all others."""
        rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.base}/{name}")

    def add_events(self, events: DataFrame) -> None:
        """Appends events (with ``fingerprint`` and ``us``) to their folders."""
        part = F.col("us") - F.pmod("us", F.lit(self.unit_us))
        events.withColumn("part_us", part).repartition("part_us").write.mode("append").partitionBy("part_us").parquet(f"{self.base}/events")

    def events(self) -> DataFrame:
        return self._read("events", f"{self.events_schema}, part_us long")

    def tombstones(self) -> DataFrame:
        return self._read("tombstones", _TOMBSTONES)

    def commits(self) -> DataFrame:
        return self._read("commits", _COMMITS)

    def archive(self) -> DataFrame:
        shape = compact_hourly(self.spark.createDataFrame([], self.events_schema)).schema
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape)
        return self._read("archive", f"{kinds}, part_us long, batch string")

    def usage(self) -> DataFrame:
        """What readers see at any moment, also between two steps of a job: sums of committed batches, and events that no committed
        batch holds, in the shape of the archive."""
        done = self.commits().select("part_us", "batch")
        gone = self.tombstones().join(done, ["part_us", "batch"], "left_semi").select("fingerprint")
        return with_archive(self.events().join(gone, "fingerprint", "left_anti"), self.archive().join(done, ["part_us", "batch"], "left_semi"))

    def compact(self, cutoff_us: int, batch: str, until: str = STEPS[-1]) -> list[tuple[int, str]]:
        """Compacts whole folders before ``cutoff_us`` and returns (folder, batch) of what does not add up, which stays.

        1. Events of these folders without a tombstone get one, under the name of this run's ``batch`` (a new one each run).
        2. Every batch that is not committed is summed from the events that are still there, and replaces its part of the archive.
        3. A batch is committed if its part of the archive adds up to its events, and each tombstone has its event.
        4. Events of committed batches go: what is left replaces a folder, or the folder goes whole.

        A step that is stopped halfway is done again by the next run: tombstones say which batch an event is in, a batch is only summed
        before it is committed, and events only go after. So nothing is lost or counted twice, whatever comes in between; events
        that arrive late for a folder that was compacted make a batch of their own. An event that comes again after it was
        compacted has its tombstone and is dropped by step 4. ``until`` stops after a step (for tests of just that).
        """
        old = self.events().where(F.col("part_us") + self.unit_us <= cutoff_us)
        fresh = old.join(self.tombstones().select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "us", "part_us").dropDuplicates(["fingerprint"])
        self._write(fresh.withColumn("batch", F.lit(batch)).select("fingerprint", "us", "part_us", "batch"), "tombstones", "part_us", "batch")
        if until == "tombstones":
            return []
        open_ = self.tombstones().join(self.commits().select("part_us", "batch"), ["part_us", "batch"], "left_anti")
        held = old.dropDuplicates(["fingerprint"]).join(open_.select("fingerprint", "batch"), "fingerprint")
        hour = (F.col("us") - F.pmod("us", F.lit(HOUR_US))).alias("hour_us")
        sums = held.groupBy("part_us", "batch", hour, *DIMENSIONS).agg(*measures(), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
        self._write(sums.select(*self.archive().columns), "archive", "part_us", "batch")
        if until == "archive":
            return []
        wrong = self._commit(held, open_)
        if until == "commit":
            return wrong
        self._drop(old)
        return wrong

    def _commit(self, held: DataFrame, open_: DataFrame) -> list[tuple[int, str]]:
        keys = ["part_us", "batch"]
        names = [c for c in self.archive().columns if c not in (*DIMENSIONS, *keys, "hour_us", "first_us", "last_us")]
        raw = held.groupBy(*keys).agg(*measures()).select(*keys, F.struct(*names).alias("raw"))
        kept = self.archive().join(open_.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(*remeasures()).select(*keys, F.struct(*names).alias("kept"))
        marked = open_.groupBy(*keys).agg(F.count("*").alias("tombstones"))
        both = marked.join(raw, keys, "left").join(kept, keys, "left")
        right = F.coalesce((F.col("raw") == F.col("kept")) & (F.col("raw.request_count") == F.col("tombstones")), F.lit(False))
        both = both.select(*keys, F.col("raw.request_count").alias("request_count"), right.alias("right")).persist()
        self._write(both.where("right").select("request_count", *keys), "commits", *keys)
        wrong = [(r["part_us"], r["batch"]) for r in both.where("NOT right").select(*keys).orderBy(*keys).collect()]  # folders of a few runs
        both.unpersist()
        return wrong

    def _drop(self, old: DataFrame) -> None:
        done = self.tombstones().join(self.commits().select("part_us", "batch"), ["part_us", "batch"], "left_semi").select("fingerprint")
        touched = old.join(done, "fingerprint", "left_semi").select("part_us").distinct()
        left = old.join(touched, "part_us", "left_semi").join(done, "fingerprint", "left_anti")
        # what is left is written aside first: a partition cannot be replaced while it is read
        aside = f"{self.base}/left"
        left.write.mode("overwrite").parquet(aside)
        left = self.spark.read.schema(left.schema).parquet(aside)
        empty = touched.join(left.select("part_us").distinct(), "part_us", "left_anti")
        parts = [r["part_us"] for r in empty.collect()]  # folders, not events
        self._write(left.select(*self.events().columns), "events", "part_us")
        conf = self.spark._jsc.hadoopConfiguration()
        for part in parts:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/events/part_us={part}")
            folder.getFileSystem(conf).delete(folder, True)
