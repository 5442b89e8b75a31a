"""Helpers that the corpus operators share: written tables in the shared folder, row ids, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotalens.session import ship_code

#: Rows of an Arrow batch; texts average some KB, and a Python worker holds a batch in several forms at once.
ARROW_ROWS = 2000
#: Compressed bytes of a bucket.
BUCKET_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a local one only where it is unset and Spark runs on one
    host (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quotalens-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Cuts lineage, so nothing upstream runs twice and rows do not change if an executor is lost.
    """
    path = f"{shared_dir(df.sparkSession)}/quotalens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, from its scan's blocks; no column is read. 0 if it reads no files."""
    blocks = df.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.input_file_block_length().alias("bytes")).distinct()
    return max(0, blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])


def keep_bucketed(df: DataFrame, name: str, column: str, size: int = 0) -> DataFrame:
    """As ``keep``, dealt into buckets by ``column``: a join on it moves the other side alone, however often it is done.

    There are as many buckets as the session has shuffle partitions, or as ``size`` bytes fill at BUCKET_BYTES each (Spark's limit is
    100 000), as a bucket is read by one task. The table leaves the session's catalog at once; its files lie in the shared folder.
    """
    spark, tag = df.sparkSession, uuid.uuid4().hex
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    made = f"quotalens_{name.replace('-', '_')}_{tag}"
    writer = df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).option("compression", "zstd")
    writer.option("path", f"{shared_dir(spark)}/quotalens-{name}-{tag}").saveAsTable(made)
    kept = spark.table(made)
    kept.schema  # resolved: the files are all it needs from here on
    spark.sql(f"DROP TABLE {made}")
    return kept


def with_position(df: DataFrame, name: str) -> DataFrame:
    """Adds the place in the input (split number in the high bits, row in the low 33) as long column ``name``."""
    return df.withColumn(name, F.monotonically_increasing_id())


def split_of(position: str) -> Column:
    return F.shiftright(position, 33)


def prefix_by_split(totals: DataFrame, split: str, values: list[str], block: int = 1024) -> DataFrame:
    """Exclusive prefix sums ``before_<v>`` of a table with one row per split, in the order of ``split``.

    Two levels: sums inside blocks of ``block`` splits, then over the blocks, so that no task sees more than
    ``max(block, splits / block)`` rows.
    """
    t = totals.withColumn("_block", F.floor(F.col(split) / block).cast("long"))
    inside = Window.partitionBy("_block").orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    blocks = blocks.select("_block", *[F.coalesce(F.sum(f"_{v}").over(over), F.lit(0)).alias(f"_before_{v}") for v in values])
    t = t.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    t = t.join(blocks, "_block")
    return t.select(split, *[(F.col(f"_in_{v}") + F.col(f"_before_{v}")).cast("long").alias(f"before_{v}") for v in values])


def apart(df: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with every column but ``own`` under a name that no operator uses, and what gives the old names (and only these
    columns) back; so an input may have columns of any name."""
    names = df.columns
    inner = [n if n in own else f"x{k}" for k, n in enumerate(names)]
    return df.toDF(*inner), lambda made: made.select(*[F.col(i).alias(n) for i, n in zip(inner, names)])


def fold_mod5(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5
