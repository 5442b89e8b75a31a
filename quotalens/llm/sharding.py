"""Contiguous shards of nearly equal bytes, from a global prefix sum (operator 4, native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, prefix_by_split, split_of, table, with_position

SHARDS = 40
OVERHEAD = 16


def balanced_shards(rows: DataFrame, n_shards: int = SHARDS, size: str = "size", splits: int | None = None) -> DataFrame:
    """Cuts ``rows`` in their own order into ``n_shards`` contiguous runs of nearly equal ``size``.

    The rows are written once with their place (input split, row in it). Every split gives one total; the totals'
    prefix sums place each split, a running sum inside a split places each row, and a row's middle byte decides its
    shard, so each cut lies within half a row of its target. No key deals rows out, so no key can be hot: a split
    is bounded by ``spark.sql.files.maxPartitionBytes`` whatever it holds.

    Adds shard int, slot long (gapless from 0 in each shard) and start long (bytes before the row). Sizes of null or
    below zero count as 0. Ties, repeated rows and null ids keep their input order; an empty table gives an empty one;
    other columns pass through, but ``shard``, ``slot`` and ``start`` of the input are replaced.
    """
    rows = rows.drop("shard", "slot", "start")
    placed = keep(with_position(rows.withColumn("_size", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")), "_at"), "shard-rows")
    placed = placed.withColumn("_split", split_of("_at"))
    totals = placed.groupBy("_split").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = prefix_by_split(totals, "_split", ["_bytes", "_rows"])
    total = placed.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    inside = Window.partitionBy("_split").orderBy("_at")
    # all three steps deal rows by _split, so one exchange serves the join and both windows
    placed = placed.join(before, "_split").select(
        "*",
        (F.col("before__bytes") + F.sum("_size").over(inside) - F.col("_size")).alias("start"),
        (F.col("before__rows") + F.row_number().over(inside) - 1).cast("long").alias("_row"),
    )
    if total:
        # decimal: twice the bytes times the shards passes 2^63 beyond some 100 PB
        middle = (2 * F.col("start") + F.col("_size")).cast("decimal(25,0)") * F.lit(n_shards)
        shard = F.least(F.floor(middle / F.lit(2 * total).cast("decimal(25,0)")).cast("int"), F.lit(n_shards - 1))
    else:
        shard = F.lit(0)
    placed = placed.withColumn("shard", shard)
    firsts = placed.groupBy("_split", "shard").agg(F.min("_row").alias("_first")).groupBy("shard").agg(F.min("_first").alias("_first"))
    placed = placed.join(F.broadcast(firsts), "shard")  # n_shards rows at most
    return placed.select(*rows.columns, "start", "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Writes the result of ``balanced_shards`` with one folder a shard, rows in slot order; a shard without rows has no folder."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 16) and text_crc32 of every row, repeated ones and null ids too; an
    empty table gives none, other columns are not read."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard under the law ``bytes``; see ``balanced_shards``. Equal texts are not kept together: the law is
    equal sizes, and a group of copies may be larger than a shard."""
    shards = balanced_shards(sized(table(spark, sf_dir, "documents")))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
