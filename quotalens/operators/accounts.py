"""Accounts merged into others (M5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotalens.session import cut

#: Width of the spans of time that an account's facts are dealt by.
SPAN_US = 600_000_000


def merge_ends(merges: DataFrame) -> DataFrame:
    """Each merge (source, target, us) with ``survivor``: where its rows are after all later merges.

    A merge moves what its source holds at that time, so the merge that follows one is the first later merge whose source is its
    target: chains end, also where an account is merged away, comes back and takes others in (A into B, B into A). Ends are found by
    pointer jumping: every round halves the steps, and a chain of n merges takes log2(n) rounds. Of two merges of one source at
    one time the smaller target counts; a merge into itself is none.
    """
    once = merges.where("source != target AND us IS NOT NULL").groupBy("source", "us").agg(F.min("target").alias("target"))
    leaves = once.select(F.col("source").alias("account"), "us", F.struct("source", "us").alias("leaving"), F.lit(None).cast(merges.schema["target"].dataType).alias("source"))
    arrives = once.select(F.col("target").alias("account"), "us", F.lit(None).cast(leaves.schema["leaving"].dataType).alias("leaving"), "source")
    # from the latest back, a running value; of equal times what leaves comes last, so an arrival meets only later departures
    after = Window.partitionBy("account").orderBy(F.desc("us"), F.col("leaving").isNotNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    follows = leaves.unionByName(arrives).withColumn("next", F.last("leaving", ignorenulls=True).over(after)).where("source IS NOT NULL")
    step = cut(follows.select(F.struct("source", "us").alias("merge"), F.col("account").alias("survivor"), "next"))
    while not step.where("next IS NOT NULL").isEmpty():
        then = step.select(F.col("merge").alias("next"), F.col("survivor").alias("_survivor"), F.col("next").alias("_next"))
        step = cut(step.join(then, "next", "left").select("merge", F.coalesce("_survivor", "survivor").alias("survivor"), F.col("_next").alias("next")))
    return step.select("merge.source", "merge.us", "survivor")


def resolved(facts: DataFrame, merges: DataFrame, account: str = "account_id") -> DataFrame:
    """M5 at read time: every fact (``account``, us) with ``resolved``, the account that holds it now.

    A fact follows the first merge of its account at or after it; later facts of a merged account stay its own. Inside a span of time
    of an account, merges are carried back over its facts by a running value; a fact that has none there takes the first merge of the
    account's later spans. So work is linear, no task holds more than a span's rows (or an account's spans), and facts are never
    rewritten. Null accounts and times stay as they are.
    """
    ends = merge_ends(merges).select(F.col("source").alias("_account"), "us", F.col("survivor").alias("_survivor"), F.lit(1).alias("_side"))
    rows = facts.withColumns({"_account": F.col(account), "_side": F.lit(0)})
    # facts of no time take no merge; they are dealt by where they are read
    both = rows.unionByName(ends, allowMissingColumns=True).withColumn("_span", F.coalesce(F.expr(f"us DIV {SPAN_US}"), F.spark_partition_id().cast("long")))
    spans = both.where("us IS NOT NULL").groupBy("_account", "_span").agg(F.min(F.when(F.col("_side") == 1, F.struct("us", "_survivor")))["_survivor"].alias("_first"))
    later = Window.partitionBy("_account").orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_account", "_span", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    after = Window.partitionBy("_account", "_span").orderBy(F.desc("us"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_survivor", ignorenulls=True).over(after)).where("_side = 0").join(spans, ["_account", "_span"], "left")
    return found.select(*facts.columns, F.when(F.col("us").isNotNull(), F.coalesce("_found", "_later", account)).otherwise(F.col(account)).alias("resolved"))
