"""Import of tables that refer to each other, under new keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotalens.session import cut

#: Ids that are numbered in one task.
BLOCK = 1 << 16
PROVENANCE = "origin string, table_name string, old_id long, new_id long"


@dataclass(frozen=True)
class Table:
    """A table of the graph: its id column, what makes two rows of different stores the same one (may hold references), and the
    tables that columns refer to."""

    name: str
    id: str
    natural: tuple[str, ...] = ()
    refers: dict[str, str] = field(default_factory=dict)


def _in_order(graph: list[Table]) -> list[Table]:
    """Parents first."""
    left, done = list(graph), []
    while left:
        ready = [t for t in left if all(p in {d.name for d in done} for p in t.refers.values())]
        if not ready:
            raise ValueError(f"tables refer to each other in a circle, or to one that is missing: {[t.name for t in left]}")
        done += ready
        left = [t for t in left if t not in ready]
    return done


def _numbered(rows: DataFrame, id_: str, after: int) -> DataFrame:
    """``new_id``: after + 1, after + 2, ... in the order of ``id_``; rows are numbered in blocks of ids, and blocks by prefix sums."""
    rows = rows.withColumn("_block", F.floor(F.col(id_) / BLOCK).cast("bigint"))
    starts = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    starts = starts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(id_))
    return rows.join(starts, "_block").withColumn("new_id", (F.col("_before") + inside + after).cast("bigint")).drop("_block", "_before")


def imported(existing: dict[str, DataFrame], incoming: dict[str, DataFrame], graph: list[Table], origin: str, provenance: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """M4: (rows to add to each table, provenance to add) for an export of the store ``origin``; ids are unique in a table of either store.

    Tables come parents first, and a reference to a parent is replaced by the parent's new id before anything else. A row whose id of
    this origin is in ``provenance`` was imported before and keeps its id; else one whose natural key (not null) is in the table is that row;
    else it is added, under the next free id. So importing twice adds nothing, and rows that an earlier, partial import left out are
    added to the parents that are there. A row whose parent is in neither export nor store is left out with all its children;
    a null reference stays null. Of incoming rows of one natural key the smallest id is added and stands for all.
    """
    added, origins = {}, []
    maps: dict[str, DataFrame] = {}
    known = provenance.where(F.col("origin") == origin)
    for t in _in_order(graph):
        mine = known.where(F.col("table_name") == t.name).select(F.col("old_id"), F.col("new_id").alias("_before"))
        rows = incoming[t.name].withColumn("old_id", F.col(t.id))
        for column, parent in t.refers.items():
            parents = maps[parent].select(F.col("old_id").alias(column), F.col("new_id").alias("_to"))
            rows = rows.join(parents, column, "left").where(F.col(column).isNull() | F.col("_to").isNotNull()).withColumn(column, F.col("_to")).drop("_to")
        rows = rows.join(mine, "old_id", "left")
        if t.natural:
            there = existing[t.name].groupBy(*t.natural).agg(F.min(t.id).alias("_there"))
            first = F.min(F.when(F.col("_before").isNull(), F.col("old_id"))).over(Window.partitionBy(*t.natural))
            whole = F.lit(True)
            for c in t.natural:
                whole = whole & F.col(c).isNotNull()
            rows = rows.join(there, list(t.natural), "left").withColumn("_first", F.when(whole, first).otherwise(F.col("old_id")))
            rows = rows.withColumn("_there", F.when(whole, F.col("_there")))
        else:
            rows = rows.withColumns({"_there": F.lit(None).cast("bigint"), "_first": F.col("old_id")})
        rows = cut(rows.withColumn("_known", F.coalesce("_before", "_there")))
        top = existing[t.name].agg(F.coalesce(F.max(t.id), F.lit(0))).first()[0]
        new = cut(_numbered(rows.where("_known IS NULL AND old_id = _first").drop("_known", "_before", "_there", "_first"), "old_id", top))
        kinds = existing[t.name].schema
        added[t.name] = new.withColumn(t.id, F.col("new_id")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])
        ids = rows.join(new.select(F.col("old_id").alias("_first"), "new_id"), "_first", "left").select("old_id", F.coalesce("_known", "new_id").alias("new_id"), "_before")
        ids = cut(ids)
        maps[t.name] = ids.select("old_id", "new_id")
        origins.append(ids.where("_before IS NULL").select(F.lit(origin).alias("origin"), F.lit(t.name).alias("table_name"), F.col("old_id").cast("bigint").alias("old_id"), F.col("new_id").cast("bigint").alias("new_id")))
    made = origins[0]
    for o in origins[1:]:
        made = made.unionByName(o)
    return added, made
