"""Best-fit packing by a configuration linear program over the length histogram (operator 1)."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, keep, table
from .tokens import encoder, tokenizer_path

CAPACITY, END_ID = 4096, 1
#: Entries of a worker's memories of encoded words. A task ends with empty ones: tasks go round all of an executor's workers, so each worker
#: would come to hold its own for as long as it lives.
WORDS, PIECES = 300_000, 200_000
#: Rounds of the multiplicative weights, the share of its scarcest length that one pattern may cover, the prices' learning rate, how far below the best a pattern may lie, and the noise that makes rounds' patterns differ.
ROUNDS, STEP, RATE, NEAR, NOISE = 24, 0.25, 0.3, 0.5, 0.3
#: Most rows of counts (split, length, pieces before it) that are broadcast; more are joined.
BROADCAST_ROWS = 500_000


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 knapsack: best value of every capacity, and for each number i of sizes the last of them that is taken (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full((len(sizes) + 1, capacity + 1), -1, np.int16)
    for i, (size, price) in enumerate(zip(sizes.tolist(), prices.tolist())):
        value = best[: capacity + 1 - size] + price
        better = value > best[size:]
        last[i + 1] = last[i]
        last[i + 1, size:][better] = i
        np.copyto(best[size:], value, where=better)
    return best, last


def _fill(last: np.ndarray, sizes: np.ndarray, room: int) -> list[int]:
    """The sizes of the best filling of ``room``, each at most once."""
    made, i = [], len(sizes)
    while (i := int(last[i, room])) >= 0:
        made.append(i)
        room -= int(sizes[i])
    return made


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> float:
    """Unbounded knapsack: the highest price of any pattern, with each size as often as it fits."""
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(sizes, room, side="right"))
        best[room] = max(best[room - 1], float((best[room - sizes[:fits]] + prices[:fits]).max()) if fits else 0.0)
    return float(best[capacity])


def configuration_program(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[dict, float]:
    """Fractional patterns that cover the demand, by multiplicative weights, and a lower bound on the sequences.

    Each length has a price, at first its share of the capacity. A round solves the pricing knapsack once, by dynamic
    programming; for every length still short of its demand the pattern of that length and the best filling of what it
    leaves is taken, if its price is near the round's best, in an amount that covers STEP of its scarcest length; covered
    lengths become cheaper by exp(-RATE * covered share). Any prices give a dual bound: the demand at these prices over
    the best pattern's price; the better of the last prices' and the first ones' (the volume) is returned.
    """
    prices, covered = sizes / capacity, np.zeros(len(sizes))
    noise = np.random.default_rng(0)
    amounts: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        if covered.min() >= 1:
            break
        best, last = _knapsack(sizes, prices * (1 + NOISE * noise.random(len(sizes))), capacity)
        for k in range(len(sizes) - 1, -1, -1):
            if covered[k] >= 1:
                continue
            pattern = _fill(last, sizes, capacity - int(sizes[k]))
            ids, takes = np.unique(np.array([k, *pattern]), return_counts=True)
            if takes @ prices[ids] < (1 - NEAR) * best[capacity]:
                continue
            amount = float((demand[ids] / takes).min()) * STEP
            amounts[tuple(zip(ids.tolist(), takes.tolist()))] += amount
            share = amount * takes / demand[ids]
            covered[ids] += share
            prices[ids] *= np.exp(-RATE * share)
    return amounts, max(float(demand @ sizes / capacity), float(demand @ prices) / _best_pattern(sizes, prices, capacity))


def _rounded(amounts: dict, demand: np.ndarray) -> tuple[list, np.ndarray]:
    """Amounts rounded up, largest first, as far as demand is left for them; and the demand that stays unmet."""
    left, taken = demand.astype(np.int64).copy(), []
    for pattern, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        times = min(math.ceil(amount), *(int(left[k]) // n for k, n in pattern))
        if times:
            taken.append((dict(pattern), times))
            for k, n in pattern:
                left[k] -= n * times
    return taken, left


def _best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list:
    """Best-fit decreasing of what rounding left, on counts: bins alike are one entry, so its work does not grow with them."""
    by_room: dict[int, list] = defaultdict(list)
    rooms = np.zeros(capacity + 1, bool)
    for k in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[k]), int(left[k])
        while n:
            open_ = np.flatnonzero(rooms[size:])
            if not len(open_):
                each = capacity // size
                pattern, times, room = {}, max(1, n // each), capacity
            else:
                room = int(open_[0]) + size
                pattern, times = by_room[room].pop()
                rooms[room] = bool(by_room[room])
            each = min(room // size, n)
            use = min(times, n // each)
            if use < times and open_.size:
                by_room[room].append((pattern, times - use))
                rooms[room] = True
            by_room[room - each * size].append((pattern | {k: pattern.get(k, 0) + each}, use))
            rooms[room - each * size] = True
            n -= each * use
    return [x for some in by_room.values() for x in some]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], float]:
    """[(pattern {length: times in the sequence}, sequences)] that pack the histogram exactly, and the program's dual bound.

    The program's amounts are rounded to whole sequences, and the demand that leaves is solved anew until none is left;
    each time some third of it goes. Where packing the rest best-fit after some pass takes fewer sequences in all (as it
    may with a few hundred pieces, whose amounts round badly), the plan stops there; on equal numbers it goes on.
    """
    if not histogram:
        return [], 0.0
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes], np.float64)
    bound, plan, left = 0.0, [], demand.astype(np.int64)
    used, best = 0, None
    while True:
        rest = _best_fit(sizes, left, capacity)
        total = used + sum(times for _, times in rest)
        if best is None or total <= best[0]:
            best = total, len(plan), rest
        some = np.flatnonzero(left)
        if not len(some):
            break
        amounts, least = configuration_program(sizes[some], left[some].astype(np.float64), capacity, rounds)
        bound = bound or least
        taken, left[some] = _rounded(amounts, left[some])
        if not taken:
            break
        plan += [({int(some[k]): n for k, n in pattern.items()}, times) for pattern, times in taken]
        used += sum(times for _, times in taken)
    plan = plan[: best[1]] + best[2]
    return [({int(sizes[k]): n for k, n in pattern.items()}, times) for pattern, times in plan], bound


def _intervals(plan: list) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, first offset), sorted by length and rank."""
    rank, sequence, rows = defaultdict(int), 0, []
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.append((length, rank[length], n, sequence, offset))
            rank[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds _split (the task that made the row) and _nth (long: rows of the same ``length`` before it in that task).

    Both hold once the rows are written: later reads see what was written. Equal and repeated rows are numbered in the order in which
    the task has them; a length is never null; no rows give none.
    """
    at = rows.columns.index("length")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(length):
                continue
            seen = np.concatenate([seen, np.zeros(max(0, int(length.max()) + 1 - len(seen)), np.int64)])
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            counts = np.diff(np.append(first, len(sorted_)))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(sorted_)) - np.repeat(first, counts) + seen[sorted_]
            seen[sorted_[first]] += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), split, np.int32)), pa.array(nth)], names=[*batch.schema.names, "_split", "_nth"])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields, T.StructField("_split", T.IntegerType()), T.StructField("_nth", T.LongType())]))


def with_rank(rows: DataFrame, name: str) -> DataFrame:
    """Adds the row's place (from 0) among all of its ``length`` to written rows with _split and _nth.

    Only counts are shuffled, one row a split and length; the rows themselves meet their counts by a broadcast where the
    counts have been seen to be few (BROADCAST_ROWS), else by a join. Repeated rows have ranks of their own; no rows give none.
    """
    counts = rows.groupBy("length", "_split").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    counts = keep(counts.select("length", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_before")), "piece-counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    return rows.join(counts, ["length", "_split"]).withColumn(name, F.col("_before") + F.col("_nth"))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, piece int, start long, length int, ids_crc32 long[, ids binary]): whole texts' ids and the end id, cut at ``capacity``.

    Null and empty texts are the end id alone; repeated rows and null ids give their own pieces; an empty table gives none.
    """
    end = np.array([END_ID], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, WORDS, PIECES)
        try:
            for batch in batches:
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                rows, pieces = [], []
                for k, ids in enumerate(own.encode(texts)):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        pieces.append(ids[at : at + 4 * capacity])
                        rows.append((k, n, at // 4))
                taken = pa.array([k for k, _, _ in rows], pa.int64())
                columns = [batch.column(0).take(taken), pa.array([n for _, n, _ in rows], pa.int32()), pa.array([a for _, _, a in rows], pa.int64())]
                columns += [pa.array([len(p) // 4 for p in pieces], pa.int32()), pa.array(list(map(zlib.crc32, pieces)), pa.int64())]
                columns += [pa.array(pieces, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
        finally:
            own.forget()
            pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset (long) to pieces with a ``length`` (1 to ``capacity``): few, nearly full sequences.

    The driver sees the length histogram alone (``capacity`` rows at most) and returns, for each pattern and length,
    the interval of that length's ranks it takes; a piece finds its place by its rank. Patterns number at most as many
    as lengths times rounds, a pass, whatever the corpus. The pieces are written once, with their place in the task that
    makes them, and never shuffled. Which of equally long pieces goes where follows the input's order. Null columns and
    repeated rows are packed like any others; an empty table gives no rows. Other columns pass through, but sequence_id
    and offset of the input are replaced.
    """
    rows, _ = apart(pieces.drop("sequence_id", "offset"), "length")
    names, schema = rows.columns, T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    rows = keep(numbered(rows), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = plan_sequences(histogram, capacity, rounds)
    found = _intervals(plan)
    keys = found[:, 0] * (1 << 48) + found[:, 1]
    at = names.index("length"), len(names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in at)
            _, first, each_, sequence, offset = found[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1].T
            place = rank - first
            made = pa.array(sequence + place // each_), pa.array(offset + place % each_ * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, "sequence_id", "offset"])

    packed = with_rank(rows, "_rank").select(*names, "_rank").mapInArrow(each, schema)
    return packed.toDF(*[n for n in pieces.columns if n not in ("sequence_id", "offset")], "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place, in the contract's columns; see ``token_pieces`` and ``pack``."""
    packed = pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
