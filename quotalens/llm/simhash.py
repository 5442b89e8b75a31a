"""SimHash near-duplicates: exact comparison of fingerprint tiles (operator 9)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, input_bytes, keep, keep_bucketed, table, with_position
from .graph import components

SHINGLE, RADIUS, BITS, TILE = 3, 2, 64, 1024
#: For dropping near copies: radius between 64-bit fingerprints of distinct words, words of a shingle, and the least exact
#: similarity of a dropped text with one that stays.
COPY_RADIUS, COPY_SHINGLE, PAIR_SIMILARITY = 3, 5, 0.8
#: Rows that are held against one copy of a text.
LOT = 2000
#: Texts sampled for common shingles (and at least one of so many), texts of these that share one, and the most that are told apart; they
#: order shingles only. A fixed share keeps the frequency from which a shingle counts as common alike at every size.
SAMPLE_TEXTS, SAMPLE_SHARE, COMMON_TEXTS, COMMON_MOST = 10_000, 20, 3, 1_000_000
_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    pieces = map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    by_byte = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + _PLACE
    set_bits = np.einsum("pv,vb->pb", np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256), _BIT_OF)
    return int.from_bytes(np.packbits(2 * set_bits.ravel() > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the whole text (UTF-8): a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    return _majority(_shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row. Null and blank texts have fingerprint 0; texts are hashed whole."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind}, fp long")


def word_fingerprint(text: bytes) -> int:
    """64-bit SimHash of the distinct words, which a few edits in a long text hardly move."""
    return _majority(np.array([xxhash.xxh64_intdigest(w, 42) for w in set(text.lower().split())], np.uint64))


def _near_in_runs(radius: int):
    """Compares all fingerprints of a run of equal tile keys with exclusive-or and bit counts, in arrays over many runs."""

    def linked(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        left, right, step = [], [], 0
        at = np.arange(len(keys))
        while len(at):
            step += 1
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
            left.append(near)
            right.append(near + step)
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        root = np.arange(len(keys))
        while len(i):  # only a forest leaves the task: no more links than fingerprints
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, root[i], low)
            np.minimum.at(new, root[j], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        k = np.flatnonzero(root != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[k]), pa.array(nodes[root[k]])], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            keys = held[0]
            if len(keys) and keys[0] != keys[-1]:
                whole = np.flatnonzero(keys != keys[-1])[-1] + 1  # the last run may go on in the next batch
                yield linked(*[h[:whole] for h in held])
                held = [h[whole:] for h in held]
        if held is not None and len(held[0]):
            yield linked(*held)

    return each


def near_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between ``nodes`` (node, fp; both long) with the same components as all near pairs.

    Near: fp differs in at most ``radius`` bits. Of radius + 2 segments of a fingerprint, two at least are equal in any
    pair within the radius; so the pairs inside the blocks that share two segments are all there are. A block of up to
    ``tile`` nodes is one tile. A larger one is cut into tiles of one population count each, and tile pairs whose counts
    differ by more than the radius are skipped. Every remaining tile pair is compared exactly, whatever the block's size;
    a task never holds more than two tiles (about; tiles are cut by a hash) of one block.
    """
    n, fp, own = radius + 2, F.col("fp"), ["node", "fp"]
    cuts = [round(BITS * k / n) for k in range(n + 1)]
    segment = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    bands = [F.xxhash64(F.lit(k), segment[x], segment[y]) for k, (x, y) in enumerate(combinations(range(n), 2))]
    keyed = nodes.select(*own, F.bit_count(fp).alias("ones"), F.explode(F.array(*bands)).alias("band"))
    by_ones = keyed.groupBy("band", "ones").agg(F.count("*").alias("n"))
    blocks = by_ones.groupBy("band").agg(F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("ones", "n"))).alias("counts")).where("_all > 1")
    keyed = keyed.join(blocks, "band")
    small = keyed.where(F.col("_all") <= tile).select(F.col("band").alias("tile"), *own)
    cut = keyed.where(F.col("_all") > tile).selectExpr(
        *own, "band",
        f"named_struct('ones', ones, 'k', pmod(xxhash64(node), ceil(counts[ones] / {tile}))) AS own_tile",
        f"""explode(flatten(transform(filter(map_keys(counts), o -> abs(o - ones) <= {radius}),
                o -> transform(sequence(0L, ceil(counts[o] / {tile}) - 1), k -> named_struct('ones', o, 'k', k))))) AS other_tile""",
    )
    large = cut.select(F.xxhash64("band", F.least("own_tile", "other_tile"), F.greatest("own_tile", "other_tile")).alias("tile"), *own)
    tiles = small.unionByName(large).repartition("tile").sortWithinPartitions("tile")
    return tiles.mapInArrow(_near_in_runs(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, id_col: str = "doc_id") -> DataFrame:
    """(id, fp long, component_id): the smallest id reachable over links of at most ``radius`` differing bits.

    Exact copies share a fingerprint, so only distinct fingerprints are compared and linked; each row then takes its
    fingerprint's component. Null and empty texts have fingerprint 0 and link like any other. Null ids keep their row
    and take part in no minimum. An empty table gives no rows; other columns are not read.
    """
    rows = keep(fingerprints(docs, shingle, id_col), "fingerprints")
    distinct = keep(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct-fingerprints")
    roots = components(near_links(distinct.select(F.col("fp").alias("node"), "fp"), radius, tile))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    member = keep(member, "members")
    first = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(member.join(first, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def _goes_to_earlier(least: float):
    """(row, by) of every text at least ``least`` similar to an earlier text that stays, in runs of equal keys, in order.

    Texts that stay are found by the first shingles of their sorted hashes, of which two such texts share one; so a text
    is held against all that stay in its run, and the memory of a task holds the shingles of one run's.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stay, by_hash = None, [], {}
        for batch in batches:
            gone, by = [], []
            for k, row, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if k != key:
                    key, stay, by_hash = k, [], {}
                own = np.unique(_shingle_hashes((text or "").encode(), COPY_SHINGLE))
                first = own[: _prefix(len(own), least)].tolist()
                for i in sorted({i for h in first for i in by_hash.get(h, ())}):
                    if _set_jaccard(own, stay[i][1]) >= least:
                        gone.append(row)
                        by.append(stay[i][0])
                        break
                else:
                    for h in first:
                        by_hash.setdefault(h, []).append(len(stay))
                    stay.append((row, own))
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64()), pa.array(by, pa.int64())], names=["_row", "_by"])

    return each


def _prefix(size: int, least: float) -> int:
    """Of two sets in one order, similar to ``least``, the first so many of each share an element."""
    return size - math.ceil(least * size - 1e-9) + 1 if size else 0


def _set_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes; two empty sets are equal."""
    if min(len(a), len(b)) < PAIR_SIMILARITY * max(len(a), len(b)):
        return 0.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same) if len(a) else 1.0


def _common_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes of shingles that COMMON_TEXTS or more of the sampled texts share, the most common last, at most COMMON_MOST."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(_shingle_hashes(t or b"", COPY_SHINGLE)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *made]).view(np.int64))], names=["h"])

    sample = texts.where(F.pmod(F.xxhash64("_row"), F.lit(min(SAMPLE_SHARE, max(1, n // SAMPLE_TEXTS)))) == 0).select("text")
    common = sample.mapInArrow(each, "h long").groupBy("h").agg(F.count("*").alias("n")).where(f"n >= {COMMON_TEXTS}")
    found = common.orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").toArrow()
    return found.column("h").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _first_shingles(texts: DataFrame, common: np.ndarray, new: int) -> DataFrame:
    """(h, _row, at, size, new) of the distinct shingles of which two texts similar to PAIR_SIMILARITY share one: the first
    by common rank (rare ones before all) and hash. Any fixed order is exact; this one keeps what many texts hold out."""
    by_hash = np.argsort(common)
    sorted_ = common[by_hash]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows_, at, size = [np.empty(0, np.uint64)], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = np.unique(_shingle_hashes(text or b"", COPY_SHINGLE))
                rank = np.full(len(own), -1)
                if len(common):
                    place = np.minimum(np.searchsorted(sorted_, own), len(common) - 1)
                    rank = np.where(sorted_[place] == own, by_hash[place], -1)
                first = own[np.lexsort((own, rank))][: _prefix(len(own), PAIR_SIMILARITY)]
                found.append(first)
                rows_.append(np.full(len(first), row, np.int64))
                at.append(np.arange(len(first), dtype=np.int32))
                size.append(np.full(len(first), len(own), np.int32))
            columns = [np.concatenate(found).view(np.int64), np.concatenate([np.empty(0, np.int64), *rows_]), *[np.concatenate([np.empty(0, np.int32), *c]) for c in (at, size)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "_row", "at", "size"])

    return texts.select("_row", "text").mapInArrow(each, "h long, _row long, at int, size int").withColumn("new", F.lit(new))


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by their first column, whose key another row has too; a task holds one row between batches."""
    last_key, last_given, last_row = None, True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        same = keys[1:] == keys[:-1]
        given = np.append(False, same) | np.append(same, False)
        if last_row is not None and keys[0] == last_key:
            given[0] = True
            if not last_given:
                yield last_row
        yield batch.filter(pa.array(given))
        last_key, last_given, last_row = keys[-1], given[-1], batch.slice(batch.num_rows - 1)


def _similar_pairs(first: DataFrame) -> DataFrame:
    """(_row, _head) of all pairs, at least one of them new, that share a first shingle and whose sizes and places allow for
    PAIR_SIMILARITY (9 times the common shingles is 4 times both sizes).

    Most first shingles are in one text alone, so one narrow shuffle drops these; what is left is written. Blocks of over
    TILE texts are dealt into tiles of that size, and all pairs of tiles compared.
    """
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema)
    shared = keep(first.repartition("h").sortWithinPartitions("h").mapInArrow(_in_runs, kind), "near-shared")
    counts = shared.groupBy("h").agg(F.count("*").alias("n"))
    dealt = shared.join(counts, "h").selectExpr("*", f"pmod(xxhash64(_row), ceil(n / {TILE})) AS k", f"explode(sequence(0L, ceil(n / {TILE}) - 1)) AS j")
    dealt = dealt.selectExpr("h", "least(k, j) AS k", "greatest(k, j) AS j", "_row", "at", "size", "new")
    a, b = dealt.alias("a"), dealt.alias("b")
    both = a.join(b, F.expr("a.h = b.h AND a.k = b.k AND a.j = b.j AND a._row < b._row"))
    both = both.where("a.new + b.new > 0 AND 5L * least(a.size, b.size) >= 4L * greatest(a.size, b.size) AND 9L * least(a.size - a.at, b.size - b.at) >= 4L * (a.size + b.size)")
    return both.selectExpr("a._row AS _row", "b._row AS _head").distinct()


def _parities(own: np.ndarray) -> bytes:
    """One bit for each value of the hashes' last bits (twice as many values as hashes at most, 64 at least): whether an odd number have it."""
    bits = max(64, 1 << (len(own) - 1).bit_length() if len(own) else 0)
    at = (own & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """In how many bits two sets' parities differ, the longer folded to the shorter: no more than the hashes that one set alone has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _not_ruled_out(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (_row, _head) whose shingles' parities allow for PAIR_SIMILARITY, which needs 9 times the shingles of one text alone
    to be at most both sizes. Parities are a few hundredths of a text, so texts move for pairs that are similar, and few more."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(_shingle_hashes(t or b"", COPY_SHINGLE)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [batch.column(0), pa.array([len(o) for o in own], pa.int32()), pa.array([_parities(o) for o in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "n", "bits"])

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            near = pa.array([9 * _differing(x, y) <= n for n, x, y in zip(sizes, a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in (0, 1)], names=["_row", "_head"])

    pairs = keep(pairs, "near-candidates")
    paired = pairs.select("_row").unionByName(pairs.select(F.col("_head").alias("_row"))).distinct()
    made = keep(texts.select("_row", "text").join(paired, "_row", "left_semi").mapInArrow(marked, "_row long, n int, bits binary"), "near-parities")
    heads = made.toDF("_head", "head_n", "head_bits")
    both = pairs.join(made, "_row").join(heads, "_head").select("_row", "_head", (F.col("n") + F.col("head_n")).alias("n"), "bits", "head_bits")
    return both.mapInArrow(allowed, "_row long, _head long")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, _by) of the pairs (_row, _head, text, kept_text) that are similar; shingles are sorted hashes, eight bytes each."""
    hashes = lambda text: np.unique(_shingle_hashes(text.encode(), COPY_SHINGLE))
    of_head = lru_cache(maxsize=16)(hashes)
    for batch in batches:
        near = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):  # one text at a time is a Python string
            own, kept = (batch.column(c)[k].as_py() or "" for c in (2, 3))
            near[k] = _set_jaccard(hashes(own), of_head(kept)) >= PAIR_SIMILARITY
        found = pa.array(near)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(found), batch.column(1).filter(found)], names=["_row", "_by"])


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(_row, _by) of the pairs (_row, _head) whose texts are similar.

    A head that thousands of rows are held against would send all their texts to one task: its pairs are dealt into lots of LOT, and
    each lot meets a copy of the head's text.
    """
    pairs = keep(pairs, "near-pairs")
    lots = pairs.groupBy("_head").agg(F.ceil(F.count("*") / LOT).alias("_lots"))
    large = lots.where("_lots > 1")
    dealt = pairs.join(large, "_head", "left").selectExpr("_row", "_head", "coalesce(pmod(xxhash64(_row), _lots), 0L) AS _lot")
    heads = lots.selectExpr("_head", "explode(sequence(0L, _lots - 1)) AS _lot").join(texts.select(F.col("_row").alias("_head"), F.col("text").alias("kept_text")), "_head")
    both = dealt.join(texts.select("_row", "text"), "_row").join(heads, ["_head", "_lot"])
    return both.select("_row", "_head", "text", "kept_text").mapInArrow(_compared, "_row long, _by long")


def _settled(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(_row, _by) of texts that go in groups (_root, _order, _row)."""
    dealt = groups.join(texts.select("_row", "text"), "_row").repartition("_root").sortWithinPartitions("_root", "_order")
    return dealt.select("_root", "_row", "text").mapInArrow(_goes_to_earlier(PAIR_SIMILARITY), "_row long, _by long")


def _settled_exactly(members: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """(_row, _by) of members (_row, _order) that go, all members of similar pairs held against each other."""
    links = keep(_similar(_not_ruled_out(_similar_pairs(first), texts), texts), "near-exact-links")
    roots = components(links, "_row", "_by").select(F.col("node").alias("_row"), F.col("root").alias("_root"))
    return keep(_settled(members.join(roots, "_row"), texts), "near-exact-gone")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any more columns) with one row of each group of near copies, the one of smallest id.

    Equal texts (but for white space and case) are one text. No two texts that stay are PAIR_SIMILARITY similar in their
    distinct shingles, and each that goes is so to one that stays, in three steps:

    1. Dense groups shrink: components of links between texts whose fingerprints of distinct words lie within COPY_RADIUS.
       In a group, in the order of ids, a text goes if it is similar to one that stays: first all are held against the
       smallest, in parallel, then the leftovers against each other in one sorted pass.
    2. Among what is left, all similar pairs are found by a prefix filter and by parities of shingles, which miss none, and components
       of these are settled alike; a text to which more went in step 1 comes first.
    3. A text that went to one that itself goes in step 2 comes back, and is held against all that stay.

    Texts are dealt out by row once; every later step moves ids and hashes to them, and texts only within groups and pairs.

    Null and blank texts are copies of each other. Null ids come last; ties go by input order; an empty table stays empty.
    """
    docs, restored = apart(docs, "doc_id", "text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [word_fingerprint(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(made, pa.int64())], names=["_row", "node", "_id", "fp"])

    rows = keep_bucketed(with_position(docs, "_row"), "near-rows", "_row", input_bytes(docs))
    text = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    marks = rows.select("_row", "text", F.xxhash64(text).alias("node"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_id"))
    marks = marks.mapInArrow(marked, "_row long, node long, _id long, fp long")
    texts = keep(marks.groupBy("node").agg(F.min(F.struct("_id", "_row")).alias("_first"), F.min("fp").alias("fp")), "near-texts")
    roots = components(near_links(texts.select("node", "fp"), COPY_RADIUS)).withColumnRenamed("node", "_node")
    grouped = texts.join(roots, texts["node"] == roots["_node"], "left").select(F.coalesce("root", "node").alias("_root"), F.col("_first._id").alias("_id"), F.col("_first._row").alias("_row"))
    grouped = keep(grouped, "near-groups")
    heads = keep(grouped.groupBy("_root").agg(F.min(F.struct("_id", "_row"))["_row"].alias("_head"), F.count("*").alias("n")), "near-heads")
    others = grouped.join(heads.where("n > 1"), "_root").where("_row != _head").select("_root", F.struct("_id", "_row").alias("_order"), "_row", "_head")
    gone = keep(_similar(others.select("_row", "_head"), rows), "near-gone")
    rest = others.select("_root", "_order", "_row").join(gone, "_row", "left_anti")
    gone = gone.unionByName(keep(_settled(rest, rows), "near-leftovers"))

    taken = gone.groupBy(F.col("_by").alias("_row")).agg(F.count("*").alias("_taken"))
    left = grouped.select("_row", "_id").join(gone, "_row", "left_anti").join(taken, "_row", "left")
    left = keep(left.select("_row", F.struct((-F.coalesce("_taken", F.lit(0))).alias("_before"), "_id", "_row").alias("_order")), "near-left")
    left_texts = rows.select("_row", "text").join(left, "_row", "left_semi")
    common = _common_shingles(left_texts, left.count())
    first = _first_shingles(left_texts, common, 1)
    again = _settled_exactly(left, first, rows)

    left = left.join(again, "_row", "left_anti").select("_row", "_order")
    back = keep(gone.join(again.select(F.col("_row").alias("_by")), "_by", "left_semi").select("_row").join(grouped.select("_row", "_id"), "_row"), "near-back")
    if not back.isEmpty():
        # texts that come back are few, so first shingles are made anew rather than kept for them
        more = keep(_first_shingles(rows.select("_row", "text").join(back, "_row", "left_semi"), common, 1), "near-more")
        first = first.withColumn("new", F.lit(0)).join(more.select("h").distinct(), "h", "left_semi").join(left, "_row", "left_semi").unionByName(more)
        # those that stay come first, so none of them goes: no two are similar
        back = back.select("_row", F.struct(F.lit(1).cast("long").alias("_before"), "_id", "_row").alias("_order"))
        left = left.unionByName(back)
        left = left.join(_settled_exactly(left, first, rows), "_row", "left_anti")
    stays = keep(left.select("_row"), "near-stays")
    return restored(rows.join(stays, "_row", "left_semi"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, in the contract's columns; see ``near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
