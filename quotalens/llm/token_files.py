"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks (operator 7)."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_by_split, shared_dir, table
from .tokens import encoder, tokenizer_path

#: Ids of a block, blocks of a segment, lanes of a block that are coded side by side, ids that a lane has at least, and the mark of a segment.
BLOCK, BLOCKS, LANES, LANE, MAGIC = 1 << 22, 1, 8192, 128, b"QCM2"
END_ID = 2
#: Ids that the order-0 table holds, slots of the order-2 table, steps between two rebuilds of the order-0 table.
SYMBOLS, _SLOTS, _EVERY = 49408, 1 << 17, 32
#: Bits of the coder's total and of the order-0 total, highest sureness of a prediction, low bits that the table of places leaves out.
_TOTAL, _ORDER0, _SURE, _NEARBY = 28, 22, 7, 8
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_WORD, _KEEP = np.uint64(16), np.uint64(48)
_HALF = np.uint32(16)


class _Coder:
    """Carry-less range coders, one a lane, of 64-bit states and 16-bit words; ``streams`` (nth words of all lanes, row by row)
    makes them decoders."""

    def __init__(self, lanes: int, room: int, streams: np.ndarray | None = None) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.decoding, self.lanes = streams is not None, lanes
        #: lanes advance about alike, so that words of one place lie side by side; and each lane's place
        self.words, self.at = (streams if self.decoding else np.zeros((room, lanes), np.uint16)).ravel(), np.arange(lanes)
        self.code = np.zeros(lanes, np.uint64)
        if self.decoding:
            for _ in range(4):
                self.code = (self.code << _WORD) | self.words[self.at]
                self.at += lanes

    def value(self, n: int) -> np.ndarray:
        """Where the code of the first ``n`` lanes lies in the total (decoding); ``narrow`` must follow."""
        step = self.range[:n] >> np.uint64(_TOTAL)
        return np.minimum((self.code[:n] - self.low[:n]) // step, np.uint64((1 << _TOTAL) - 1)).astype(np.int64)

    def narrow(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        low, span = self.low[:n], self.range[:n]
        span >>= np.uint64(_TOTAL)
        low += start.view(np.uint64) * span
        span *= size.view(np.uint64)
        same = (low ^ (low + span)) < _TOP
        moved = np.flatnonzero(same | (span < _BOTTOM))
        while len(moved):  # only a lane that gave a word can have another
            l, r, at = low.take(moved), span.take(moved), self.at.take(moved)
            tight = np.flatnonzero(~same.take(moved))
            if len(tight):
                r[tight] = (np.uint64(0) - l[tight]) & (_BOTTOM - np.uint64(1))
            if self.decoding:
                self.code[moved] = (self.code.take(moved) << _WORD) | self.words.take(at)
            else:
                self.words[at] = l >> _KEEP
            self.at[moved] = at + self.lanes
            l <<= _WORD
            r <<= _WORD
            low[moved], span[moved] = l, r
            again = (l ^ (l + r)) < _TOP
            same[moved] = again
            moved = moved[again | (r < _BOTTOM)]

    def finish(self) -> tuple[np.ndarray, bytes]:
        """Words of each lane, and all lanes' words. The decoder reads zeros after them, so one word closes a lane if the
        interval holds a number with zeros alone after it, else two."""
        one, two = (self.low + (_TOP - np.uint64(1))) >> _KEEP << _KEEP, self.low + (_BOTTOM - np.uint64(1))
        short = one - self.low < self.range
        last = np.where(short, one, two)
        self.words[self.at], self.words[self.at + self.lanes] = last >> _KEEP, np.where(short, 0, (last >> np.uint64(32)) & np.uint64(0xFFFF))
        sizes = self.at // self.lanes + 2 - short
        rows = np.ascontiguousarray(self.words.reshape(-1, self.lanes)[: sizes.max()].T)
        return sizes, rows[np.arange(rows.shape[1]) < sizes[:, None]].astype("<u2").tobytes()


class _Mixture:
    """What a block's lanes have seen so far: the id after each order-2 and order-1 context and how sure that is, the
    weights of the two in each pair of surenesses, and order-0 frequencies. Each step all lanes add to it."""

    def __init__(self) -> None:
        self.after_two, self.after_one = np.zeros(_SLOTS, np.uint32), np.zeros(1 << 16, np.uint32)
        pairs = 2 * (_SURE + 1) ** 2
        self.outcomes = np.tile([0.4, 0.2, 0.4], (pairs, 1))
        self.outcomes[1::2, 1] = 0  # odd: both predict the same
        self.rank, self.seen = np.full(SYMBOLS, -1, np.int64), np.empty(0, np.int64)
        self.counts, self.new = np.empty(0, np.int64), []
        self.cumulative = np.array([SYMBOLS], np.int64)
        self.weigh()

    def weigh(self) -> None:
        """Shares of the total for an order-2 hit and an order-1 hit; order 0 keeps a 64th at least."""
        share = self.outcomes[:, :2] / self.outcomes.sum(1, keepdims=True)
        share = np.maximum((share * (63 / 64) * (1 << _TOTAL)).astype(np.int64), 1)
        self.two, self.one = np.ascontiguousarray(share[:, 0]), np.ascontiguousarray(share[:, 1])
        self.one[1::2] = 0
        self.both = self.two + self.one
        #: intervals of a hit, by pair and whether it is order 2's
        self.start = np.stack([self.two, np.zeros_like(self.two)], 1).ravel()
        self.size = np.stack([self.one, self.two], 1).ravel()

    def rebuild(self) -> None:
        """Order-0 frequencies of what has been seen, above one unit of the total for every id there is."""
        ids = np.concatenate(self.new)
        ranks, self.new = self.rank.take(ids), []
        if len(ids) and ranks.min() < 0:
            more = np.unique(ids[ranks < 0])
            self.rank[more] = len(self.seen) + np.arange(len(more))
            self.seen = np.concatenate([self.seen, more])
            self.counts = np.concatenate([self.counts, np.zeros(len(more), np.int64)])
            ranks = self.rank.take(ids)
        self.counts = self.counts + np.bincount(ranks, minlength=len(self.seen))
        if len(self.seen):
            total = np.cumsum(self.counts)
            room = (1 << _ORDER0) - SYMBOLS - len(self.seen)
            upto = total * room // total[-1] + np.arange(1, len(total) + 1)
            self.cumulative = np.concatenate([[0], upto]) + SYMBOLS
            self.nearby = None

    def interval(self, ids: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ids, of which the ranks are given, begin and end in the order-0 total."""
        known = rank >= 0
        if known.all():
            return self.cumulative.take(rank, mode="clip"), self.cumulative.take(rank + 1, mode="clip")
        begin, end = ids.copy(), ids + 1
        begin[known], end[known] = self.cumulative[rank[known]], self.cumulative[rank[known] + 1]
        return begin, end

    def found(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids whose intervals hold the places, and their ranks."""
        if not len(self.seen):
            ids = np.minimum(place, SYMBOLS - 1)
            return ids, self.rank.take(ids)
        if self.nearby is None:  # of each 2^_NEARBY-th place, how many intervals begin up to it
            steps = 1 << (_ORDER0 - _NEARBY)
            self.nearby = np.cumsum(np.bincount((self.cumulative - 1 >> _NEARBY) + 1, minlength=steps)[:steps]) - 1
        rank = self.nearby.take(place >> _NEARBY, mode="clip")  # right but for rare ids and places near an end
        wrong = np.flatnonzero(self.cumulative.take(rank + 1, mode="clip") <= place)
        rank[wrong] = np.searchsorted(self.cumulative, place[wrong], side="right") - 1
        known = rank >= 0
        if known.all():
            return self.seen.take(rank, mode="clip"), rank
        ids = np.where(known, self.seen.take(rank, mode="clip"), np.minimum(place, SYMBOLS - 1))
        return ids, self.rank.take(ids)


#: What a guess's sureness gains, by that sureness and whether the guess was right.
_GAIN = np.array([[0 if k == 0 else -1 << 16, 0 if k == _SURE else 1 << 16] for k in range(_SURE + 1)], np.int64).astype(np.uint32).ravel()


def _followed(table: np.ndarray, at: np.ndarray, entry: np.ndarray, sure: np.ndarray, right: np.ndarray, token: np.ndarray) -> None:
    """A right guess grows surer, a wrong one less sure, and one that is not sure gives way. Of equal slots the last lane writes."""
    case = sure * 2 + right
    new = entry + _GAIN.take(case, mode="clip")
    np.copyto(new, token, where=case == 0)
    table[at] = new


def _run(n_ids: int, lanes: int, ids: np.ndarray | None, streams: np.ndarray | None) -> np.ndarray | tuple[np.ndarray, bytes]:
    """Codes (``ids``) or decodes (``streams``, see _Coder) one block, its lanes side by side: equal parts of the block, the last may be shorter.

    The probability of an id is a mixture: the order-2 and order-1 predictions with the weights that their surenesses
    have earned, and for what neither predicts the order-0 frequencies with the rest.
    """
    steps = -(-n_ids // lanes)
    last_steps = n_ids - steps * (lanes - 1)
    told = None
    if ids is not None:
        told = np.zeros(steps * lanes, np.uint16)
        told[:n_ids] = ids
        told = np.ascontiguousarray(told.reshape(lanes, steps).T)
    coder, model = _Coder(lanes, 2 * steps + 8, streams), _Mixture()
    out = np.zeros((steps, lanes), np.uint16)
    before, last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(steps):
        n = lanes - (t >= last_steps)
        if n < len(last):
            before, last = before[:n], last[:n]
        slot = (last * 0x9E3779B1 + before * 0x85EBCA77 >> 13) & (_SLOTS - 1)
        two, one = model.after_two.take(slot, mode="clip"), model.after_one.take(last, mode="clip")
        guess_two, guess_one = two.astype(np.uint16), one.astype(np.uint16)  # the lower halves
        sure_two, sure_one = two >> _HALF, one >> _HALF
        pair = (sure_two * np.uint32(2 * (_SURE + 1)) + sure_one * np.uint32(2) + (guess_two == guess_one)).astype(np.int64)
        if told is None:
            value = coder.value(n)
            is_two = value < model.two.take(pair, mode="clip")
            missed = np.flatnonzero(value >= model.both.take(pair, mode="clip"))
            token = guess_one.copy()
            np.copyto(token, guess_two, where=is_two)
            pair_missed = pair[missed]
            both = model.both.take(pair_missed, mode="clip")
            # exact: both numbers are below 2^53, and a quotient below 2^22 is 2^-28 at least from the next whole number or is one
            found, rank = model.found(((((value[missed] - both + 1) << _ORDER0) - 1) / ((1 << _TOTAL) - both)).astype(np.int64))
            token[missed] = found
        else:
            token = told[t, :n]
            is_two = guess_two == token
            missed = np.flatnonzero(~(is_two | (guess_one == token)))
            found, pair_missed = token[missed].astype(np.int64), pair[missed]
            both, rank = model.both.take(pair_missed, mode="clip"), model.rank.take(found)
        hit = pair * 2 + is_two
        start, size = model.start.take(hit, mode="clip"), model.size.take(hit, mode="clip")
        begin, end = model.interval(found, rank)
        room = (1 << _TOTAL) - both
        begin = room * begin >> _ORDER0
        start[missed] = both + begin
        size[missed] = (room * end >> _ORDER0) - begin
        coder.narrow(n, start, size)
        hits, misses = np.bincount(hit, minlength=model.start.size).reshape(-1, 2), np.bincount(pair_missed, minlength=model.both.size)
        for k, seen in enumerate((hits[:, 1], hits[:, 0] - misses, misses)):
            model.outcomes[:, k] += seen
        _followed(model.after_two, slot, two, sure_two, is_two, token)
        _followed(model.after_one, last, one, sure_one, guess_one == token, token)
        model.new.append(found)
        if t < _EVERY or t % _EVERY == 0:
            model.rebuild()
        if t < _EVERY or t % 4 == 0:
            model.weigh()
        out[t, :n] = token
        before, last = last, token.astype(np.int64)
    return np.ascontiguousarray(out.T).ravel()[:n_ids] if told is None else coder.finish()


def encode_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment (``block`` ids at most in a block; a lane has at most BLOCK / LANES of them): mark, number of blocks; for each block its ids, lanes, bytes and the crc32 of its ids; then for each block
    its lanes' sizes (16 bits) and words. A block can be read without the others. Ids must be below SYMBOLS; none makes no block."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >= SYMBOLS:
        raise ValueError("an id is beyond the coder's tables")
    heads, coded = [], []
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        steps = -(-len(part) // max(1, min(LANES, len(part) // LANE)))
        lanes = -(-len(part) // steps)
        sizes, words = _run(len(part), lanes, part, None)
        coded.append(sizes.astype("<u2").tobytes() + words)
        heads.append(struct.pack("<IIII", len(part), lanes, len(coded[-1]), zlib.crc32(part.tobytes())))
    return b"".join([MAGIC, struct.pack("<I", len(heads)), *heads, *coded])


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if it is cut short, not a segment, or a block's checksum differs."""
    if data[:4] != MAGIC or len(data) < 8:
        raise ValueError("not a token segment")
    (n,) = struct.unpack_from("<I", data, 4)
    at, out = 8 + 16 * n, []
    if len(data) < at:
        raise ValueError("segment is cut short")
    heads = [struct.unpack_from("<IIII", data, 8 + 16 * k) for k in range(n)]
    if len(data) < at + sum(h[2] for h in heads):
        raise ValueError("segment is cut short")
    for length, lanes, size, crc in heads:
        sizes = np.frombuffer(data, "<u2", lanes, at).astype(np.int64) if 2 * lanes <= size else np.zeros(0, np.int64)
        if not lanes or len(sizes) < lanes or 2 * (lanes + int(sizes.sum())) != size or -(-length // lanes) * (lanes - 1) >= length:
            raise ValueError("a block does not end where it should")
        streams = np.zeros((lanes, int(sizes.max()) + 8), np.uint16)  # a decoder reads some words ahead
        streams[np.arange(streams.shape[1]) < sizes[:, None]] = np.frombuffer(data, "<u2", int(sizes.sum()), at + 2 * lanes)
        try:
            ids = _run(length, lanes, None, np.ascontiguousarray(streams.T)).astype("<u4")
        except IndexError as e:
            raise ValueError("a block does not end where it should") from e
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        out.append(ids)
        at += size
    return np.concatenate(out) if out else np.empty(0, "<u4")


_FILE = "segment long, doc_ids array<bigint>, lengths array<bigint>, n_tokens long, coded binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Writes the ids of all texts, each closed by END_ID, in ascending doc_id order: one coded segment a row.

    Rows are dealt out by ranges of (doc_id, hash of the text), so that rows of one id can part; a range is cut into
    segments of whole texts of about BLOCKS * BLOCK ids. ``segment`` grows with the order. Null texts are the end alone,
    null ids come first; repeated rows are written once each; an empty table writes no segment.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()

        def segment() -> pa.RecordBatch:
            made = np.frombuffer(b"".join(held), "<u4")
            row = {"segment": (part << 33) + number, "doc_ids": keys, "lengths": [len(h) // 4 for h in held], "n_tokens": len(made), "coded": encode_segment(made)}
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))

        keys, held, size = [], [], 0
        for batch in batches:
            ids = own.encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            for key, some in zip(batch.column(0).to_pylist(), ids):
                keys.append(key)
                held.append(some + end)
                size += len(held[-1]) // 4
                if size >= BLOCKS * BLOCK:
                    yield segment()
                    keys, held, size, number = [], [], 0, number + 1
        if keys:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_hash", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").select("doc_id", "text")
    rows.mapInArrow(each, _FILE).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids binary): decoded texts with the ids of all texts before them.

    With ``digest``, ids_crc32 (long) stands for the ids, so that they do not leave the task that decodes them. A
    damaged block raises.
    """
    files = spark.read.schema(_FILE).parquet(path)
    last, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, keys, lengths = (batch.column(c)[k].as_py() for c in (0, 1, 2))
                data = memoryview(decode_segment(batch.column(3)[k].as_py()).tobytes())
                ends = np.cumsum(lengths)
                starts = (ends - lengths).tolist()
                parts = [data[4 * a : 4 * b] for a, b in zip(starts, ends.tolist())]
                made = [zlib.crc32(p) for p in parts] if digest else [bytes(p) for p in parts]
                columns = [pa.array([number] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(made, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "doc_id", "inside", "n_tokens", last])

    texts = files.select("segment", "doc_ids", "lengths", "coded").mapInArrow(each, f"segment long, doc_id long, inside long, n_tokens long, {last} {'long' if digest else 'binary'}")
    before = prefix_by_split(files.select("segment", "n_tokens"), "segment", ["n_tokens"], block=1 << 33)
    return texts.join(before, "segment").select("doc_id", (F.col("before_n_tokens") + F.col("inside")).alias("start"), "n_tokens", last)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids in coded files and reads these back; see ``write_token_files`` and ``read_token_files``."""
    path = f"{shared_dir(spark)}/quotalens-token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_token_files(spark, path, digest=True)
