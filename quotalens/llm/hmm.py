"""Hidden Markov language model: Baum-Welch over partitions, exact scaled forward scores (operator 6)."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_mod5, keep, table, with_position

#: Latent states, Baum-Welch rounds, words of a training segment.
STATES, ROUNDS, SEGMENT = 8, 6, 256
#: Most frequent words that emit on their own, hashed classes of all others, and words whose counts every task holds.
OWN, HASHED, KNOWN = 16384, 4096, 262144
#: Stay chance before training, and what is added to expected counts, as a share of a class's overall share.
STAY, SMOOTH = 0.9, 2.0
LONGEST, END = 64, b"\n"
_PACK, _HELD = 512, 4_000_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words and the end; a word over LONGEST bytes stands as its digest, so that keys stay short."""
    words = text.lower().split()
    if len(text) > LONGEST:
        words = [w if len(w) <= LONGEST else b"\0" + hashlib.sha256(w).digest() for w in words]
    words.append(END)
    return words


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all texts; tasks add up what they see before the shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in _texts(batch.column(0)):
                counts.update(words_of(text))
            if len(counts) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts and classes of the frequent words; ``KNOWN`` entries at most, each of LONGEST bytes at most."""

    def __init__(self, words: list[bytes], counts: list[int], tokens: int, distinct: int, tail: dict[int, tuple[int, int]]) -> None:
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        self.tokens, self.distinct = tokens, distinct
        self.own = min(OWN, len(order))
        self.classes = self.own + HASHED
        totals, kinds = np.zeros(HASHED), np.zeros(HASHED)
        for c, (n, k) in tail.items():
            totals[c] += n
            kinds[c] += k
        #: place of a known word in class_of and log_of
        self.place = {words[k]: rank for rank, k in enumerate(order)}
        self.class_of = np.arange(len(order) + 1)
        for rank, k in enumerate(order[self.own :], self.own):
            c = zlib.crc32(words[k]) % HASHED
            totals[c] += counts[k]
            kinds[c] += 1
            self.class_of[rank] = self.own + c
        self.class_of = self.class_of.astype(np.uint16)
        self.log_of = np.log10(np.array([*(counts[k] for k in order), 0.5]) + 0.5)
        #: log10 of what a hashed class's counts are divided by: its words, and one place for those never seen
        self.divisor = np.log10(totals + 0.5 * (kinds + 1))
        own = np.array([counts[k] for k in order[: self.own]], float)
        share = np.concatenate([own + 0.5, totals + 0.5 * (kinds + 1)])
        self.share = share / share.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Words at or above a count that at most KNOWN words reach, found from a histogram of the counts' logarithms."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    sizes = sorted(((r["level"], r["words"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()), reverse=True)
    tokens, distinct, held, lowest = sum(s[2] for s in sizes), sum(s[1] for s in sizes), 0, None
    for lv, words, _ in sizes:
        if held + words > KNOWN:
            break
        held, lowest = held + words, lv
    frequent = counts.where(level >= lowest) if lowest is not None else counts.where("false")
    got = frequent.toArrow()
    tail = counts.where(level < lowest) if lowest is not None else counts
    by_class = tail.groupBy((F.crc32("word") % HASHED).cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    return Vocabulary(got["word"].to_pylist(), got["n"].to_pylist(), tokens, distinct, {r["c"]: (r["n"], r["k"]) for r in by_class})


_CODED = "row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, inner double, ids binary, tail array<struct<word:binary,times:int>>"


def encode(rows: DataFrame, shared) -> DataFrame:
    """Per text: class ids (unsigned 16-bit), what its known words add to the scores, and its words beyond them."""
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        find, class_of, log_of, own, divisor = v.place.get, v.class_of, v.log_of, v.own, v.divisor
        for batch in batches:
            made = []
            for text in _texts(batch.column(3)):
                words = words_of(text)
                places = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
                ids, logs = class_of[places], log_of[places]
                unknown = np.flatnonzero(places < 0)
                new = [words[k] for k in unknown]
                if new:
                    ids[unknown] = [own + zlib.crc32(w) % HASHED for w in new]
                    logs[unknown] = 0
                shared_class = ids >= own
                inner = float(logs[shared_class].sum() - divisor[ids[shared_class].astype(np.int64) - own].sum())
                tail = [{"word": w, "times": n} for w, n in Counter(new).items()]
                made.append((len(words), len(words) - len(new), float(logs.sum()), inner, ids.tobytes(), tail))
            columns = list(zip(*made)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), tail_type]
            arrays = [*batch.columns[:3], *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "ids", "tail"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(each, _CODED.format(kind=kind))


class Chain:
    """start (states), stay (states x states) and emit (classes + 1 x states; the last row, of ones, stands for padding)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move = start.astype(np.float32), move.astype(np.float32)
        self.emit = np.concatenate([emit, np.ones((1, emit.shape[1]))]).astype(np.float32)


def first_chain(share: np.ndarray, states: int = STATES) -> Chain:
    rng = np.random.default_rng(0)
    emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1)) + np.eye(states) * (STAY - (1 - STAY) / max(1, states - 1))
    return Chain(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _padded(parts: list[np.ndarray], pad: int) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), pad, np.int32)
    for k, p in enumerate(parts):
        out[k, : len(p)] = p
    return np.ascontiguousarray(out.T)


def log_likelihood(chain: Chain, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each whole sequence, by the scaled forward recursion in 64-bit floats; sequences of like length go
    together."""
    pad, out = len(chain.emit) - 1, np.zeros(len(sequences))
    chain_emit, chain_start, chain_move = chain.emit.astype(np.float64), chain.start.astype(np.float64), chain.move.astype(np.float64)
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    for at in range(0, len(order), _PACK):
        group = order[at : at + _PACK]
        lengths = np.array([len(sequences[k]) for k in group])
        ids = _padded([sequences[k] for k in group], pad)
        total = np.zeros(len(group))
        active = np.searchsorted(-lengths, -np.arange(1, len(ids) + 1), side="right")  # longest first
        state = chain_emit[ids[0]] * chain_start
        for t in range(len(ids)):
            n = int(active[t])
            state = chain_emit[ids[t, :n]] * (state[:n] @ chain_move) if t else state
            scale = state.sum(1)
            state /= scale[:, None]
            total[:n] += np.log10(scale)
        out[group] = total
    return out


def expected_counts(chain: Chain, segments: list[np.ndarray], firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (emissions by class, moves, starts) of segments of at most SEGMENT ids, one pass each way."""
    pad, states = len(chain.emit) - 1, chain.emit.shape[1]
    emit, move, start = np.zeros((pad + 1, states)), np.zeros((states, states)), np.zeros(states)
    order = sorted(range(len(segments)), key=lambda k: -len(segments[k]))
    for at in range(0, len(order), _PACK):
        group = order[at : at + _PACK]
        ids = _padded([segments[k] for k in group], pad)
        e = chain.emit[ids]
        forward, scales = np.empty_like(e), np.empty(e.shape[:2] + (1,), np.float32)
        state = e[0] * chain.start
        for t in range(len(ids)):
            state = e[t] * (state @ chain.move) if t else state
            scale = state.sum(1, keepdims=True)
            state = state / scale
            forward[t], scales[t] = state, scale
        after, back = np.empty_like(e), np.ones_like(e[0])
        for t in range(len(ids) - 1, -1, -1):
            after[t] = back
            back = (e[t] * back / scales[t]) @ chain.move.T
        seen = (forward * after).reshape(-1, states)
        flat = ids.ravel()
        for s in range(states):
            emit[:, s] += np.bincount(flat, weights=seen[:, s], minlength=pad + 1)
        real = (ids[1:] != pad)[..., None]
        into = (e[1:] * after[1:] / scales[1:] * real).reshape(-1, states)
        move += (forward[:-1].reshape(-1, states).T @ into) * chain.move
        start += (forward[0] * after[0] * firsts[group][:, None]).sum(0)
    return emit[:pad], move, start


def baum_welch(coded: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Each round, tasks count over their texts' segments and a shuffle by class adds the counts up.

    The model (classes times states numbers, bounded by OWN + HASHED) is all that the driver and each task hold.
    Every training text is used whole; a segment's first word is not linked to the word before it.
    """
    sc, chain = coded.sparkSession.sparkContext, first_chain(share, states)
    sums = [F.sum(F.get("counts", F.lit(s))).alias(f"s{s}") for s in range(states)]
    n = len(share)
    for _ in range(rounds):
        shared = sc.broadcast(chain)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            total = np.zeros((n + states + 1, states))
            for batch in batches:
                segments, firsts = [], []
                for raw in batch.column(0).to_pylist():
                    ids = np.frombuffer(raw, np.uint16)
                    for at in range(0, len(ids), SEGMENT):
                        segments.append(ids[at : at + SEGMENT])
                        firsts.append(at == 0)
                if segments:
                    emit, move, start = expected_counts(model, segments, np.array(firsts))
                    total[:n] += emit
                    total[n : n + states] += move
                    total[n + states] += start
            some = np.flatnonzero(total.any(axis=1))
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * states), pa.array(total[some].ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), counts], names=["class", "counts"])

        got = coded.where("NOT held_out").select("ids").mapInArrow(each, "class int, counts array<float>").groupBy("class").agg(*sums).collect()
        total = np.zeros((n + states + 1, states))
        for r in got:
            total[r["class"]] = r[1:]
        emit = total[:n] + SMOOTH * share[:, None]
        move = total[n : n + states] + 0.1
        start = total[n + states] + 0.1
        chain = Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return chain


def score_texts(docs: DataFrame, held_out, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text (column text).

    Learns from the rows where ``held_out`` (a Column) is false. The chain emits classes: each of the OWN most frequent
    words is one, all other words share HASHED classes; inside a shared class a word has its own smoothed share, exact
    for every word, so ``score`` is the log10 probability of the words themselves. Counts beyond the KNOWN most frequent
    words are joined by word, and only for the texts that hold them.

    Null and blank texts are the end alone. Rows are never merged: repeated rows and null ids score each for itself. With
    no training rows every word is unseen; an empty table gives no rows.
    """
    rows = with_position(docs.select("doc_id", "text"), "row").withColumn("held_out", held_out)
    counts = keep(word_counts(rows.where("NOT held_out")), "word-counts")
    v = vocabulary(counts)
    sc = docs.sparkSession.sparkContext
    coded = keep(encode(rows, sc.broadcast(v)), "coded-texts")
    chain = sc.broadcast(baum_welch(coded, v.share, states, rounds))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(log_likelihood(chain.value, held))], names=["row", "chain"])

        keys, held = [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            held += [np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]
            if sum(map(len, held)) > _HELD:  # more texts at once find more of their own length
                yield scored()
                keys, held = [], []
        yield scored()

    chained = keep(coded.select("row", "ids").mapInArrow(each, "row long, chain double"), "chain-scores")
    tail = coded.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.times").alias("times"))
    tail = tail.join(counts, "word", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known")
    )
    whole = float(np.log10(v.tokens + 0.5 * (v.distinct + 1)))
    found = coded.drop("ids", "tail").join(chained, "row").join(tail, "row", "left").fillna(0, ["tail_log", "tail_known"])
    return found.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.col("tail_known")).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_log") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("chain") + F.col("inner") + F.col("tail_log")).alias("score"),
    )


def op6_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, in the contract's columns; see ``score_texts``."""
    return score_texts(table(spark, sf_dir, "documents"), fold_mod5() == 1)
