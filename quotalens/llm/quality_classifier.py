"""Quality from conditional compression with dictionaries of good and bad text (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, fold_mod5, keep, table

#: Bounds of what is fitted on the driver: labelled rows of a class, pieces (of PIECE bytes) of a class that make its
#: dictionary, dictionary bytes. Rows and pieces are chosen by hashes, pieces from the whole texts.
SAMPLE_ROWS, SAMPLE_PIECES, DICTIONARY_BYTES = 3000, 4000, 112640
PIECE, LEVEL, THRESHOLD = 2000, 3, 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; a few hundred KB at most, whatever was fitted."""

    good: bytes
    bad: bytes
    weights: tuple
    prior: float


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple:
    made = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d))
    return tuple(made)


def _sizes(good: bytes, bad: bytes, texts: list[bytes]) -> np.ndarray:
    """Per text: bytes, compressed bytes with the good dictionary, with the bad one."""
    with_good, with_bad = _compressors(good, bad)
    return np.array([(len(t), len(with_good.compress(t)), len(with_bad.compress(t))) for t in texts], dtype=np.float64).reshape(-1, 3)


def _features(sizes: np.ndarray) -> np.ndarray:
    """The normalised size difference, and what it has to be read against: how far the text compresses, and its length."""
    n, good, bad = sizes.T
    n = np.maximum(n, 1)
    difference = np.clip((bad - good) / n, -0.5, 0.5) * 10
    ratio, length = np.clip(good / n, 0, 1.2), np.log(n + 1) / 10
    return np.stack([np.ones_like(n), difference, ratio, length, difference * ratio, difference * length, ratio * length, difference**2, ratio**2, length**2], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls, so that it cannot run away."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move, size = np.linalg.solve(h, x.T @ (y - p) - ridge * w), 1.0
        while (then := loss(w + size * move)) > now and size > 1e-6:
            size /= 2
        if now - then < 1e-9 * max(1.0, now):
            break
        w, now = w + size * move, then
    return w


def pieces_of(text: bytes) -> list[bytes]:
    """A whole text in pieces of PIECE bytes, the last as long as it is."""
    return [text[a : a + PIECE] for a in range(0, len(text), PIECE)]


def dictionary(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary trained on the pieces; where these are too few or too small, their text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def calibrated(good: bytes, bad: bytes, sizes: np.ndarray, labels: list[int], prior: float) -> Model:
    """The model of two dictionaries and labelled sizes (``_sizes``); without both dictionaries or both labels the prior is all it has."""
    if not good or not bad or len(set(labels)) < 2:
        return Model(b"", b"", (), prior)
    return Model(good, bad, tuple(_logistic(_features(sizes), np.array(labels, np.float64))), prior)


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Fits on texts in memory: the even ones make the dictionaries, the odd ones (all, if those lack a label) the calibration."""
    made = [dictionary([p for t, y in zip(texts[::2], labels[::2]) if y == c for p in pieces_of(t)]) for c in (1, 0)]
    own = slice(1, None, 2) if len(set(labels[1::2])) == 2 else slice(None)
    prior = (sum(labels) + 1) / (len(labels) + 2)
    sizes = _sizes(*made, texts[own]) if all(made) else np.empty((0, 3))
    return calibrated(*made, sizes, labels[own], prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, held_out_fold: int = 0) -> DataFrame:
    """(doc_id, quality, half, text) of at most ``rows`` labelled rows of each class outside the held-out fold, in an order that a
    hash of the id fixes. A text with several labels has the smallest; a document given twice its smallest text; half
    is 0 or 1. The ids are chosen in the labels alone; texts stay whole and in the cluster."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_mod5() != held_out_fold)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order, chosen = F.xxhash64("doc_id"), None
    for c in (0, 1):
        own = usable.where(F.col("quality") == c).orderBy(order, "doc_id").limit(rows)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # 2 * rows ids at most
    return found.select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"), "text")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Half of the labelled rows make the dictionaries, from pieces of their whole texts; the other half the calibration, so
    that no text is scored with itself. The driver gets SAMPLE_PIECES pieces of a class and SAMPLE_ROWS sizes of a class.

    Null texts are empty ones; rows without a label, and labels without a row, teach nothing; repeated rows count each. Without any
    labelled rows every text gets the prior."""
    sample = keep(labelled_sample(docs, labels), "labelled-texts")
    counts = {(r["quality"], r["half"]): r["n"] for r in sample.groupBy("quality", "half").agg(F.count("*").alias("n")).collect()}
    n = {c: counts.get((c, 0), 0) + counts.get((c, 1), 0) for c in (0, 1)}
    prior = (n[1] + 1) / (n[0] + n[1] + 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, made = [], [], []
            for i, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                some = pieces_of(text)
                made += some
                ids += [f"{i}:{k}" for k in range(len(some))]
                kinds += [y] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.int32()), pa.array(made, pa.binary())], names=["place", "quality", "piece"])

    pieces = sample.where("half = 0").select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(cut, "place string, quality int, piece binary")
    made = []
    for c in (1, 0):
        some = pieces.where(F.col("quality") == c).orderBy(F.xxhash64("place"), "place").limit(SAMPLE_PIECES).collect()
        made.append(dictionary([bytes(r["piece"]) for r in some]))
    if not all(made):
        return Model(b"", b"", (), prior)
    second = "half = 1" if all(counts.get((c, 1)) for c in (0, 1)) else "true"

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _sizes(*made, batch.column(1).cast(pa.binary()).to_pylist()).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(x)) for x in sizes]], names=["quality", "n", "good", "bad"])

    got = sample.where(second).select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(sized, "quality int, n double, good double, bad double").orderBy("quality", "n", "good", "bad").collect()
    return calibrated(*made, np.array([r[1:] for r in got], np.float64).reshape(-1, 3), [r["quality"] for r in got], prior)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.prior)
    return 1 / (1 + np.exp(-np.clip(_features(_sizes(model.good, model.bad, texts)) @ np.array(model.weights), -30, 30)))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds ``score`` (double, 0 to 1; higher: label 1 is likelier) from the whole text; every other column passes through.

    A null text scores as the empty one, and equal texts score alike. A model fitted without both labels gives every
    text the smoothed share of label 1. An input column named like the score is replaced; an empty table gives no rows.
    """
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = scores(model, [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(each, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches ``threshold``, with the columns of ``docs``, whatever these are named.

    Null and empty texts have a score like any other; repeated rows stay or go together; an empty table stays empty, and
    without labels of both kinds all rows have the prior's score.
    """
    model = train(docs, labels)
    rows, back = apart(docs, "text")
    return back(score_quality(rows, model, score_col="_quality").where(F.col("_quality") >= threshold))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, in the contract's columns; see ``score_quality``."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_mod5() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
