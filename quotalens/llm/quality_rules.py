"""Quality rules by distribution divergence from language references (operator 5)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

#: Words with at least this share of a language's words are its common words; languages with so many words have a reference, others are not measured.
COMMON_SHARE, LANGUAGE_WORDS, SLACK = 0.001, 20_000, 8
#: Largest Jensen-Shannon distances, from the number of words or characters n: floor + slope / sqrt(n), as a short sample diverges by chance.
WORDS_FLOOR, WORDS_SLOPE, CLASS_FLOOR, CLASS_SLOPE = 0.20, 2.1, 0.22, 1.0
#: Below these lengths (words; characters) a histogram decides nothing.
MIN_WORDS, MIN_CHARS = 50, 200

#: Classes of characters by their first byte: a UTF-8 character counts once, one of U+2000 to U+2FFF (0xE2) as punctuation.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz" + bytes(b for b in range(0xC0, 0x100) if b != 0xE2), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\f", b".,:;?!'\"-()\xe2", b"#*$%&|<>"]
N_CLASSES = len(_CLASSES) + 1
_CLASS_OF = np.full(256, N_CLASSES - 1)
for _k, _of in enumerate(_CLASSES):
    _CLASS_OF[list(_of)] = _k
_CLASS_OF[0x80:0xC0] = N_CLASSES  # inside a character
_SYMBOLS, _SPACES, _INNER = list(b"#*$%&|<>"), list(b" \t\n\r\x0b\f"), list(range(0x80, 0xC0))


def _class_counts(by_byte: np.ndarray) -> np.ndarray:
    return np.bincount(_CLASS_OF, weights=by_byte, minlength=N_CLASSES + 1)[:N_CLASSES].astype(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _rows(schema: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


_PART = [("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("seen", pa.int64()), ("classes", pa.list_(pa.int64()))]
_PART_DDL = "lang string, word binary, n long, seen long, classes array<long>"


def _frequent_parts(share: float):
    """Per task: each language's totals (null word), and its words with at least ``share`` of the words counted so far."""

    def flush(counts: dict, classes: dict) -> pa.RecordBatch:
        rows = []
        for lang, words in counts.items():
            total = sum(words.values())
            rows.append((lang, None, total, 0, classes[lang].tolist()))
            rows += [(lang, w, n, total, None) for w, n in words.items() if n >= share * total]
        return _rows(_PART, rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        classes: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                counts.setdefault(lang, Counter()).update(text.lower().split())
                classes[lang] = classes.get(lang, 0) + _class_counts(np.bincount(np.frombuffer(text, np.uint8), minlength=256))
            if sum(map(len, counts.values())) > 400_000:  # bounds the task's memory
                yield flush(counts, classes)
                counts, classes = {}, {}
        yield flush(counts, classes)

    return each


def _exact_parts(candidates: dict):
    """Per task: exact counts of the candidate words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {lang: Counter() for lang in candidates}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                if lang in counts:
                    known = candidates[lang]
                    counts[lang].update([w for w in text.lower().split() if w in known])
        yield _rows(_PART[:3], [(lang, w, n) for lang, words in counts.items() for w, n in words.items()])

    return each


def language_references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """{language: (common words, their counts and the rest's, class counts)} over all texts of each language with LANGUAGE_WORDS words.

    Two passes give exact counts without shuffling the whole vocabulary. In the first, a task reports a word if it has
    at least an eighth of COMMON_SHARE of what the task has counted; a word can be common only if its reported count,
    plus that eighth of all words in tasks that did not report it, reaches COMMON_SHARE. At most 8 / (7 * COMMON_SHARE)
    words of a language pass this test, and the second pass counts them exactly. So a language takes some 30 KB of the
    driver, and a rare one has the same reference whatever share of the table it is. A null language has none.
    """
    pairs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL")
    low = COMMON_SHARE / SLACK
    parts = pairs.mapInArrow(_frequent_parts(low), _PART_DDL)
    # one aggregation: totals under the null word, reported words under their own
    summed = parts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), *[F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(N_CLASSES)])
    summed = keep(summed, "common-words")
    totals = {r["lang"]: (r["n"], np.array([r[f"c{k}"] for k in range(N_CLASSES)], float)) for r in _large_languages(summed)}
    if not totals:
        return {}
    bound = F.lit(None).cast("double")
    for lang, (n, _) in totals.items():
        bound = F.when(F.col("lang") == lang, F.lit(float(n))).otherwise(bound)
    might = summed.where(F.col("word").isNotNull() & (F.col("n") + low * (bound - F.col("seen")) >= COMMON_SHARE * bound))
    candidates: dict = {lang: set() for lang in totals}
    for r in might.select("lang", "word").collect():
        candidates[r["lang"]].add(bytes(r["word"]))
    exact = pairs.mapInArrow(_exact_parts(candidates), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    common: dict = {lang: {} for lang in totals}
    for r in exact.collect():
        if r["n"] >= COMMON_SHARE * totals[r["lang"]][0]:
            common[r["lang"]][bytes(r["word"])] = r["n"]
    found = {}
    for lang, (n, classes) in totals.items():
        words = sorted(common[lang], key=lambda w: (-common[lang][w], w))
        counts = np.array([common[lang][w] for w in words] + [0], float)
        counts[-1] = n - counts.sum()
        found[lang] = ({w: k for k, w in enumerate(words)}, counts, classes)
    return found


def _large_languages(summed: DataFrame) -> list:
    return summed.where(F.col("word").isNull() & (F.col("n") >= LANGUAGE_WORDS)).collect()


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; 0 if either histogram is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    return float(np.sqrt(max(0.0, ((p[a] * np.log2(p[a] / m[a])).sum() + (q[b] * np.log2(q[b] / m[b])).sum()) / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    v = len(known)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows) + 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return int((again | np.concatenate([[False], again[:-1]]) | np.concatenate([[False, False], again[:-2]])).sum())


_OUT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("word_distance", pa.float64()), ("class_distance", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]


def judge(text: bytes, reference: tuple | None) -> tuple:
    """One text's counts, distances and verdict; see ``apply_rules``."""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    repeated = repeated_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    of_words = of_classes = 0.0
    if reference:
        at, counts, classes = reference
        own = np.zeros(len(counts))
        for w, k in Counter(text.lower().split()).items():
            own[at.get(w, -1)] += k
        of_words = js_distance(own, counts)
        of_classes = js_distance(_class_counts(by_byte), classes)
    chars = len(text) - int(by_byte[_INNER].sum())
    far = n >= MIN_WORDS and of_words > WORDS_FLOOR + WORDS_SLOPE / np.sqrt(n)
    far |= chars >= MIN_CHARS and of_classes > CLASS_FLOOR + CLASS_SLOPE / np.sqrt(chars)
    word_chars = len(text) - int(by_byte[_INNER].sum() + by_byte[_SPACES].sum())
    return n, word_chars, int(by_byte[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated, of_words, of_classes, failed, not failed and not far


def apply_rules(docs: DataFrame, references: dict, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Counts, Jensen-Shannon distances and verdict of every row's whole text.

    A text is dropped if it fails the base rules, or if its common-word or character-class histogram lies farther from
    its language's reference than a sample of its length should; a text below the minimum length of a histogram is not
    judged by it. A text of a null language, or of one without a reference, is judged by the base rules alone. A null text
    counts as empty (and fails on length); repeated rows are judged alike; an empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, references.get(lang)) for lang, t in zip(batch.column(1).to_pylist(), _texts(batch.column(2)))]
            made = _rows(_OUT, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=[id_col, *made.schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, word_distance double, class_distance double, base_failed boolean, kept boolean"
    return docs.select(id_col, F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(each, f"`{id_col}` {kind}, {ddl}")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, in the contract's columns, the distances after them; see ``apply_rules``."""
    docs = table(spark, sf_dir, "documents")
    found = apply_rules(docs, language_references(docs))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_distance", "class_distance")
