"""Secret scans: named patterns, and a battery of randomness tests with false-discovery control (operator 10, native)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table, with_position

#: Fixed patterns of the base spans. A run of hex digits or of an access key is taken whole, so its least length can stand in the pattern; an assignment's cannot.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6

#: Runs that may be an encoded secret; kinds in the order in which they are listed.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings that a run's characters can imply, narrowest first, with the share of ordinary text's characters that the alphabet holds.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS, 1.0),
    (r"^[0-9a-f]+$", _DIGITS + _LOWER[:6], 0.35),
    (r"^[0-9A-F]+$", _DIGITS + _UPPER[:6], 0.35),
    (r"^[A-Z2-7]+$", _UPPER + _DIGITS[2:8], 1.0),
    (r"^[a-z0-9]+$", _LOWER + _DIGITS, 1.0),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 1.0),
    (r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 1.0),
    (r"", _UPPER + _LOWER + _DIGITS + "-_+/", 1.0),
)
#: Chance that two characters of ordinary text are equal; a random string's is one over its alphabet.
TEXT_MATCH = 0.065
#: A run is not random if a test of the battery gives its outcome less than this chance.
TEST_LEVEL = 0.001
#: Accepted share of ordinary runs among those found, and the bins of -log10 p in which runs are ranked.
FALSE_SHARE, BIN, BINS = 0.01, 0.02, 4000


def matches(docs: DataFrame, text: Column) -> DataFrame:
    """Per row and kind, the matches and the lengths of the text between them (one more); empty where nothing matches."""
    columns = []
    for kind, pattern in KINDS.items():
        hit = text.rlike(pattern)
        columns.append(F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(kind))
        columns.append(F.when(hit, F.transform(F.split(text, pattern, -1), F.char_length)).alias(f"{kind}_gaps"))
    return docs.select("row", "doc_id", *columns)


def spans(found: DataFrame) -> DataFrame:
    """(row, kind int, start, end, token) of every match, in code points: running sums of gaps and matches place them."""
    parts = None
    for k, kind in enumerate(KINDS):
        zipped = F.arrays_zip(F.col(kind).alias("token"), F.slice(f"{kind}_gaps", F.lit(1), F.size(kind)).alias("gap"))
        own = found.where(F.col(kind).isNotNull()).select("row", F.lit(k).alias("kind"), F.posexplode(zipped).alias("nth", "m"))
        own = own.select("row", "kind", "nth", "m.token", (F.col("m.gap") + F.char_length("m.token")).cast("long").alias("_step"))
        parts = own if parts is None else parts.unionByName(own)
    upto = Window.partitionBy("row", "kind").orderBy("nth")
    placed = parts.withColumn("end", F.sum("_step").over(upto))
    placed = placed.withColumn("start", F.col("end") - F.char_length("token"))
    value = F.char_length(F.regexp_extract("token", ASSIGN, 2))
    return placed.where((F.col("kind") != 0) | (value >= ASSIGN_VALUE)).select("row", "kind", "start", "end", "token")


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z of either sign; relative error below 1e-5 into the far tail."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, 1 - tail).otherwise(tail)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once: a lambda over an array of one."""
    return F.transform(F.array(value), body)[0]


def battery(token: Column) -> Column:
    """struct<uniform_p, runs_p, serial_p, text_p> of one run of characters.

    The encoding is the narrowest alphabet that holds all characters. uniform_p: upper tail of chi-squared against the
    uniform alphabet (Wilson-Hilferty); runs_p: Wald-Wolfowitz about the alphabet's middle; serial_p: lag-1 correlation
    of alphabet places. text_p bounds the chance that ordinary text of the same length looks as uniform: there chi-squared
    is noncentral, by the length times (alphabet * TEXT_MATCH - 1), so a short run cannot reach a small chance; an
    alphabet that holds only part of ordinary text's characters multiplies it by that share for each character.
    """

    def encoding(t: Column) -> Column:
        alphabet, share = F.lit(ENCODINGS[-1][1]), F.lit(1.0)
        for pattern, chars, part in reversed(ENCODINGS[:-1]):
            fits = t.rlike(pattern)
            alphabet, share = F.when(fits, F.lit(chars)).otherwise(alphabet), F.when(fits, F.lit(part)).otherwise(share)
        places = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
        mixed = t.rlike("[0-9]") & t.rlike("[A-Za-z]")
        return F.struct(places.alias("at"), F.char_length(t).cast("double").alias("n"), F.char_length(alphabet).cast("double").alias("a"), share.alias("share"), mixed.alias("mixed"))

    def counted(e: Column) -> Column:
        # sums of squared counts from the sorted places; runs and products of neighbours from the places as they stand
        start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("sum"))
        equal = F.aggregate(
            F.array_sort(e["at"]), start,
            lambda s, x: F.when(x == s["last"], F.struct(x.alias("last"), (s["run"] + 1).alias("run"), (s["sum"] + 2.0 * s["run"] + 1.0).alias("sum"))).otherwise(
                F.struct(x.alias("last"), F.lit(1).cast("long").alias("run"), (s["sum"] + 1.0).alias("sum"))
            ),
            lambda s: s["sum"],
        )
        mean = F.aggregate(e["at"], F.lit(0).cast("long"), lambda s, x: s + x) / e["n"]
        return F.struct(e.alias("e"), equal.alias("equal"), mean.alias("mean"))

    def walked(c: Column) -> Column:
        half, mean = c["e"]["a"] / 2, c["mean"]
        zero = F.lit(0.0)
        start = F.struct(F.lit(None).cast("int").alias("last"), zero.alias("runs"), zero.alias("low"), zero.alias("cross"), zero.alias("square"))
        walk = F.aggregate(
            c["e"]["at"], start,
            lambda s, x: F.struct(
                x.alias("last"),
                (s["runs"] + F.when(s["last"].isNull() | ((s["last"] < half) != (x < half)), 1.0).otherwise(0.0)).alias("runs"),
                (s["low"] + F.when(x < half, 1.0).otherwise(0.0)).alias("low"),
                (s["cross"] + F.when(s["last"].isNull(), 0.0).otherwise((s["last"] - mean) * (x - mean))).alias("cross"),
                (s["square"] + (x - mean) * (x - mean)).alias("square"),
            ),
        )
        return F.struct(c["e"].alias("e"), c["equal"].alias("equal"), walk.alias("walk"))

    def chances(k: Column) -> Column:
        n, a, low = k["e"]["n"], k["e"]["a"], k["walk"]["low"]
        freedom = a - 1
        chi = k["equal"] * a / n - n
        uniform_z = (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, 1 / 3) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
        expected = 1 + 2 * low * (n - low) / n
        runs_z = F.when(expected > 2, (k["walk"]["runs"] - expected) / F.sqrt((expected - 1) * (expected - 2) / (n - 1))).otherwise(F.lit(37.0))
        serial_z = F.when(k["walk"]["square"] > 0, k["walk"]["cross"] / k["walk"]["square"] * F.sqrt(n)).otherwise(F.lit(37.0))
        shift = n * F.greatest(a * TEXT_MATCH - 1, F.lit(0.0))
        text_z = (freedom + shift - chi) / F.sqrt(2 * (freedom + 2 * shift))
        match_p = F.when(shift > 0, _upper_tail(text_z)).otherwise(F.lit(1.0))
        part_p = F.when(k["e"]["mixed"], F.pow(k["e"]["share"], n)).otherwise(F.lit(1.0))
        return F.struct(_upper_tail(uniform_z).alias("uniform_p"), (2 * _upper_tail(F.abs(runs_z))).alias("runs_p"), (2 * _upper_tail(F.abs(serial_z))).alias("serial_p"), (match_p * part_p).alias("text_p"))

    return _let(encoding(token), lambda e: _let(counted(e), lambda c: _let(walked(c), chances)))


def discovery_level(token: Column) -> Column:
    """The bin of -log10 text_p of a run that passes the battery, -1 of any other."""
    level = lambda p: F.least(F.floor(-F.log10(F.greatest(p["text_p"], F.lit(1e-300))) / BIN), F.lit(BINS)).cast("int")
    return _let(battery(token), lambda p: F.when(F.least(p["uniform_p"], p["runs_p"], p["serial_p"]) >= TEST_LEVEL, level(p)).otherwise(F.lit(-1)))


def discovery_bin(tested: DataFrame) -> int | None:
    """Benjamini-Hochberg over all tested runs: the lowest bin of -log10 text_p whose runs are accepted; None if no bin is.

    Ranks come from counts of at most BINS bins, a run counting with its bin's largest chance.
    """
    counts = {r["bin"]: r["n"] for r in tested.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    total, rank, found = sum(counts.values()), 0, None
    for b in sorted((b for b in counts if b >= 0), reverse=True):
        rank += counts[b]
        if 10 ** (-b * BIN) * total <= FALSE_SHARE * rank:
            found = b
    return found


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, found array<struct<start, kind int, end>>) for every row of ``docs`` (doc_id, text), whole texts.

    Kinds 0 to 2 are the named patterns; kind 3 a run that passes the battery, is accepted at FALSE_SHARE and does not
    lie inside a span of the named patterns. A null text counts as empty; null and repeated ids keep one row each, an
    empty table gives none. One text's matches are the largest group that a task sorts.
    """
    rows = with_position(docs.select("doc_id", "text"), "row")
    found = keep(matches(rows, F.coalesce("text", F.lit(""))), "matches")
    placed = spans(found)
    tested = keep(placed.where("kind = 3").select("row", "kind", "start", "end", discovery_level(F.col("token")).alias("bin")), "tested-runs")
    lowest = discovery_bin(tested)
    everything = placed.where("kind < 3").select("row", "kind", "start", "end").unionByName(
        tested.where(F.col("bin") >= (lowest if lowest is not None else BINS + 1)).select("row", "kind", "start", "end")
    )
    per_row = everything.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    # in the order of starts, a span is inside an earlier one if that one's end, kept as a running maximum, reaches its end
    per_row = per_row.withColumn("_base", F.expr("filter(found, s -> s.kind < 3)"))
    covered = "exists(_base, b -> b.start <= s.start AND b.end >= s.end)"
    per_row = per_row.select("row", F.expr(f"filter(found, s -> s.kind < 3 OR NOT {covered})").alias("found"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.select("row", "doc_id").join(per_row, "row", "left").select("row", "doc_id", F.coalesce("found", empty).alias("found"))


def _listed(spans: str) -> str:
    names = " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(KINDS))
    return f"array_join(transform({spans}, s -> concat_ws(':', CASE s.kind {names} END, s.start, s.end)), ',')"


def _replaced(text: Column, pattern: str, value) -> Column:
    """``text`` with every match of ``pattern`` replaced by ``value`` of it: the texts between matches and the values, joined."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.concat(gap, F.coalesce(value(m), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced by ``mark``; rows and all columns stay, a text without secrets too.

    A first pass over the texts only counts runs by their bin of chances, which gives the bin that false-discovery control
    accepts; the second replaces matches inside each row: the named patterns in the order of KINDS, then accepted runs of
    what is left. So no text is shuffled or written. Null texts stay null, repeated rows are treated alike, an empty
    table stays empty.
    """
    text = F.col(text_col)
    runs = docs.where(text.rlike(CANDIDATE)).select(F.explode(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("token"))
    lowest = discovery_bin(runs.select(discovery_level(F.col("token")).alias("bin")))
    made = _replaced(text, ASSIGN, lambda m: F.when(F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE, mark).otherwise(m))
    made = F.regexp_replace(F.regexp_replace(made, ACCESS, mark), HEX, mark)
    made = docs.withColumn(text_col, made)
    if lowest is None:
        return made
    return made.withColumn(text_col, _replaced(text, CANDIDATE, lambda m: F.when(discovery_level(m) >= lowest, mark).otherwise(m)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document, in the contract's columns; see ``scan``."""
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(KINDS) if k < 3]
    return found.select("doc_id", *counts, F.sha2(F.expr(_listed("filter(found, s -> s.kind < 3)")), 256).alias("base_sha256"), F.expr(_listed("found")).alias("spans"))
