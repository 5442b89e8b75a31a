"""Benchmark decontamination by template windows with slot consistency (operator 3, native)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, keep, table

#: Words of a window, plain words that it must have at least, the share of an item's windows that must be found in a band of shifts, the windows below which all must be, and half the width of a band.
WINDOW, PLAIN, SHARE, FEW, BAND = 5, 3, 0.5, 4, 8
#: Ways to read a text: names are slots; names are plain words (lower-cased copies); numbers and units are plain words as well.
NAMES, WORDS, EXACT = 0, 1, 2
#: Marks of a number, a name, a unit, and of a separator inside a number; all are private-use characters.
NUMBER, NAME, UNIT, INNER = "\ue000", "\ue001", "\ue002", "\ue003"
#: Units that count as a slot when they follow a number.
UNITS = (
    "mm cm m km in ft yd mi inches inch feet foot yards yard miles mile meters metres meter metre kilometers kilometres "
    "mg g kg lb lbs oz grams gram kilograms kilogram pounds pound ounces ounce tons ton ml l liters litres liter litre gallons gallon "
    "ms s sec seconds second min minutes minute h hr hours hour days day weeks week months month years year "
    "km/h mph kmh c f k celsius fahrenheit degrees degree w kw kwh v volts watts joules j n pa hz khz mhz ghz kb mb gb tb bytes bits "
    "usd eur gbp dollars dollar euros euro cents cent percent"
).split()
_WORD = rf"[^\p{{L}}\p{{N}}{NUMBER}-{INNER}]+"
_UNIT_AFTER = rf"({NUMBER}[0-9{INNER}]*\x20{{1,3}})({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{N}}])"


def _marked(text: Column, values: bool, names: bool) -> Column:
    """Text with every number, name and unit as a mark of its own, followed by its value if ``values``."""
    value = "$0" if values else ""
    clean = F.translate(text, NUMBER + NAME + UNIT + INNER, "    ")
    named = F.regexp_replace(clean, r"(?<!\p{L})\p{Lu}\p{L}+", f" {NAME}{value} ") if names else clean
    joined = F.regexp_replace(named, "(?<=[0-9])[.,:/](?=[0-9])", INNER)
    numbered = F.regexp_replace(joined, f"[0-9][0-9{INNER}]*", f" {NUMBER}{value} ")
    united = F.regexp_replace(numbered, "(?i)" + _UNIT_AFTER, f"$1{UNIT}{'$2' if values else ''}")
    return F.when(text.rlike("[0-9]"), united).otherwise(named)


def _tokens(text: Column, values: bool = False, names: bool = True) -> Column:
    return F.filter(F.split(F.lower(_marked(text, values, names)), _WORD), lambda w: w != "")


def _windows(tokens: Column, way: int, width: int = WINDOW) -> Column:
    """Hashes of all windows of an array of tokens; a shorter text is one window, one without words none.

    ``transform`` over one element names the tokens, so they are made once.
    """
    return F.transform(
        F.array(tokens),
        lambda t: F.when(
            F.size(t) >= width,
            F.transform(F.sequence(F.lit(0), F.size(t) - width), lambda i: F.xxhash64(F.lit(way), *[F.get(t, i + k) for k in range(width)])),
        )
        .when(F.size(t) > 0, F.array(F.xxhash64(F.lit(way), F.array_join(t, " "))))
        .otherwise(F.array().cast("array<bigint>")),
    )[0]


def benchmark_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, way, width, template, slots, n) per item and way, and (hash, item_id, way, at) per window; n counts these.

    The first two ways have windows with PLAIN plain words. An item with less than FEW of them is also searched as it
    stands, over all windows, whose width is the item's own if it is shorter than a window.
    """
    text = F.coalesce("text", F.lit(""))
    ways = [items.select("item_id", F.lit(way).alias("way"), _tokens(text, False, way == NAMES).alias("template"), _tokens(text, True, way == NAMES).alias("slots")) for way in (NAMES, WORDS)]
    known = ways[NAMES].unionByName(ways[WORDS]).where("size(template) > 0").withColumn("width", F.least(F.lit(WINDOW), F.size("template")))
    plain = f"size(filter(slice(template, at + 1, {WINDOW}), w -> ascii(w) NOT BETWEEN 57344 AND 57346)) >= least({PLAIN}, size(template))"
    made = F.when(F.col("way") == NAMES, _windows(F.col("template"), NAMES)).otherwise(_windows(F.col("template"), WORDS))
    windows = keep(known.select("item_id", "way", "template", F.posexplode(made).alias("at", "hash")).where(F.expr(plain)).select("hash", "item_id", "way", "at"), "benchmark-plain-windows")
    enough = windows.where(F.col("way") == WORDS).groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= FEW)
    exact = known.where((F.col("way") == WORDS) & ((F.col("width") == WINDOW) | (F.col("width") == F.size("template")))).join(enough, "item_id", "left_anti").withColumn("way", F.lit(EXACT))
    made = F.lit(None).cast("array<bigint>")
    for width in range(1, WINDOW + 1):
        made = F.when(F.col("width") == width, _windows(F.col("slots"), EXACT, width)).otherwise(made)
    windows = windows.unionByName(exact.select("item_id", "way", F.posexplode(made).alias("at", "hash")).select("hash", "item_id", "way", "at"))
    sizes = windows.groupBy("item_id", "way").agg(F.count("*").alias("n"))
    return keep(known.unionByName(exact).join(sizes, ["item_id", "way"]), "benchmark-items"), keep(windows, "benchmark-windows")


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """Pairs (doc_id, _text_hash, item_id, windows, share, same_values) of texts that hold an item, re-parameterised or not.

    A first pass over all windows of all texts only asks whether a window is any item's (hash join with the items'
    windows: a broadcast if Spark finds them small enough, else a shuffle of hashes). Texts with such a window are read
    again, and their windows joined with place: an item is held if SHARE of its windows (all, if it has less than FEW)
    lie within a band of BAND shifts, so words may come in, go or change in between, and if each of its numbers, names
    and units in these windows stands for one value of the text throughout; two may stand for the same.

    Texts are read with capitalised words as slots, and with names as plain words, which finds lower-cased copies. Items
    with less than FEW plain windows are also found as they stand, numbers included, however short they are.

    A text is known by its id and hash, so equal rows give one pair; null ids are kept apart by their text. Null and
    empty texts and items hold nothing; empty tables give no pairs; other columns are not read.
    """
    known, windows = benchmark_windows(items)
    widths = sorted(r["width"] for r in known.where(F.col("way") == EXACT).select("width").distinct().collect())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("_text_hash"))
    text = F.col("text")
    every = [_windows(_tokens(text), NAMES), _windows(_tokens(text, False, False), WORDS), *[_windows(_tokens(text, True, False), EXACT, w) for w in widths]]
    hashes = rows.select("doc_id", "_text_hash", F.explode(F.concat(*every)).alias("hash"))
    hit = keep(hashes.join(windows.select("hash").distinct(), "hash", "left_semi").select("doc_id", "_text_hash").distinct(), "texts-with-windows")
    same = rows["doc_id"].eqNullSafe(hit["doc_id"]) & (rows["_text_hash"] == hit["_text_hash"])
    suspects = rows.join(hit, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    suspects = keep(
        suspects.select("doc_id", "_text_hash", _tokens(text).alias("words"), _tokens(text, False, False).alias("plain"), F.array(_tokens(text, True), _tokens(text, True, False)).alias("values")), "suspects"
    )
    placed = [suspects.select("doc_id", "_text_hash", F.posexplode(_windows(F.col(c), way)).alias("_at", "hash")) for c, way in (("words", NAMES), ("plain", WORDS))]
    placed += [suspects.select("doc_id", "_text_hash", F.posexplode(_windows(F.col("values")[WORDS], EXACT, w)).alias("_at", "hash")) for w in widths]
    found = reduce(DataFrame.unionByName, placed).join(windows, "hash").withColumn("shift", F.col("_at") - F.col("at"))
    found = found.withColumn("band", F.explode(F.expr(f"array(floor(shift / {BAND}), floor(shift / {BAND}) + 1)")))
    by_band = ["doc_id", "_text_hash", "item_id", "way", "band"]
    line = found.groupBy(*by_band).agg(F.collect_set(F.struct("at", "shift")).alias("_found"), F.mode("shift", True).alias("_mode"))
    # each window of the item once, where it lies nearest to most others
    line = line.withColumn(
        "_found",
        F.expr("filter(_found, f -> NOT exists(_found, g -> g.at = f.at AND (abs(g.shift - _mode) < abs(f.shift - _mode) OR abs(g.shift - _mode) = abs(f.shift - _mode) AND g.shift < f.shift)))"),
    )
    line = line.withColumn("windows", F.size("_found").cast("bigint")).join(known, ["item_id", "way"])
    line = line.where(F.col("windows") >= F.when(F.col("n") < FEW, F.col("n")).otherwise(share * F.col("n")))
    s, l = suspects.select("doc_id", "_text_hash", "values").alias("s"), line.alias("l")
    both = l.join(s, F.col("l.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("l._text_hash") == F.col("s._text_hash"))).select("l.*", F.col("values")[F.least("way", F.lit(WORDS))].alias("values"))
    both = both.withColumn(
        "_pairs",
        F.expr(
            """array_distinct(flatten(transform(_found, f -> transform(
                    filter(sequence(f.at, f.at + width - 1), i -> ascii(template[i]) BETWEEN 57344 AND 57346),
                    i -> named_struct('ours', slots[i], 'theirs', values[i + f.shift])))))"""
        ),
    )
    both = both.where("size(_pairs) = size(array_distinct(_pairs.ours))").select("doc_id", "_text_hash", "item_id", "windows", (F.col("windows") / F.col("n")).alias("share"), F.expr("forall(_pairs, p -> p.ours = p.theirs)").alias("same_values"))
    return both.groupBy("doc_id", "_text_hash", "item_id").agg(F.max("windows").alias("windows"), F.max("share").alias("share"), F.max("same_values").alias("same_values"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns stay as they are, whatever they are named.

    Null and empty texts hold none and stay; repeated rows stay or go together; empty tables are left as they are.
    """
    rows, back = apart(docs, "doc_id", "text")
    held = keep(leaks(rows, items).select(F.col("doc_id").alias("_held"), "_text_hash").distinct(), "leaks")
    return back(rows.join(held, rows["doc_id"].eqNullSafe(held["_held"]) & (F.xxhash64(F.coalesce(rows["text"], F.lit(""))) == held["_text_hash"]), "left_anti"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that they hold; see ``leaks``."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "share", "same_values")
