"""How far sources of a language differ in their terms: common terms in dense tiles, rare ones by postings (operator 12)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Documents that a kept term is in, terms a group reports, smoothing, parts that proportions are counted in.
LEAST_DOCUMENTS, TOP_TERMS, SMOOTHING, PARTS = 30, 50, 5, 1_000_000_000
#: A term in at most one of so many groups of its language is rare. Groups and terms of a dense tile. Counts a task holds before it gives them.
RARE, TILE_GROUPS, TILE_TERMS, HELD_COUNTS = 8, 128, 1024, 200_000
#: Bytes that belong to no term become blanks, and A-Z small; all bytes of other characters are 0x80 and more.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents of the group it is in."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Counter]] = {}

        def given() -> pa.RecordBatch:
            columns = [[], [], [], [], []]
            for (lang, source), (n, in_docs) in held.items():
                for column, values in zip(columns, ([lang] * len(n), [source] * len(n), n, n.values(), map(in_docs.__getitem__, n))):
                    column.extend(values)
            text = pa.array(columns[2], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), text, pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                words = Counter(text.translate(_TERM_BYTES).split(b" "))
                words.pop(b"", None)
                n, in_docs = held.setdefault((lang, source), [Counter(), Counter()])
                n.update(words)
                in_docs.update(words.keys())
            if sum(len(n) for n, _ in held.values()) > HELD_COUNTS:
                yield given()
                held.clear()
        yield given()

    parts = docs.mapInArrow(each, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> str:
    """1 + floor(PARTS * (count + 5) / (total + 5 terms)), in exact decimals: PARTS times a count passes 2^63 beyond 9 * 10^9."""
    return f"1 + cast((cast({count} + {SMOOTHING} AS decimal(20, 0)) * {PARTS}) div cast({total} + {SMOOTHING} * {terms} AS decimal(20, 0)) AS long)"


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tiles (lang, tb, gi, gj, term, g, p, own), sorted by tile: (lang, g, h, value): the sums over the terms its
    groups have of the differences of these groups, less those of groups that lack them. A row without a term gives the share of terms
    that the group lacks."""

    def of(run: pd.DataFrame) -> pa.RecordBatch:
        lang, gi, gj = run[["lang", "gi", "gj"]].iloc[0]
        absent = run[run["term"].isna()].sort_values("g")
        groups, block = absent["g"].to_numpy(), absent["own"].to_numpy()
        posted = run[run["term"].notna()]
        terms, names = pd.factorize(posted["term"])
        lacking = absent["p"].to_numpy()
        dense = np.repeat(lacking[:, None], len(names), axis=1)
        dense[np.searchsorted(groups, posted["g"].to_numpy()), terms] = posted["p"].to_numpy()
        left, right = np.flatnonzero(block == gi), np.flatnonzero(block == gj)
        sums = [np.abs(dense[right] - dense[i]).sum(axis=1) - len(names) * np.abs(lacking[right] - lacking[i]) for i in left]
        sums = np.array(sums, np.int64).reshape(len(left), len(right))
        a, b = np.repeat(groups[left], len(right)), np.tile(groups[right], len(left))
        once = a < b
        return pa.RecordBatch.from_arrays([pa.array([lang] * int(once.sum()), pa.string()), *map(pa.array, (a[once], b[once], sums.ravel()[once]))], names=["lang", "g", "h", "value"])

    held = None
    for batch in batches:
        new = batch.to_pandas()
        held = new if held is None else pd.concat([held, new], ignore_index=True)
        key = held[["lang", "tb", "gi", "gj"]]
        starts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
        for lo, hi in zip(starts, starts[1:]):
            yield of(held.iloc[lo:hi])
        if len(starts):
            held = held.iloc[starts[-1] :]  # the last tile may go on in the next batch
    if held is not None and len(held):
        yield of(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings (lang, term, g, p, p0) of rare terms, sorted by term: (lang, g, h, value): for groups that share a term, what their
    difference is more than the three that are summed without regard to sharing."""

    def of(run: pd.DataFrame) -> pa.RecordBatch:
        lang, term, g, p, p0 = (run[c].to_numpy() for c in ("lang", "term", "g", "p", "p0"))
        found, at, step = [], np.arange(len(run)), 0
        while len(at):
            step += 1
            at = at[at + step < len(run)]
            at = at[(term[at] == term[at + step]) & (lang[at] == lang[at + step])]
            o = at + step
            value = np.abs(p[at] - p[o]) - np.abs(p[at] - p0[o]) - np.abs(p[o] - p0[at]) + np.abs(p0[at] - p0[o])
            found.append(pd.DataFrame({"lang": lang[at], "g": np.minimum(g[at], g[o]), "h": np.maximum(g[at], g[o]), "value": value}))
        sums = pd.concat(found).groupby(["lang", "g", "h"], as_index=False)["value"].sum()
        return pa.RecordBatch.from_arrays([pa.array(sums["lang"].tolist(), pa.string()), *(pa.array(sums[c].to_numpy(np.int64)) for c in ("g", "h", "value"))], names=["lang", "g", "h", "value"])

    held = None
    for batch in batches:
        new = batch.to_pandas()
        held = new if held is None else pd.concat([held, new], ignore_index=True)
        if len(held):
            last = ((held["term"] != held["term"].iloc[-1]) | (held["lang"] != held["lang"].iloc[-1])).to_numpy()
            whole = np.flatnonzero(last)[-1] + 1 if last.any() else 0
            if whole:
                yield of(held.iloc[:whole])
                held = held.iloc[whole:]
    if held is not None and len(held):
        yield of(held)


def _pair_parts(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, g, h, value), g < h: parts that add up to the sum over all kept terms of the differences of two groups' shares.

    With a group's share p of a term it has and p0 of one it lacks: all kept terms as if both lacked them, |p0 - p0'| each; for common
    terms what they really differ by beyond that, from dense tiles of TILE_GROUPS by TILE_GROUPS groups and about TILE_TERMS terms; for each
    posting of a rare term what it adds if the other group lacks the term, |p - p0'| - |p0 - p0'|, which depends on p0' alone and comes from running
    sums over a group's distinct shares; for two postings of a rare term the correction of ``_shared``. A rare term is in at most
    1 / RARE of its language's groups.
    """
    common = postings.where("NOT rare").selectExpr("lang", f"pmod(xxhash64(term), ceil(v / {TILE_TERMS})) AS tb", "term", "g", "p", "s")
    absent = groups.where("v > 0").selectExpr("lang", f"explode(sequence(0L, ceil(v / {TILE_TERMS}) - 1)) AS tb", "CAST(NULL AS string) AS term", "g", "p0 AS p", "s")
    tiles = common.unionByName(absent).selectExpr("*", f"g div {TILE_GROUPS} AS own", f"explode(sequence(0L, (s - 1) div {TILE_GROUPS})) AS other")
    tiles = tiles.selectExpr("lang", "tb", "least(own, other) AS gi", "greatest(own, other) AS gj", "term", "g", "p", "own")
    key = ["lang", "tb", "gi", "gj"]
    kind = "lang string, g long, h long, value long"
    dense = tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(_dense, kind)

    rare = postings.where("rare")
    shared = rare.where("m > 1").select("lang", "term", "g", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_shared, kind)

    a, b = groups.select("lang", "g", "p0", "v"), groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("at"))
    asked = a.join(b, "lang").where("g != h").selectExpr("lang", "g", "p0", "h", "at", "0L AS n", "0L AS total", "v")
    shares = rare.groupBy("lang", "g", "p0", "p").agg(F.count("*").alias("n"))
    shares = shares.selectExpr("lang", "g", "p0", "CAST(NULL AS long) AS h", "p AS at", "n", "n * p AS total", "0L AS v")
    one = Window.partitionBy("lang", "g")
    below = one.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"n_low": F.sum("n").over(below), "low": F.sum("total").over(below), "n_all": F.sum("n").over(one), "all": F.sum("total").over(one)}
    single = asked.unionByName(shares).withColumns(sums).where("h IS NOT NULL")
    alone = "at * n_low - low + all - low - at * (n_all - n_low) - n_all * abs(p0 - at) + if(g < h, v * abs(p0 - at), 0L)"
    return dense.unionByName(shared).unionByName(single.selectExpr("lang", "least(g, h) AS g", "greatest(g, h) AS h", f"{alone} AS value"))


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source), in the contract's words (operator 12).

    Shares are whole numbers from exact decimals, sums are of longs; the order of rows never matters. Null text, lang and source are
    empty ones; a group without terms has the share of absent terms everywhere; a language without kept terms has pairs of value 0
    and no terms; a language of one source has no pairs. Repeated rows are documents of their own. Ties go by the item. An empty
    table gives no rows; other columns are not read.

    Counts are added up inside tasks first, so a group or term that holds a third of all rows reaches a later task as one row a task
    (or HELD_COUNTS counts). Everything after is as large as the kept terms times the groups they are in, or the pairs reported.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(term), "m": F.count("*").over(term), "in_lang": F.sum("n").over(term), "k": F.row_number().over(term.orderBy("source"))})
    counts = keep(counts.where(F.col("in_docs") >= least_documents).select("lang", "source", "term", "n", "in_lang", "m", (F.col("k") == 1).cast("int").alias("once")), "kept-terms")

    groups = docs.select("lang", "source").distinct().withColumns({"g": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1, "s": F.count("*").over(Window.partitionBy("lang"))})
    in_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    in_lang = counts.groupBy("lang").agg(F.sum("once").alias("v"), F.sum("n").alias("n_lang"))
    groups = groups.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").fillna(0, ["n_group", "v", "n_lang"])
    groups = keep(groups.withColumn("p0", F.expr(f"if(v > 0, {_share('0L', 'n_group', 'v')}, 0L)")), "divergence-groups")

    postings = counts.join(groups.select("lang", "source", "g", "s", "v", "n_group", "n_lang", "p0"), ["lang", "source"])
    postings = postings.withColumns({"p": F.expr(_share("n", "n_group", "v")), "q": F.expr(_share("in_lang", "n_lang", "v")), "rare": F.expr(f"m * {RARE} <= s")})
    postings = keep(postings.select("lang", "source", "term", "g", "s", "v", "m", "p0", "p", "q", "rare"), "divergence-postings")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = postings.where("p > q").selectExpr("lang", "source", "'term' AS part", "term AS item", "p - q AS value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    pairs = _pair_parts(groups, postings).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    both = pairs.selectExpr("lang", "value", "explode(array(struct(g AS g, h AS h), struct(h AS g, g AS h))) AS x").selectExpr("lang", "value", "x.g", "x.h")
    both = both.join(groups.select("lang", "g", "source"), ["lang", "g"]).join(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    both = both.selectExpr("lang", "source", "'pair' AS part", "item", "value").withColumn("rank", F.row_number().over(ranked))
    return both.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms each source has most in excess; see ``source_divergence``."""
    return source_divergence(table(spark, sf_dir, "documents"))


#: DuckDB: every kept term of every group, and all pairs of groups term by term.
ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce("text", '') AS txt FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS n_lang FROM kept GROUP BY lang),
grps AS (SELECT lang, source, coalesce(sum(n), 0) AS n_group FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({PARTS}::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (g.n_group + {SMOOTHING} * l.v) AS p, 1 + ({PARTS}::HUGEINT * (k.in_lang + {SMOOTHING})) // (l.n_lang + {SMOOTHING} * l.v) AS q
  FROM grps g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source != b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, r::INT AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP_TERMS}
"""
