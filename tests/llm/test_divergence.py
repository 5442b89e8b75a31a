"""Operator 12 against its DuckDB SQL and a plain count."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quotalens.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, least, top=divergence.TOP_TERMS):
    """All groups and all kept terms, one by one."""
    counts, in_docs, groups = {}, {}, set()
    for _, text, lang, source, _ in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        counts.setdefault((lang, source), Counter()).update(words)
        in_docs.setdefault(lang, Counter()).update(set(words))
    found = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs.get(lang, {}).items() if n >= least]
        own = sorted(g[1] for g in groups if g[0] == lang)
        all_ = Counter()
        for s in own:
            all_.update(counts[lang, s])

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        shares, q = {s: share(counts[lang, s]) for s in own}, share(all_)
        for s in own:
            pairs = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(q[t] - shares[s][t], t) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            found += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())))]
            found += [(lang, s, "term", t, -v, k + 1) for k, (v, t) in enumerate(sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])]
    return sorted(found)


def uneven(n_sources, n_docs, seed=0):
    """Terms in all groups, in a few, and in one; a source with a third of all rows; groups without terms; nulls everywhere."""
    rng = random.Random(seed)
    rows = []
    for k in range(n_docs):
        source = 0 if rng.random() < 0.33 else rng.randrange(n_sources)
        words = [f"c{'abcdefgh'[rng.randrange(8)]}" for _ in range(rng.randrange(1, 12))]
        words += [f"r{'abcdefghijklmnopqrstuvwxyz'[source % 26]}x"] * rng.randrange(3) + [f"q{'abcdefgh'[source % 8]}y"] * rng.randrange(2)
        text = rng.choice([" ".join(words), ", ".join(words).upper(), "Ünï_" + "1".join(words), None, "", "12 34"])
        rows.append((k, text, rng.choice(["en", "en", "de", None]), rng.choice([f"s{source}", f"s{source}", f"s{source}", None]), 0))
    rows += [(0, None, "zz", "only", 0), (0, "9", "zz", "other", 0), (1, "lonely", "yy", None, None)]
    return rows


@pytest.mark.parametrize("groups, terms, held", [(128, 1024, 200_000), (7, 4, 5)])
def test_sums_are_those_of_all_terms(spark, monkeypatch, groups, terms, held):
    """Of 40 sources, with rare and common terms; also with tiles that cut groups and terms, and with counts given early."""
    monkeypatch.setattr(divergence, "TILE_GROUPS", groups)
    monkeypatch.setattr(divergence, "TILE_TERMS", terms)
    monkeypatch.setattr(divergence, "HELD_COUNTS", held)
    rows = uneven(40, 1500)
    got = sorted(map(tuple, divergence.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), 3).collect()))
    want = plain(rows, 3)
    assert got == want
    rare = Counter(r[3][0] for r in want if r[2] == "term")
    assert min(rare["r"], rare["q"]) > 10 and rare["c"]


def test_sql_and_plain_count_agree(spark, tmp_path):
    rows = uneven(12, 900, seed=1)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(divergence.ORACLE_SQL).fetchall()) == plain(rows, 30) == sorted(map(tuple, divergence.source_divergence(spark.read.parquet(f"{tmp_path}/d")).collect()))


def test_large_counts_stay_exact(spark):
    """10^9 times a count passes 2^63."""
    share = spark.sql(f"SELECT {divergence._share('n', 'total', 'v')} AS p FROM VALUES (99999999999999L, 100000000000001L, 3L), (0L, 0L, 1L) AS t(n, total, v)").collect()
    assert [r.p for r in share] == [1 + 10**9 * (99999999999999 + 5) // (100000000000001 + 15), 1 + 10**9]


def test_empty_and_clashing_columns(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = uneven(5, 200, seed=2)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("term", "n", "g", "p", "value", "item", "rank", "docs"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted(map(tuple, divergence.source_divergence(df, 3).collect())) == plain(rows, 3)


def test_odd_documents(spark, odd, empty):
    rows = [tuple(r) for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, divergence.op12_source_divergence(spark, odd).collect())) == plain(rows, 30)
    assert divergence.op12_source_divergence(spark, empty).count() == 0
