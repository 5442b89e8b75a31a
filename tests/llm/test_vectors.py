"""Operator 11 against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalens.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def all_pairs(rows, cosine=vector_dedup.COSINE):
    """{row index: (links, component)} by comparing every pair of rows."""
    usable = [
        lab is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows
    ]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(v, float) / np.sqrt((np.array(v, float) ** 2).sum()) if u else None for (_, v, _), u in zip(rows, usable)]
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[top(i)] = min(least.get(top(i), vec_id), vec_id)
    return sorted((str(rows[i][0]), links[i], str(least.get(top(i)))) for i in range(len(rows)))


def found(spark, rows, **how):
    got = vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got)


def clustered(n, dim=12, seed=0):
    """Noise, exact copies (a third of all), a dense group of near copies, chains that link step by step, and three labels."""
    rng = np.random.default_rng(seed)
    base, rows = rng.normal(size=dim), []
    for i in range(n):
        kind = i % 6
        if kind < 2:
            v = base
        elif kind == 2:
            v = base + rng.normal(size=dim) * 0.12
        elif kind == 3:
            turn = i / n * 6
            v = np.r_[math.cos(turn), math.sin(turn), np.zeros(dim - 2)]
        else:
            v = rng.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in v], (0, 0, 0, 1, 2)[i % 5]))
    return rows


@pytest.mark.parametrize("values, least", [(1 << 20, 256), (24 * 12, 24)])
def test_all_links_are_found(spark, monkeypatch, values, least):
    """Also with blocks that are cut into many tiles."""
    monkeypatch.setattr(vector_dedup, "TILE_VALUES", values)
    monkeypatch.setattr(vector_dedup, "TILE_LEAST", least)
    rows = clustered(420)
    got = found(spark, rows)
    assert got == all_pairs(rows)
    assert sum(r[1] for r in got) > 10_000


def test_cells_save_no_link(spark, monkeypatch):
    """With many cells, most of them far from each other, vectors between cells still meet; and they do not visit all cells."""
    monkeypatch.setattr(vector_dedup, "CELLS_LEAST", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=24) * (0.05, 0.3, 0.35)[i % 3]], i % 2) for i in range(360)]
    assert found(spark, rows) == all_pairs(rows)
    nodes = spark.createDataFrame([(i, 1, str(lab), 24, v) for i, v, lab in rows], "node long, n long, label string, dim int, vector array<float>")
    centres = vector_dedup.fit_cells(nodes, 24, 40)
    assert np.allclose((centres**2).sum(axis=1), 1)
    dealt = nodes.mapInArrow(vector_dedup._assigned(centres, 24, 0.93), "node long, n long, label string, dim int, vector array<float>, home int, visits array<int>")
    visited, homes = dealt.agg(F.avg(F.size("visits") / F.greatest(F.col("home"), F.lit(1))), F.countDistinct("home")).first()
    assert visited < 0.5 and homes > 12


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [3.0, 0.0], 0),
        (10, [1.0, 0.0], 1), (10, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, None, None), (11, [-0.0, 1.0], 2), (12, [0.0, 1.0], 2), (13, [1.0, 0.0, 0.0], 0),
        (14, [3e38, 3e38], 3), (15, [1e-38, 1e-38], 3), (16, [1.0], 0), (-5, [1.0, 1e-3], 0),
    ]
    got = found(spark, rows)
    assert got == all_pairs(rows)
    assert ("8", 2, "-5") in got and ("14", 1, "14") in got and ("13", 0, "13") in got


def test_threshold_is_met_exactly(spark):
    """0.6 is the cosine of (1, 0) and (3, 4): just at the threshold a pair is linked, just above it is not."""
    rows = [(1, [1.0, 0.0], 0), (2, [3.0, 4.0], 0)]
    assert found(spark, rows, cosine=0.6) == [("1", 1, "1"), ("2", 1, "1")]
    assert found(spark, rows, cosine=0.6000000001) == [("1", 0, "1"), ("2", 0, "2")]


def test_empty_and_clashing_columns(spark):
    assert vector_dedup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame(clustered(60), SCHEMA)
    plain = sorted(map(tuple, vector_dedup.near_duplicate_vectors(rows).collect()))
    for name in ("node", "n", "dim", "h1", "tile", "kept", "component_id", "id", "vector"):
        rows = rows.withColumn(name, F.lit("clash"))
    assert sorted(map(tuple, vector_dedup.near_duplicate_vectors(rows).collect())) == plain
