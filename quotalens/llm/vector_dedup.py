"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one representative a group (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table
from .graph import components, forest

COSINE = 0.93
#: Vectors of one label that a cell is meant for, bounds of the number of cells, rounds of k-means, vectors that seeds are drawn from.
CELL, CELLS_LEAST, CELLS_MOST, ROUNDS, SEED_VECTORS = 16_384, 4, 1024, 4, 4096
#: Components of the vectors of a tile (2^20 is 16 384 vectors of 64), the fewest vectors of one, and rows and columns of one product.
TILE_VALUES, TILE_LEAST, PRODUCT_ROWS, PRODUCT_COLUMNS = 1 << 20, 256, 1024, 2048
#: Rounding of double-precision products; cosines this close to the threshold are computed again from exactly rounded sums.
ROUNDING = 1e-9
#: Blocks of more than a tile that are sent to every task; beyond, they are joined.
BROADCAST_ROWS = 100_000


def _usable(vector: str) -> str:
    return f"coalesce(forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({vector}, x -> x != 0), false)"


def _unit(values: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = values.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False), dim)


def _seeds(x: np.ndarray, k: int) -> np.ndarray:
    """k of the unit vectors, each drawn in proportion to its squared distance to those drawn before."""
    rng = np.random.default_rng(0)
    chosen, far = [0], np.full(len(x), np.inf)
    for _ in range(min(k, len(x)) - 1):
        far = np.minimum(far, np.maximum(2 - 2 * (x @ x[chosen[-1]]), 0))
        chosen.append(int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else chosen[-1])
    return x[chosen]


def fit_cells(nodes: DataFrame, dim: int, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres (unit rows) of spherical k-means over all vectors of ``nodes`` (node, vector) that have ``dim`` components.

    Seeds are drawn from the SEED_VECTORS vectors of least hash. A round sums the unit vectors of each cell inside the tasks and adds
    these sums by cell; only the k sums (k * dim numbers) reach the driver. A cell that loses all its vectors keeps its centre.
    """
    same = nodes.where(F.size("vector") == dim)
    drawn = same.orderBy(F.xxhash64("node"), "node").limit(SEED_VECTORS).select("vector").toArrow().column(0).combine_chunks()
    centres = _seeds(_vectors(drawn, dim), k)
    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(centres)
            for batch in batches:
                x = _vectors(batch.column(0), dim)
                np.add.at(total, (x @ centres.T).argmax(axis=1), x)
            cells = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(list(total[cells]), pa.list_(pa.float64()))], names=["cell", "total"])

        parts = same.select("vector").mapInArrow(summed, "cell long, total array<double>").select("cell", F.posexplode("total").alias("at", "v"))
        totals = parts.groupBy("cell", "at").agg(F.sum("v").alias("v")).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("at", "v")))["v"].alias("total"))
        centres = centres.copy()
        for row in totals.collect():  # k rows
            size = math.sqrt(sum(v * v for v in row["total"]))
            if size > 0:
                centres[row["cell"]] = np.array(row["total"]) / size
    return centres


def _assigned(centres: np.ndarray, dim: int, cosine: float):
    """Adds to (node, n, label, dim, vector) the home cell and every earlier cell that a vector within the cosine may have for home.

    If y has home c and lies within the angle t of x, x lies at most sin(t) beyond the plane between its own centre h and c:
    x.(h - c) <= sin(t) |h - c|. So every pair within the angle meets in the earlier of its two home cells.
    """
    reach = math.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else 1.0
    between = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0)) * reach + ROUNDING
    places = np.arange(len(centres))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, visits = np.zeros(batch.num_rows, np.int32), [[] for _ in range(batch.num_rows)]
            own = np.flatnonzero(batch.column("dim").to_numpy() == dim)
            if len(own):
                near = _vectors(batch.column("vector").take(pa.array(own)), dim) @ centres.T
                cell = near.argmax(axis=1)
                home[own] = cell
                may = (near[np.arange(len(own)), cell][:, None] - near <= between[cell]) & (places < cell[:, None])
                for r in np.flatnonzero(may.any(axis=1)):
                    visits[own[r]] = np.flatnonzero(may[r]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "home", "visits"])

    return each


def _tiles(dealt: DataFrame) -> DataFrame:
    """(tile, side, node, n, vector): each pair of vectors that must be compared meets in one tile.

    A block is a cell's own vectors (side 0) with those that visit it (side 1); tile names end in ``=`` where side 0 is compared with
    itself too. A block of up to a tile is one tile; a larger one is cut by a hash, and all pairs of its cuts that hold own vectors
    are tiles, so a task holds two cuts at most however large the block is.
    """
    cells = "explode(concat(array(struct(home AS cell, 0 AS side)), transform(visits, c -> struct(c AS cell, 1 AS side)))) AS place"
    blocks = dealt.selectExpr("label", "dim", cells).groupBy("label", "dim", "place.cell").agg(F.count_if(F.expr("place.side = 0")).alias("own"), F.count_if(F.expr("place.side = 1")).alias("visiting"))
    most = F.greatest(F.lit(TILE_LEAST), (F.lit(TILE_VALUES) / F.col("dim")).cast("long"))
    large = blocks.where(F.col("own") + F.col("visiting") > most).select(
        "label", "dim", "cell", F.greatest(F.ceil(F.col("own") / most), F.lit(1)).alias("m"), F.ceil(F.col("visiting") / most).alias("v")
    )
    large = keep(large, "large-blocks")
    n_large = large.count()
    rows = dealt.selectExpr("label", "dim", "node", "n", "vector", cells).select("label", "dim", "place.cell", "place.side", "node", "n", "vector")
    name = "concat_ws(' ', dim, cell, a, b, label, '{}')"
    if not n_large:
        return rows.selectExpr("concat_ws(' ', dim, cell, 0, 0, label, '=') AS tile", "side", "node", "n", "vector")
    rows = rows.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, ["label", "dim", "cell"], "left")
    whole = rows.where("m IS NULL").selectExpr("concat_ws(' ', dim, cell, 0, 0, label, '=') AS tile", "side", "node", "n", "vector")
    cut = rows.where("m IS NOT NULL").withColumn("k", F.expr("pmod(xxhash64(node), if(side = 0, m, v))"))
    own = cut.where("side = 0")
    among = own.selectExpr("*", "explode(sequence(0L, m - 1)) AS j").selectExpr("*", "least(k, j) AS a", "greatest(k, j) AS b")
    among = among.selectExpr(f"if(a = b, {name.format('=')}, {name.format('x')}) AS tile", "if(k <= j, 0, 1) AS side", "node", "n", "vector")
    met = own.where("v > 0").selectExpr("*", "k AS a", "explode(sequence(0L, v - 1)) AS b").unionByName(cut.where("side = 1").selectExpr("*", "explode(sequence(0L, m - 1)) AS a", "k AS b"))
    return whole.unionByName(among).unionByName(met.selectExpr(f"{name.format('v')} AS tile", "side", "node", "n", "vector"))


def _exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y have the cosine or more; a product of a few thousand rows at a time."""
    near = x @ y.T
    found = near >= cosine
    for i, j in np.argwhere(np.abs(near - cosine) <= ROUNDING):
        found[i, j] = _exact_cosine(x[i], y[j]) >= cosine
    return found


def _compared(cosine: float):
    """Of tiles (tile, side, node, n, vector), sorted by tile: (node, root, links): the vectors linked with a node inside a tile,
    counted with their copies, and a smaller node it is linked with, directly or not; null where it is the smallest."""

    def of(tile: str, side: np.ndarray, node: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        spans = [(left, left)] if tile.endswith("=") else []
        for p, q in [*spans, (left, right)]:
            for i in range(0, len(p), PRODUCT_ROWS):
                for j in range(0, len(q), PRODUCT_COLUMNS):
                    if q is p and j + PRODUCT_COLUMNS <= i:
                        continue  # below the diagonal
                    a, b = p[i : i + PRODUCT_ROWS], q[j : j + PRODUCT_COLUMNS]
                    found = _linked(x[a], x[b], cosine)
                    if q is p:
                        found &= a[:, None] < b
                    if found.any():
                        links[a] += found @ n[b]
                        links[b] += n[a] @ found
                        r, c = np.nonzero(found)
                        root = forest(a[r], b[c], root)
        at = np.flatnonzero(links)
        # the smallest node of a component stands for it, so that links lead from larger to smaller ones
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, root, node)
        top = least[root[at]]
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(top, mask=top == node[at]), pa.array(links[at])], names=["node", "root", "links"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def run() -> Iterator[pa.RecordBatch]:
            if held:
                side, node, n, x = (np.concatenate(c) for c in zip(*held))
                yield of(name, side, node, n, x)

        for batch in batches:
            tiles = batch.column(0).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)] if len(tiles) else [0]
            for lo, hi in zip(starts, starts[1:]):
                if tiles[lo] != name:
                    yield from run()
                    held, name = [], tiles[lo]
                dim = int(name.split(" ", 1)[0])
                held.append([*(batch.column(c).slice(lo, hi - lo).to_numpy() for c in (1, 2, 3)), _vectors(batch.column(4).slice(lo, hi - lo), dim)])
        yield from run()

    return each


def near_duplicate_vectors(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links long, component_id, kept) of every row; links join vectors of one label with a cosine of ``cosine`` or more.

    All such pairs are found: cells only save products. Vectors are dealt to k-means cells, and each visits the cells of other
    homes within its reach (see ``_assigned``); where vectors have no clusters that is every cell, and the work that of all pairs.
    Equal vectors of a label are one node with a count, so copies are never paired. Counts and a forest of links leave a task.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Lengths other than the most common one share one cell a label. Null ids count in links, are no
    representative and take part in no minimum; a repeated id keeps every row. An empty table gives no rows; other columns are not read.
    """
    given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label"))
    ok = F.col("label").isNotNull() & F.expr(_usable("vector"))
    # two hashes of 64 bits tell vectors apart
    keyed = given.withColumns({"h1": F.when(ok, F.xxhash64("label", "vector")), "h2": F.when(ok, F.xxhash64(F.lit(7), "vector", "label"))})
    same = keyed.where("h1 IS NOT NULL").withColumn("at", F.monotonically_increasing_id()).groupBy("h1", "h2")
    nodes = same.agg(F.min("at").alias("node"), F.count("*").alias("n"), F.min("id").alias("first_id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    groups = keep(nodes.withColumn("dim", F.size("vector")), "vector-nodes")
    nodes = groups.select("node", "n", "label", "dim", "vector")
    sizes = nodes.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return keyed.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    dim = sizes["dim"]
    centres = fit_cells(nodes, dim, max(CELLS_LEAST, min(CELLS_MOST, math.ceil(sizes["most"] / CELL), (1 << 21) // dim)))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    dealt = nodes.mapInArrow(_assigned(centres, dim, cosine), f"{kind}, home int, visits array<int>")
    tiles = _tiles(dealt).repartition("tile").sortWithinPartitions("tile")
    found = keep(tiles.mapInArrow(_compared(cosine), "node long, root long, links long"), "vector-links")
    roots = components(found.where("root IS NOT NULL"), "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = groups.join(links, "node", "left").join(roots, "node", "left").selectExpr("h1", "h2", "first_id", "coalesce(root, node) AS root", "coalesce(links, 0) + n - 1 AS n_links")
    member = keep(member, "vector-members")
    first = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    result = keyed.select("id", "h1", "h2").join(member.join(first, "root").select("h1", "h2", "n_links", "component_id"), ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every row of ``embeddings``; see ``near_duplicate_vectors``."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
