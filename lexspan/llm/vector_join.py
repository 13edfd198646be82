"""Near-duplicate vectors: an exact cosine join by the pigeonhole over subspaces.

Equal vectors are one class, found by an aggregate with map-side combining, so a
vector that a third of all rows hold is one point with a weight.  Points are
scaled to length 1 and turned by one fixed random rotation, which keeps
distances; a cosine of at least c is a squared distance of at most 2 - 2c.  The
rotated coordinates fall into `SUBSPACES` blocks; in at least one block two such
points are within the block's proportional share of that budget.  Each block is
a range join of its own: a grid over the block's first axes has cells as wide as
the share reaches, so partners lie in the same or in neighbouring cells.  A point
is at home in its cell and visits the neighbouring cells before it; inside a cell
only pairs within the block's share are looked at further, and the cosine
decides.  A pair is counted in the first block that finds it, so the union needs
no deduplication.  The more points there are, the more axes the grid has, and the
smaller is the share of pairs that meet.

The coordinates that travel are single precision; where they leave a cosine
within `BORDER` of the bound, the pair's own vectors decide in double precision.

Skew.  Cells are cut into tiles of a bounded number of points, by joins with the
cells' sizes; nothing on the driver grows with the input.  Tiles compare in
blocks and give link counts and a spanning forest of their links, never all
pairs.

Defined results: vectors that are null, empty, zero, of another dimension than
the most common one, or hold null or non-finite components link with nothing;
repeated rows are vectors of their own that link with each other; so are rows of
one id and different vectors; a row without an id has no component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import chunks, cut, release, salted_join, starts, table
from .components import components, forest

COSINE = 0.95
SUBSPACES = 8
#: Points of a tile, at most about; axes of a block's grid, at most.
TILE = 32_768
AXES = 4
#: Cells that an axis has in effect: the grid has as many axes as make its cells smaller than a tile.
PER_AXIS = 4.6
#: Points of a tile that are compared with as many others at once.
BLOCK = 1024
#: Rows of a table that is broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
SLACK, BORDER = 1e-6, 1e-5
LINKS, EDGE, CLOSE = 0, 1, 2


def finite_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: bool = False) -> DataFrame:
    """vec_id and v (doubles as bytes) of the rows whose vector has only finite components; every: of all rows, v null for the others."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, out = batch.column(0), []
            for v in batch.column(1).to_pylist():
                x = None if v is None or None in v else np.array(v, dtype=np.float64)
                out.append(None if x is None or not len(x) or not np.isfinite(x).all() else x.tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["vec_id", "v"])

    made = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "vec_id long, v binary")
    return made if every else made.where("vec_id is not null and v is not null")


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def sized(x: np.ndarray) -> np.ndarray:
    """The rows' lengths, without overflow."""
    top = np.abs(x).max(1)
    return np.linalg.norm(x / np.maximum(top, 1e-300)[:, None], axis=1) * top


def grid_axes(n: int, width: int) -> int:
    """Axes of a block's grid for n points."""
    return int(np.clip(1 + np.log(max(1.0, n / TILE)) // np.log(PER_AXIS), 1, min(AXES, width)))


def cells(x: np.ndarray, block: int, axes: int, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cell of each point (its block's coordinates in x), and the neighbouring cells before it."""
    place = np.floor(x[:, :axes].astype(np.float64) / reach).astype(np.int64) + (1 << 11)
    unit = np.array([1 << (12 * k) for k in range(axes)], np.int64)
    own = place @ unit + (block << 52)
    steps = [int(np.dot(step, unit)) for step in itertools.product((-1, 0, 1), repeat=axes)]
    return own, [own + step for step in steps if step < 0]


def _tile_links(x, weight, part, within, block, width, budget, cosine):
    """Links among the rows of a tile (within), and of these with the rows of another (part 1): link weights, edges, and pairs
    that single precision can't decide."""
    mine = x[:, block * width : (block + 1) * width]
    half = (mine.astype(np.float64) ** 2).sum(1).astype(np.float32) / 2
    one = np.ones(len(x), np.float32)
    left, right = np.column_stack((mine, -half, one)), np.column_stack((mine, one, -half))
    home, other = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    links = np.zeros(len(x), np.int64)
    edges, held, open_pairs = [], 0, []
    jobs = [(p, q, home) for p in range(0, len(home), BLOCK) for q in range(p, len(home), BLOCK)] if within else []
    jobs += [(p, q, other) for p in range(0, len(home), BLOCK) for q in range(0, len(other), BLOCK)]
    for p, q, those in jobs:
        a, b = home[p : p + BLOCK], those[q : q + BLOCK]
        u, v = np.divmod(np.flatnonzero(left[a] @ right[b].T >= -(budget + 1e-5) / 2), len(b))  # single precision only proposes
        if those is home and p == q:
            u, v = u[u < v], v[u < v]
        for at in range(0, len(u), 1 << 16):
            c, d = a[u[at : at + (1 << 16)]], b[v[at : at + (1 << 16)]]
            y, z = x[c].astype(np.float64), x[d].astype(np.float64)
            far = ((y - z) ** 2).reshape(len(c), -1, width).sum(2)
            cos = (y * z).sum(1)
            ok = (far[:, block] <= budget) & ~(far[:, :block] <= budget).any(1) & (cos >= cosine - BORDER)
            c, d, sure = c[ok], d[ok], cos[ok] >= cosine + BORDER
            if not sure.all():
                open_pairs.append((c[~sure], d[~sure]))
                c, d = c[sure], d[sure]
            if len(c):
                np.add.at(links, c, weight[d])
                np.add.at(links, d, weight[c])
                edges.append(forest(c, d))
                held += len(edges[-1][0])
                if held > 1 << 18:
                    edges = [forest(*(np.concatenate(e) for e in zip(*edges)))]
                    held = len(edges[0][0])
    none = np.empty(0, np.int64)
    both = lambda found: tuple(np.concatenate(e) for e in zip(*found)) if found else (none, none)
    return links, forest(*both(edges)) if edges else (none, none), both(open_pairs)


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    spark = vectors.sparkSession
    rows = cut(finite_vectors(vectors, id_col, vector_col, every=True).withColumn("h", F.when(F.col("vec_id").isNotNull(), F.md5("v"))))
    sizes = rows.where("h is not null").groupBy(F.octet_length("v").alias("bytes")).count().orderBy(F.desc("count"), "bytes").limit(1).collect()
    dim = sizes[0]["bytes"] // 8 if sizes else 1
    blocks = min(SUBSPACES, dim)
    width = -(-dim // blocks)
    budget = (2 - 2 * cosine) / blocks + SLACK
    reach, turn = budget**0.5 + SLACK, rotation(dim)

    classes = cut(rows.where(F.octet_length("v") == 8 * dim).where("h is not null").groupBy("h").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v")).withColumn("c", F.monotonically_increasing_id()))

    def turned(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(-1, dim)
            size = sized(x)
            some = np.flatnonzero(size > 0)
            y = np.zeros((len(some), blocks * width), np.float32)
            y[:, :dim] = (x[some] / size[some, None]) @ turn
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), pa.array([r.tobytes() for r in y], pa.binary())], names=["c", "id", "n", "x"])

    # written, so that each point has the same coordinates wherever it is compared
    points = cut(classes.select("c", "id", "n", "v").mapInArrow(turned, "c long, id long, n long, x binary"))
    axes = grid_axes(points.count(), width)

    def placed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float32).reshape(-1, blocks * width)
            for k in range(blocks):
                own, before = cells(x[:, k * width : (k + 1) * width], k, axes, reach)
                for side, cell in [(0, own), *((1, c) for c in before)]:
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), side, np.int8)), *batch.columns], names=["cell", "visits", *batch.schema.names])

    near = points.mapInArrow(placed, "cell long, visits byte, c long, id long, n long, x binary")
    count = near.groupBy("cell").agg(F.count_if(F.col("visits") == 0).alias("home"), F.count_if(F.col("visits") == 1).alias("guests")).where("home > 0")
    tiles = count.select("cell", F.ceil(F.col("home") / TILE).cast("int").alias("t"), F.ceil(F.col("guests") / TILE).cast("int").alias("g"))
    tiles = cut(tiles, gather=True)
    tiles = F.broadcast(tiles) if tiles.count() <= BROADCAST_ROWS else tiles
    single = (F.col("t") == 1) & (F.col("g") <= 1)  # one tile for the points at home and the visitors
    mine = F.pmod(F.xxhash64("c"), F.when(F.col("visits") == 0, F.col("t")).otherwise(F.col("g"))).cast("int")
    others = F.when(single, F.array(F.lit(0))).when(F.col("visits") == 0, F.sequence(F.lit(0), F.col("t") + F.col("g") - 1)).otherwise(F.sequence(F.lit(0), F.col("t") - 1))
    dealt = near.join(tiles, "cell").withColumn("mine", mine).withColumn("o", F.explode(others))
    guest = F.col("visits") == 1
    i = F.when(single, 0).when(guest, F.col("o")).otherwise(F.least("mine", "o")).cast("int")
    i = F.when(~single & ~guest & (F.col("o") >= F.col("t")), F.col("mine")).otherwise(i)
    j = F.when(single, 0).when(guest, F.col("t") + F.col("mine")).when(F.col("o") >= F.col("t"), F.col("o")).otherwise(F.greatest("mine", "o")).cast("int")
    part = F.when(guest | (~single & (F.col("mine") != i)), 1).otherwise(0).cast("byte")
    dealt = dealt.select("cell", i.alias("i"), j.alias("j"), part.alias("part"), "c", "id", "n", "x")

    def join(batches: Iterator[pa.RecordBatch]):
        names, kinds = ["a", "n", "b", "kind"], (pa.int64(), pa.int64(), pa.int64(), pa.int8())
        out = lambda a, n, b, kind: pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t.to_pandas_dtype()), t) for c, t in zip((a, n, b, np.full(len(a), kind)), kinds)], names=names)
        for t, _ in chunks(batches, 3, 4 * TILE):
            cell, i, j, part, number, ids, n = (t.column(c).to_numpy() for c in range(7))
            first = starts(cell, i, j)
            for at, to in zip(first.tolist(), [*first[1:].tolist(), len(cell)]):
                x = np.frombuffer(b"".join(t.column(7).slice(at, to - at).to_pylist()), np.float32).reshape(to - at, -1)
                links, (a, b), (c, d) = _tile_links(x, n[at:to], part[at:to], i[at] == j[at], int(cell[at]) >> 52, width, budget, cosine)
                some, number_, ids_ = np.flatnonzero(links), number[at:to], ids[at:to]
                yield out(number_[some], links[some], some, LINKS)
                yield out(ids_[a], a, ids_[b], EDGE)
                yield out(number_[c], c, number_[d], CLOSE)
        release()

    dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "part")
    found = cut(dealt.mapInArrow(join, "a long, n long, b long, kind byte"))

    @F.pandas_udf("boolean")
    def truly(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), np.float64).reshape(-1, dim) for c in (a, b))
        return pd.Series((x / sized(x)[:, None] * (y / sized(y)[:, None])).sum(1) >= cosine)

    end = lambda x: classes.select(F.col("c").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("v").alias(f"v_{x}"))
    close = found.where(F.col("kind") == CLOSE).select("a", "b").join(end("a"), "a").join(end("b"), "b").where(truly("v_a", "v_b"))
    close = cut(close.select("a", "b", "id_a", "id_b", "n_a", "n_b"), gather=True)
    counted = found.where(F.col("kind") == LINKS).select("a", "n").union(close.select("a", "n_b")).union(close.select("b", "n_a"))
    links = counted.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    joined = components(found.where(F.col("kind") == EDGE).select("a", "b").union(close.select("id_a", "id_b")), "a", "b").withColumnRenamed("node", "id")
    about = classes.select("c", "h", "id", "n").join(points.select("c"), "c", "left_semi").join(links, "c", "left").join(joined, "id", "left")
    about = about.select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    made = salted_join(rows.where("h is not null").select("vec_id", "h"), about, "h", "vec_id", "left").drop("h")
    out = made.unionByName(rows.where("h is null").select("vec_id"), allowMissingColumns=True)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


ORACLES = {
    "op4_vector_join": """
WITH RECURSIVE c AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM c WHERE list_dot_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.95::DOUBLE * a.size * b.size
), n AS (
  SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY 1
), reach(vec_id, component_id) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT y, component_id FROM reach JOIN links ON x = reach.vec_id
)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings AS e LEFT JOIN n USING (vec_id) JOIN (SELECT vec_id, min(component_id) AS component_id FROM reach GROUP BY 1) AS r USING (vec_id)
"""
}
QUERIES = {"op4_vector_join": op4_vector_join}
