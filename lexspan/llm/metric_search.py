"""Exact top-k inner-product search with M-trees.

Components become integers; the score is the integers' inner product.  With one
more coordinate that lifts every vector to the same length, a larger inner
product is a smaller Euclidean distance, a metric.  Vectors are dealt to trees
of a bounded number of entries.  A tree's nodes are pages: an inner page holds
pivots with covering radii and their distances to the page's own pivot; a leaf
page holds vectors with theirs.  A query visits pages best bound first and ends
when no bound can beat its k-th score; stored distances and the triangle
inequality rule out entries before any distance is computed.  Scores themselves
are exact, and bounds are relaxed by more than their rounding error.

Of equal vectors only the k + 1 smallest ids can be in a result, and only these
are kept, by a ranking that is limited within each task before the shuffle, so
a vector held by a third of all rows costs k + 1 rows.  The queries meet the
trees in blocks; each tree gives its own k best and the best of these are the
result.

Defined results: vectors that are null, empty or hold null or non-finite
components, and rows without an id, take no part; nor does a vector whose
dimension isn't the most common one.  Ties go to the smaller id.  Of rows that
repeat an id with the same vector one is kept; of an id with several vectors all
are candidates, and its query is the smallest of them.  Scores are 64-bit
integers: vectors whose products are larger have no defined score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, table
from .vector_join import finite_vectors

K = 10
EVERY = 100
SCALE = 1024.0
PAGE = 64
FANOUT = 16
#: Entries of a tree, and queries of a block, at most about.
TREE_MIN, TREE_MAX = 2048, 100_000
QUERY_BLOCK = 50_000


class MTree:
    """Bulk-loaded over integer vectors x with ids."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, seed: int = 0):
        self.x, self.ids = x, ids
        norm = (x.astype(np.float64) ** 2).sum(1)
        self.top = float(norm.max()) if len(x) else 0.0
        self.y = np.hstack((x.astype(np.float64), np.sqrt(np.maximum(self.top - norm, 0))[:, None]))
        self.rng = np.random.default_rng(seed)
        self.pages: list[tuple] = []
        self.root, self.root_pivot, self.root_radius = self._build(np.arange(len(x))) if len(x) else (-1, None, 0.0)

    def _to(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.y[rows] - pivot) ** 2).sum(1))

    def _build(self, rows: np.ndarray) -> tuple[int, np.ndarray, float]:
        pivot = self.y[rows].mean(0)
        far = self._to(rows, pivot)
        if len(rows) <= PAGE:
            self.pages.append((True, rows, far))
            return len(self.pages) - 1, pivot, float(far.max())
        centres = self.y[self.rng.choice(rows, min(FANOUT, -(-len(rows) // PAGE)), replace=False)]
        gap = -2 * self.y[rows] @ centres.T + (centres * centres).sum(1)
        near = gap.argmin(1)
        groups = [rows[near == c] for c in range(len(centres))]
        groups = [g for g in groups if len(g)]
        if len(groups) < 2 or max(map(len, groups)) > 0.9 * len(rows):  # hardly told apart: even parts along the distance
            groups = np.array_split(rows[np.argsort(far, kind="stable")], len(centres))
        made = [self._build(g) for g in groups]
        child = np.array([m[0] for m in made])
        pivots, radii = np.stack([m[1] for m in made]), np.array([m[2] for m in made])
        self.pages.append((False, child, np.sqrt(((pivots - pivot) ** 2).sum(1)), pivots, radii))
        return len(self.pages) - 1, pivot, float(far.max())

    def search(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) but for the id own, best first."""
        if self.root < 0:
            return []
        lifted = np.append(q.astype(np.float64), 0.0)
        size = self.top + float((lifted * lifted).sum())
        slack = 1e-7 * (1 + size**0.5)
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        reach = np.inf
        at = float(np.sqrt(((lifted - self.root_pivot) ** 2).sum()))
        queue = [(max(0.0, at - self.root_radius), self.root, at)]
        while queue:
            bound, page, from_pivot = heapq.heappop(queue)
            if bound > reach + slack:
                break
            p = self.pages[page]
            if p[0]:
                _, rows, stored = p
                rows = rows[np.abs(stored - from_pivot) <= reach + slack]
                scores, ids = self.x[rows] @ q, self.ids[rows]
                some = ids != own
                if len(best) == k:
                    some &= scores >= best[0][0]
                for score, i in zip(scores[some].tolist(), ids[some].tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                if len(best) == k:
                    reach = max(0.0, size - 2.0 * best[0][0]) ** 0.5
            else:
                _, child, stored, pivots, radii = p
                some = np.flatnonzero(np.abs(stored - from_pivot) - radii <= reach + slack)
                far = np.sqrt(((pivots[some] - lifted) ** 2).sum(1))
                for c, d, r in zip(child[some].tolist(), far.tolist(), radii[some].tolist()):
                    if d - r <= reach + slack:
                        heapq.heappush(queue, (max(0.0, d - r), c, d))
        return [(s, -i) for s, i in sorted(best, key=lambda b: (-b[0], -b[1]))]


def integers(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, the floors of the scaled components as long integers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = [np.floor(scale * np.frombuffer(v, np.float64)).astype(np.int64).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["vec_id", "v"])

    return finite_vectors(vectors, id_col, vector_col).mapInArrow(run, "vec_id long, v binary")


def top_k(vectors: DataFrame, queries, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for each row that the condition queries (on vec_id) holds for."""
    spark = vectors.sparkSession
    clean = cut(integers(vectors, scale, id_col, vector_col).dropDuplicates(["vec_id", "v"]))
    sizes = clean.groupBy(F.octet_length("v").alias("bytes")).count().orderBy(F.desc("count"), "bytes").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not sizes:
        return spark.createDataFrame([], schema)
    n, dim = sizes[0]["count"], sizes[0]["bytes"] // 8
    clean = clean.where(F.octet_length("v") == 8 * dim)
    asked = clean.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    trees = max(1, -(-n // int(np.clip(n // 12, TREE_MIN, TREE_MAX))))
    smallest = Window.partitionBy("v").orderBy("vec_id")
    kept = clean.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).drop("r")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = kept.select(F.pmod(F.xxhash64("vec_id"), F.lit(trees)).cast("int").alias("tree"), every(blocks).alias("block"), "vec_id", "v")
    right = asked.select(every(trees).alias("tree"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def search(entries: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if entries.num_rows and asks.num_rows:
            order = np.argsort(entries["vec_id"].to_numpy(), kind="stable")
            x = np.frombuffer(b"".join(entries["v"].to_pylist()), np.int64).reshape(-1, dim)[order]
            tree = MTree(x, entries["vec_id"].to_numpy()[order])
            for own, q in zip(asks["query_id"].to_pylist(), asks["q"].to_pylist()):
                out += [(own, i, s) for s, i in tree.search(np.frombuffer(q, np.int64), own, k)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names=["query_id", "vec_id", "score"])

    found = left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLES = {
    "op3_metric_search": """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
}
QUERIES = {"op3_metric_search": op3_metric_search}
