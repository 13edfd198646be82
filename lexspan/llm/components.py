"""Connected components of a distributed edge list.

Each round points every node of an edge at the smallest node seen around it
(large-star, then small-star), so a component becomes a star around its
smallest id in O(log^2 n) rounds.  Neighbour minima are aggregates with
map-side combining, so a hub of any degree costs one row per task; before each
round every partition keeps only a spanning forest of its own edges.  Once these
forests have no more than `LOCAL_EDGES` edges in all, one task joins them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

MAX_ROUNDS = 60
#: Edges (16 bytes each) that one task joins at most.
LOCAL_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) that aren't roots, and the smallest node each one reaches."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all() and (root[x] == root[y]).all():
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _contract(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    while parts:
        a, b = (np.concatenate(x) for x in zip(*parts))
        a, b = forest(a, b)
        for i in range(0, len(a), 100_000):
            yield pa.record_batch([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["u", "v"])
        parts = []


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each id in edges; component is the smallest id reachable.  Null ids and loops are left out."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.mapInArrow(_contract, "u long, v long"))
    last = None
    for _ in range(MAX_ROUNDS):
        if e.count() <= LOCAL_EDGES:
            e = e.coalesce(1).mapInArrow(_contract, "u long, v long")
            break
        # v < u holds here: v is the smallest node around u in its partition
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: the larger neighbours of u move to u's minimum
        large = e.select(F.col("v").alias("c"), F.col("u").alias("w")).join(low.withColumnRenamed("u", "c"), "c").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # small-star: u and its smaller neighbours move to u's minimum
        small = e.join(low, "u").select("u", "v", "m").selectExpr("stack(2, u, m, v, m) as (u, v)")
        new = large.union(small).where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct()
        e = cut(new.mapInArrow(_contract, "u long, v long"))
        state = e.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        centres = e.select(F.col("v").alias("u")).distinct().join(e, "u", "left_semi").limit(1).count()
        if state[0] == state[1] and centres == 0:
            break
        if last == state:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = cut(e.groupBy("u").agg(F.min("v").alias("v")) if e.rdd.getNumPartitions() > 1 else e, gather=True)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v"), F.col("v")).distinct())
