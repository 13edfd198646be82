import tracemalloc

import numpy as np
import pytest
from helpers import roots
from pyspark.sql import functions as F

from lexspan.llm import metric_search, vector_join

ODD = [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] + [1.0] * 7), (9004, []), (9005, [None] + [1.0] * 7), (9006, [1.0] * 3), (None, [1.0] * 8), (9007, [float("inf")] * 8)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, v string").repartition(4)


def clustered(n=600, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, dim))
    rows = []
    for i in range(n):
        x = centres[rng.integers(30)] + rng.standard_normal(dim) * rng.choice([0, 0.1, 0.2, 0.3])
        rows.append((i, [float(v) for v in (x * rng.uniform(0.01, 100)).astype(np.float32)]))
    return rows


def brute_links(rows):
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    comp = roots([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(close)) if a < b])
    return {i: (int(close[a].sum()), comp[i]) for a, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("tile,block", [(16, 7), (100, 1024), (32_768, 1024)])
def test_vector_join(spark, monkeypatch, tile, block):
    """Cells of one tile and of several, and a hot vector."""
    monkeypatch.setattr(vector_join, "TILE", tile)
    monkeypatch.setattr(vector_join, "BLOCK", block)
    rows = clustered() + [(700 + i, [1.0] * 8) for i in range(60)]
    got = {r["vec_id"]: r for r in vector_join.linked_vectors(frame(spark, rows + ODD)).collect()}
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i, _ in rows} == brute_links(rows)
    for i, _ in ODD:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] == (i is not None)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values() if r["vec_id"] is not None)


def test_vector_join_at_the_bound(spark):
    """Pairs so near to the bound that only double precision decides."""
    rows = []
    for i in range(40):
        angle = np.arccos(0.95 + (i - 20) * 1e-7)
        turn = np.eye(8)[[i % 8, (i + 3) % 8]] * (10.0 + i)
        rows += [(2 * i, turn[0].tolist()), (2 * i + 1, (np.cos(angle) * turn[0] + np.sin(angle) * turn[1]).tolist())]
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    got = {r["vec_id"]: r["n_links"] for r in vector_join.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: int(close[i].sum()) - 1 for i in range(80)}


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [-1.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_join.linked_vectors(frame(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_vector_join_without_vectors(spark):
    assert vector_join.linked_vectors(frame(spark, ODD).limit(0)).count() == 0
    assert vector_join.linked_vectors(frame(spark, [(1, None)])).first()["kept"]


def test_cells_hold_all_partners_and_fewer_others():
    """Points within reach share a cell or meet as visitors; with more points, and so axes, the share of pairs that meet falls."""
    x = np.random.default_rng(3).standard_normal((1500, 8)).astype(np.float32) / 8
    far, shares = ((x[:, None] - x[None]) ** 2).sum(2), []
    for axes in (1, 2, 3, 4):
        own, before = vector_join.cells(x, 5, axes, 0.1119)
        assert len(before) == (3**axes - 1) // 2 and ((own >> 52) == 5).all()
        meet = own[:, None] == own[None]
        for b in before:
            meet |= (b[:, None] == own[None]) | (own[:, None] == b[None])
        assert meet[far <= 0.1118**2].all()
        shares.append(meet.mean())
    assert all(b < 0.85 * a for a, b in zip(shares, shares[1:])) and shares[-1] < 0.35
    counts = [vector_join.grid_axes(n, 8) for n in (0, 10**4, 10**5, 10**6, 10**7, 10**9)]
    assert counts == sorted(counts) and counts[0] == 1 and counts[-1] == 4


def test_a_hot_tile_takes_constant_memory():
    rng = np.random.default_rng(4)
    peak = []
    for n in (1500, 3000):
        x = np.tile(np.eye(1, 64, dtype=np.float32), (n, 1)) + rng.standard_normal((n, 64)).astype(np.float32) * 1e-3
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        tracemalloc.start()
        links, (a, b), _ = vector_join._tile_links(x, np.ones(n, np.int64), np.zeros(n, np.int8), True, 0, 8, 0.0125, 0.95)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (links == n - 1).all() and len(a) == n - 1
    assert peak[1] < 1.3 * peak[0]


def brute_top(rows, k=10):
    ids, x = np.array([i for i, _ in rows]), np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(np.float64)).astype(np.int64)
    out = set()
    for a in range(len(ids)):
        if ids[a] % 100 == 0:
            s = x @ x[a]
            best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[a]][:k]
            out |= {(int(ids[a]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)}
    return out


@pytest.mark.parametrize("tree,block", [(40, 3), (2048, 50_000)])
def test_top_k(spark, monkeypatch, tree, block):
    monkeypatch.setattr(metric_search, "TREE_MIN", tree)
    monkeypatch.setattr(metric_search, "QUERY_BLOCK", block)
    rows = clustered(500) + [(1000 + i, [0.5] * 8) for i in range(250)]  # a hot vector, and ties of its copies
    got = metric_search.top_k(frame(spark, rows + ODD), F.col("vec_id") % 100 == 0)
    assert set(map(tuple, got.collect())) == brute_top(rows)


def test_top_k_of_few(spark):
    got = metric_search.top_k(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])]), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024)]
    assert metric_search.top_k(frame(spark, ODD).limit(0), F.lit(True)).count() == 0


def test_m_tree_bounds_hold():
    x = np.random.default_rng(1).integers(-1000, 1000, (3000, 6))
    tree = metric_search.MTree(x, np.arange(3000))
    for page in tree.pages:
        if not page[0]:
            for c, pivot, radius in zip(page[1], page[3], page[4]):
                assert all(np.linalg.norm(tree.y[r] - pivot) <= radius + 1e-6 for r in under(tree, c))


def under(tree, page):
    p = tree.pages[page]
    return p[1].tolist() if p[0] else [r for c in p[1] for r in under(tree, c)]


def test_top_k_of_an_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    got = sorted(map(tuple, metric_search.top_k(frame(spark, rows), F.col("vec_id") == 0).collect()))
    assert got in ([(0, 1, 1, 2 << 20), (0, 2, 2, 0)], [(0, 1, 2, 3 << 20), (0, 2, 1, 0)])
