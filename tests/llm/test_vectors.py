"""Nearest neighbours against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from chronoloom.llm import neighbours
from compare import duck


def brute(rows, k=20, every=20):
    """{query: [(vec_id, score)]} over all other rows."""
    found = {}
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)
            found[q] = [(i, -s) for s, i in scored[:k]]
    return found


def grouped(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return dict(found)


@pytest.mark.parametrize("how", [{}, {"leaf": 40, "sample": 400, "share": 2.0}])
def test_recall_and_scores(spark, how):
    folder = "/root/testdata/sf0.1" if not how else "/root/testdata/sf0.01"
    rows = duck(folder).execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    wanted = brute(rows)
    found = grouped(neighbours.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), **how))
    assert found.keys() == wanted.keys()
    vectors = {i: np.float64(v) for i, v in rows}
    hits = 0
    for q, near in found.items():
        assert len(near) == 20 and q not in dict(near)
        for i, s in near:
            assert s == pytest.approx(float(vectors[q] @ vectors[i]), abs=1e-12)
        assert [-s for _, s in near] == sorted(-s for _, s in near)
        hits += len(dict(near).keys() & dict(wanted[q]).keys())
    assert hits >= 0.9 * 20 * len(wanted)


def test_exhaustive_search_equals_brute_force_with_lengths_and_ties(spark):
    chance = np.random.default_rng(8)
    rows = [(i, [float(x) for x in chance.integers(-2, 3, 6)]) for i in range(150)]
    rows = [(i, v if any(v) else [1.0] * 6) for i, v in rows]
    rows += [(200 + i, [2.0] * 6) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = grouped(neighbours.nearest(table, share=1e9, leaf=10))
    assert found == brute(rows)


def test_crowded_leaves_are_split(spark, monkeypatch):
    chance = np.random.default_rng(9)
    rows = [(i, [float(x) for x in chance.normal(size=5)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "ROWS_TOGETHER", 9)
    monkeypatch.setattr(neighbours, "QUERIES_TOGETHER", 2)
    found = grouped(neighbours.nearest(table, share=1e9, leaf=40, trees=2))
    wanted = brute(rows)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in wanted.items()}


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<float>, id string, v int, query string, score string"
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]),
        (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (9, [0.5, 0.5]), (40, None),
    ]
    table = spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], schema)
    assert grouped(neighbours.nearest(table)) == {
        0: [(8, 0.5), (9, 0.5), (20, 0.0)], 20: [(8, 0.5), (9, 0.5), (0, 0.0)],
    }
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_trees_index_every_point():
    points = np.random.default_rng(1).normal(size=(500, 4))
    tree = neighbours.fitted(points, 20, np.random.default_rng(2))
    found = neighbours.leaves(tree, points)
    assert found.min() >= 0 and np.bincount(found).max() <= 20
    assert np.allclose(np.bincount(found) / 500, tree.shares)
    every = neighbours.probes([tree], points[0], 2.0)
    assert len(set(every)) == len(tree.shares)
    assert every[0] == (0, found[0])


def _searched(points, forest, share, queries, most=20):
    """(recall, part of the rows looked at) of searches by a share, against plain scans."""
    placed = [neighbours.leaves(t, points) for t in forest]
    hits, looked = 0, 0
    for q in queries:
        scores = points[:, :-1] @ points[q, :-1]
        scores[q] = -np.inf
        wanted = set(np.argsort(-scores)[:most].tolist())
        seen = set()
        for n, leaf in neighbours.probes(forest, np.append(points[q, :-1], 0.0), share):
            seen.update(np.flatnonzero(placed[n] == leaf).tolist())
        hits += len(wanted & seen)
        looked += len(seen)
    return hits / (most * len(queries)), looked / (len(queries) * len(points))


def _unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("rows", [2_000, 16_000])
def test_share_is_measured_by_recall_and_small_for_clustered_vectors(rows):
    chance = np.random.default_rng(rows)
    centres = _unit(chance.normal(size=(rows // 50, 32)))
    clustered = _unit(centres[chance.integers(0, len(centres), rows)] + 0.03 * chance.normal(size=(rows, 32)))
    loose = _unit(chance.normal(size=(rows, 32)))
    shares = []
    for vectors in (clustered, loose):
        points = neighbours._lifted(vectors, 1.0)
        sample = points[:2_000]
        forest = [neighbours.fitted(sample, 100, np.random.default_rng(n)) for n in range(4)]
        shares.append(neighbours.measured_share(forest, sample, rows, 20))
        recall, looked = _searched(points, forest, shares[-1], range(rows - 200, rows))
        assert recall >= 0.9
    # Without structure the whole table is nearly read, and the share says so.
    assert shares[0] < 0.5 < shares[1] and looked > 0.3


def test_share_of_tiny_samples():
    one = np.ones((1, 3))
    assert neighbours.measured_share([], np.zeros((0, 1)), 0, 20) == 1.0
    assert neighbours.measured_share([neighbours.fitted(one, 5, np.random.default_rng(1))], one, 1, 20) == 1.0
    same = np.ones((30, 3))
    assert neighbours.measured_share([neighbours.fitted(same, 5, np.random.default_rng(1))], same, 30, 20) == 1.0
