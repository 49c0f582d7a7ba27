"""Neighbours, pairs within a distance and DBSCAN against brute force, in few and many dimensions."""

import random

import numpy as np
import pytest

from millrace.operators import neighbours


def _clouds(n, d, seed, spread=0.4, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=4, size=(groups, d))
    return centres[rng.integers(groups, size=n)] + rng.normal(scale=spread, size=(n, d))


def _frame(spark, x, names=None):
    return spark.createDataFrame([(k if names is None else names[k], v.tolist()) for k, v in enumerate(x)], f"k {'long' if names is None else 'string'}, v array<double>").repartition(5)


def _knn(x, asked, k):
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        out[q] = sorted((d[i], i) for i in range(len(x)) if i != q)[:k]
    return out


@pytest.mark.parametrize("d, pivots, block", [(2, 20, 40), (8, None, 4096), (40, 3, 16)])
def test_nearest_by_pivots_equals_brute_force(spark, d, pivots, block):
    """With repeated points, whose ties go to the smaller key, and cells that are split into rings and parts."""
    x = np.concatenate([_clouds(900, d, 1), np.repeat(_clouds(3, d, 2), 40, axis=0)])
    df = _frame(spark, x)
    log = {}
    found = neighbours.nearest(df.filter("k % 20 = 0"), df, "k", "v", 7, pivots=pivots, block=block, log=log)
    got = {}
    for r in found.collect():
        got.setdefault(r["k"], []).append((r["rank"], r["near_key"], r["distance"]))
    expected = _knn(x, range(0, len(x), 20), 7)
    assert {q: [n for _, n, _ in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in expected.items()}
    assert all(d == pytest.approx(e) for q, v in expected.items() for (_, _, d), (e, _) in zip(sorted(got[q]), v, strict=True))
    assert log["pairs"] == len(x) * -(-len(x) // 20) and log["compared"] <= log["pairs"]


def test_pivots_leave_most_points_unread(spark):
    """4,000 points in 8 dimensions in 40 groups: a query compares less than a tenth of them."""
    df = _frame(spark, _clouds(4000, 8, 5, groups=40))
    log = {}
    assert neighbours.nearest(df.filter("k % 20 = 0"), df, "k", "v", 5, block=64, log=log).count() == 1000
    assert log["compared"] < 0.1 * log["pairs"], log


def test_odd_vectors_have_no_neighbours(spark):
    rows = [("a", [0.0, 0.0]), ("b", [3.0, 4.0]), ("c", None), ("d", [float("nan"), 0.0]), ("e", [None, 1.0]), ("f", [0.0, float("inf")])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    found = neighbours.nearest(df, df, "k", "v", 3)
    assert sorted(map(tuple, found.collect())) == [("a", 1, "b", 5.0), ("b", 1, "a", 5.0)]
    assert neighbours.nearest(df, df.filter("k = 'c'"), "k", "v", 3).collect() == []
    assert neighbours.nearest(df.limit(0), df, "k", "v", 3).collect() == []


def _dbscan(x, names, eps, least):
    n = len(x)
    near = [np.flatnonzero(((x - x[i]) ** 2).sum(1) <= eps * eps) for i in range(n)]
    core = [len(m) >= least for m in near]
    label = {}
    for i in sorted(range(n), key=lambda i: names[i]):
        if not core[i] or i in label:
            continue
        todo, label[i] = [i], names[i]
        while todo:
            for j in near[todo.pop()]:
                if core[j] and j not in label:
                    label[j] = names[i]
                    todo.append(j)
    return {names[i]: label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=None) for i in range(n)}


@pytest.mark.parametrize("d, eps, least, block", [(1, 0.05, 4, 4096), (2, 0.3, 5, 8), (6, 1.1, 5, 4096), (12, 1.9, 4, 3)])
def test_dbscan_equals_brute_force(spark, d, eps, least, block):
    x = np.concatenate([_clouds(500, d, 3, spread=0.5), np.repeat(_clouds(2, d, 4), 20, axis=0), np.linspace(-9, -6, 60)[:, None] * np.eye(1, d) * 1.0])
    names = [f"p{k:04d}" for k in random.Random(6).sample(range(len(x)), len(x))]
    found = neighbours.dbscan(_frame(spark, x, names), "k", "v", eps, least, block=block)
    got = {r["k"]: r["cluster"] for r in found.collect()}
    expected = _dbscan(x, names, eps, least)
    assert got == expected
    assert len({c for c in expected.values()}) > 2 and None in expected.values()


def test_dbscan_without_rows_with_nulls_and_with_cores_only(spark):
    rows = [(1, 0.0, 0.0), (2, 0.1, 0.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    clusters = lambda least: {r["k"]: r["cluster"] for r in neighbours.dbscan(df, "k", ["x", "y"], 0.5, least).collect()}
    assert clusters(2) == {1: 1, 2: 1, 3: None, 4: None, 5: None} and clusters(1) == {1: 1, 2: 1, 3: None, 4: None, 5: 5}
    assert neighbours.dbscan(df.limit(0), "k", ["x", "y"], 0.5, 2).collect() == []


def test_a_dense_cell_of_100_000_points_needs_no_pairs(spark):
    """Two walls just too far apart, and a bridge from a third group to one of them."""
    ids = spark.range(100_000)
    near = ids.selectExpr("id AS k", "id % 331 / 331.0 * 0.3 AS x", "id % 7919 / 7919.0 * 0.3 AS y")
    far = ids.selectExpr("id + 100000 AS k", "id % 331 / 331.0 * 0.3 + 0.8 AS x", "id % 7919 / 7919.0 * 0.3 AS y")
    bridge = spark.createDataFrame([(200_000 + i, 0.15, 5.0 - 0.3 * i) for i in range(16)], "k long, x double, y double")
    log = {}
    found = neighbours.dbscan(near.unionByName(far).unionByName(bridge), "k", ["x", "y"], 0.45, 3, log=log)
    sizes = {r["cluster"]: r["count"] for r in found.groupBy("cluster").count().collect()}
    assert sum(sizes.values()) == 200_016 and len(sizes) == 2 and min(sizes.values()) >= 100_000
    assert log["asked"] < 100 and log["compared"] < 5000, log


def test_sets_that_touch():
    rng = np.random.default_rng(8)
    a, b = rng.uniform(size=(3000, 2)), rng.uniform(size=(3000, 2)) + [1.5, 0.0]
    least = min(np.sqrt(((a - v) ** 2).sum(1)).min() for v in b)
    assert neighbours.touch(a, b, least * 1.0001) and not neighbours.touch(a, b, least * 0.9999)


@pytest.mark.parametrize("d", [2, 7])
def test_pairs_within_a_distance(spark, d):
    x = _clouds(200, d, 9)
    found = {tuple(r) for r in neighbours.epsilon_pairs(_frame(spark, x), "k", "v", 0.8).collect()}
    assert found == {(i, j) for i in range(200) for j in range(i + 1, 200) if ((x[i] - x[j]) ** 2).sum() <= 0.64} and found


def _places(spark, d):
    """Points of a grid far from the origin, whose neighbours are at the distance exactly, copies, and very large vectors."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.integers(0, 3, size=(700, d)) + 1e6, np.repeat(rng.normal(size=(2, d)), 30, axis=0), rng.integers(0, 2, size=(6, d)) * 1e200])
    return x, _frame(spark, x)


def _within(x, reach):
    with np.errstate(over="ignore"):
        return [np.flatnonzero(((x - v) ** 2).sum(1) <= reach * reach) for v in x]


def test_points_in_many_dimensions_meet_without_being_joined(spark):
    """Pairs of points aren't rows of a join, and are those of sums of squares also where a product rounds."""
    x, df = _places(spark, 5)
    pairs = neighbours.epsilon_pairs(df, "k", "v", 1.0)
    assert "Join" not in pairs._jdf.queryExecution().toString()
    expected = {(i, j) for i, near in enumerate(_within(x, 1.0)) for j in near.tolist() if i < j}
    assert {tuple(r) for r in pairs.collect()} == expected and len(expected) > 700


def test_dbscan_in_many_dimensions_copies_no_points(spark, monkeypatch):
    """Points aren't sent to the blocks that they ask."""
    monkeypatch.setattr(neighbours, "_meet", lambda *args: pytest.fail("points were copied"))
    x, df = _places(spark, 5)
    with np.errstate(over="ignore"):
        expected = _dbscan(x, list(range(len(x))), 1.0, 9)
    assert {r["k"]: r["cluster"] for r in neighbours.dbscan(df, "k", "v", 1.0, 9, block=100).collect()} == expected
    assert len(set(expected.values())) > 3 and None in expected.values()


@pytest.mark.parametrize("d", [1, 3, 12])
def test_distances_and_bounds_of_many_rows(monkeypatch, d):
    """Bounds come without ordering all cells, also where the nearest cells hold few points."""
    rng = np.random.default_rng(d)
    x, centres = rng.normal(size=(700, d)), rng.normal(size=(90, d))
    away = neighbours._away(x, centres)
    assert np.allclose(away, np.sqrt(((x[:, None] - centres) ** 2).sum(2)), rtol=1e-14)
    assert neighbours._away(x[:0], centres).shape == (0, 90)
    for sizes in (np.ones(90), rng.integers(1, 9, 90).astype(float)):
        for n in (1, 6, 40, 90, 10_000):
            order = np.argsort(away, axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) >= n
            expected = [a[o[e.argmax()]] if e.any() else np.inf for a, o, e in zip(away, order, enough, strict=True)]
            assert neighbours._reached(away, sizes, n).tolist() == expected
