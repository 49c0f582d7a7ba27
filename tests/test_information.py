"""Mutual information by nearest neighbours and running sums against plain computations."""

import math

import numpy as np
import pytest

from millrace.functions import ranks, stats
from millrace.operators import features


def test_digamma():
    assert stats.digamma(np.array([1.0, 2.0, 10.5, 1e6])) == pytest.approx([-0.5772156649015329, 0.42278433509846714, 2.3030010342976547, math.log(1e6) - 5e-7], abs=1e-10)


def _expected(x, y, k):
    n, radius, ks, sizes = len(x), np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    keep = np.array([np.sum(y == c) > 1 for c in y])
    for i in np.flatnonzero(keep):
        own = np.sort(np.abs(x[(y == y[i]) & (np.arange(n) != i)] - x[i]))
        ks[i], sizes[i] = min(k, len(own)), len(own) + 1
        radius[i] = own[int(ks[i]) - 1]
    x, radius, ks, sizes = (a[keep] for a in (x, radius, ks, sizes))
    m = np.array([np.sum(np.abs(x - v) < r) if r > 0 else np.sum(x == v) for v, r in zip(x, radius, strict=True)])
    psi = lambda a: np.mean(stats.digamma(np.asarray(a, dtype=float)))
    return max(0.0, psi([len(x)]) + psi(ks) - psi(sizes) - psi(m))


@pytest.mark.parametrize("cell_rows", [7, 50_000])
def test_neighbour_information_equals_brute_force(spark, cell_rows):
    """With tied values, nulls, a class of one row, one smaller than k, and cells far smaller than a class."""
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.integers(3, size=150), [7], [8, 8]])
    x = np.stack([rng.normal(size=153) + y, rng.normal(size=153), np.round(rng.normal(size=153) + y, 1), 1e6 + rng.normal(size=153) * 1e-3], 1)
    rows = [(*map(float, v), int(c)) for v, c in zip(x, y, strict=True)] + [(None, float("nan"), 0.5, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y int").repartition(4)
    found = {r["feature"]: r["mi"] for r in features.neighbour_information(df, ["a", "b", "c", "d"], "y", cell_rows=cell_rows).collect()}
    for i, name in enumerate("abcd"):
        assert found[name] == pytest.approx(_expected(x[:, i], y, 3), abs=1e-9), name
    assert found["a"] > 0.3 > 0.2 > found["b"]


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v), int(w)) for g, v, w in zip(rng.integers(3, size=500), np.round(rng.normal(size=500), 1), rng.integers(5, size=500), strict=True)]
    found = ranks.running_sums(spark.createDataFrame(rows, "g int, v double, w int").repartition(6), ["g"], ["v", "w"], "w").collect()
    for r in found:
        before = [w for g, v, w in rows if g == r["g"] and (v, w) < (r["v"], r["w"])]
        ties = sum(1 for x in rows if x == (r["g"], r["v"], r["w"]))
        assert sum(before) <= r["before"] <= sum(before) + (ties - 1) * r["w"]
    assert len({(r["g"], r["before"], r["v"], r["w"]) for r in found if r["w"]}) == sum(1 for x in rows if x[2])


def test_quantiles_by_cells_of_any_distribution(spark, monkeypatch):
    """Far outliers, one value, ties, infinities and several counts of a crowded cell give the exact quantiles."""
    monkeypatch.setattr(ranks, "SMALL_ROWS", 0)
    monkeypatch.setattr(ranks, "CELL_ROWS", 40)
    monkeypatch.setattr(ranks, "FINE", 8)
    rng = np.random.default_rng(4)
    columns = {
        "crowded": np.concatenate([rng.normal(size=900), [1e300, -1e300, 1e9]]), "one": np.full(200, 3.25), "tied": np.round(rng.normal(size=500), 1),
        "infinite": np.concatenate([rng.normal(size=100), [np.inf] * 60, [-np.inf] * 3]), "two": np.array([1.0, 2.0]), "single": np.array([7.0]),
    }
    rows = [(c, float(v)) for c, x in columns.items() for v in x] + [("none", None), (None, 5.0), (None, 6.0)]
    points = [0.0, 0.25, 0.5, 0.77, 1.0]
    found = {r["column"]: r["q"] for r in ranks.exact_quantiles(spark.createDataFrame(rows, "column string, value double").repartition(3), points).collect()}
    assert set(found) == {*columns, None} and found[None] == [5.0, 5.25, 5.5, 5.77, 6.0]
    for c, x in columns.items():
        x = np.sort(x)
        for p, q in zip(points, found[c], strict=True):
            low, high = x[math.floor((len(x) - 1) * p)], x[math.ceil((len(x) - 1) * p)]
            exact = (len(x) - 1) * p
            expected = low if low == high else low + (high - low) * (exact - math.floor(exact))
            assert q == pytest.approx(expected, nan_ok=True) or (math.isinf(low) and math.isnan(q)), (c, p)
