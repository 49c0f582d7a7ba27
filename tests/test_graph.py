"""Connected components against a plain union of sets, on graphs that are hard for labels that travel."""

import random

import pytest

from millrace.operators import graph


def _expected(edges):
    up = {}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        up.setdefault(a, a)
        up.setdefault(b, b)
        one, two = top(a), top(b)
        up[max(one, two)] = min(one, two)
    return {x: top(x) for x in up}


def _path(names):
    return list(zip(names[:-1], names[1:], strict=True))


def _graphs(n):
    draw = random.Random(4)
    shuffled = draw.sample(range(n), n)
    hubs = draw.sample(range(n), n // 100)  # a path of stars, whose hubs are in no order
    leaves = [(h, n + 99 * k + i) for k, h in enumerate(hubs) for i in range(99)]
    return {
        "descending": _path([0, *range(n - 1, 0, -1)]),
        "shuffled": _path(shuffled),
        "stars": leaves + _path(hubs),
        "one star": [(n // 2, x) for x in range(n) if x != n // 2],
        "mixed": _path(shuffled[: n // 2]) + [(draw.randrange(n, 3 * n), draw.randrange(n, 3 * n)) for _ in range(n // 2)],
    }


@pytest.mark.parametrize("name", ["descending", "shuffled", "stars", "one star", "mixed"])
def test_ten_thousand_nodes_settle_in_few_rounds(spark, name):
    edges = _graphs(10_000)[name]
    log = []
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), last_edges=0, log=log)
    assert {r["node"]: r["component"] for r in found.collect()} == _expected(edges)
    assert len(log) - 1 <= 9, log  # the last entry is the empty graph


def test_a_small_rest_is_finished_in_one_task(spark):
    edges = _graphs(10_000)["shuffled"]
    log = []
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), last_edges=3000, log=log)
    assert {r["node"]: r["component"] for r in found.collect()} == _expected(edges)
    assert 2 <= len(log) <= 3 and log[-1] <= 3000


def test_odd_edges_and_other_types(spark):
    edges = [("b", "a"), ("b", "a"), ("c", "b"), ("é", "z"), ("x", "x"), (None, "a"), ("q", None)]
    for last in (0, 100):
        found = graph.connected_components(spark.createDataFrame(edges, "a string, b string"), last_edges=last)
        assert {r["node"]: r["component"] for r in found.collect()} == {"a": "a", "b": "a", "c": "a", "z": "z", "é": "z"}
        assert graph.connected_components(spark.createDataFrame([], "a long, b long"), last_edges=last).collect() == []
