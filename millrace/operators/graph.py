"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import bounded, store

#: What is left of a graph is finished in one task when it has this many edges at most (each in both directions).
LAST_EDGES = 10_000

#: Bytes of a node with its root, by which joins are sized.
_ROW = 64


def _order(seed: int, node: str) -> Column:
    """A node with a random rank of its round in front."""
    return F.struct(F.xxhash64(F.lit(seed), F.col(node)).alias("h"), F.col(node).alias("id"))


def _roots(edges: DataFrame, seed: int) -> DataFrame:
    """node and root of one round, stored.

    Each node points to the lowest-ranked node within two steps of it, so it stays only if that is itself. Pointers lead
    down in rank; they are followed to their ends by doubling.
    """
    own = edges.groupBy("a").agg(F.least(_order(seed, "a"), F.min(_order(seed, "b"))).alias("low"))
    own = store(own.select(F.col("a").alias("node"), "low"))
    near = edges.join(bounded(own, _ROW), F.col("b") == F.col("node")).groupBy("a").agg(F.min("low").alias("low"))
    to = store(near.select(F.col("a").alias("node"), F.col("low.id").alias("root")))
    while True:
        up = to.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        ahead = store(to.join(bounded(up, _ROW), F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")))
        to = ahead.select("node", "root")
        if ahead.filter("moved").isEmpty():
            return to


def _finish(edges: DataFrame) -> DataFrame:
    """node and root of a small graph, in one task."""
    kind = dict(edges.dtypes)["a"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                one, two = top(a), top(b)
                up[max(one, two)] = min(one, two)
        if schema is not None:
            nodes = list(up)
            arrays = [pa.array(nodes, type=schema.field(0).type), pa.array([top(x) for x in nodes], type=schema.field(0).type)]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "root"])

    return store(edges.coalesce(1).mapInArrow(join, f"node {kind}, root {kind}"))


def connected_components(edges: DataFrame, seed: int = 0, last_edges: int = LAST_EDGES, log: list[int] | None = None) -> DataFrame:
    """node and component (the smallest node that it is connected to) of each node of the edges (a, b), of any type.

    A round contracts each node into the lowest-ranked node within two steps, by ranks drawn anew in each round, and goes on
    with the edges between different ones. A node that has an edge stays with a probability of a half at most, whatever the
    graph: so the number of rounds is logarithmic in that of the nodes (a path shrinks to about a fifth in a round), and
    what they read shrinks likewise. Then the rounds' pointers are followed from the last one back.

    Self-loops and edges with nulls are left out. Joins are with tables whose size is checked, or shuffles that the engine
    splits where a key is hot. ``log`` receives the edges at the start of each round (in both directions).
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    left, rounds = store(both), []
    while True:
        n = left.count()
        if log is not None:
            log.append(n)
        if n <= last_edges:
            rounds.append(_finish(left))
            break
        to = _roots(left, seed + len(rounds))
        rounds.append(to)
        for end in ("a", "b"):
            at = bounded(to, _ROW)
            left = left.join(at, F.col(end) == F.col("node")).withColumn(end, F.col("root")).select("a", "b")
        left = store(left.filter("a <> b").distinct())
    found = rounds.pop()
    while rounds:
        last = bounded(found.select(F.col("node").alias("_n"), F.col("root").alias("_r")), _ROW)
        found = store(rounds.pop().join(last, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")))
    least = found.groupBy(F.col("root").alias("_c")).agg(F.min("node").alias("component"))
    return store(found.join(bounded(store(least), _ROW), F.col("root") == F.col("_c")).select("node", "component"))
