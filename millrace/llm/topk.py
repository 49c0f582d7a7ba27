"""Exact top-k inner products over norm-sorted vectors.

Vectors are binned by length, longest first. The first block gives each query a score to beat. A bin is left out for a
query if the product of its greatest length and the query's is below that score; in the others, vectors are taken longest
first in chunks, and a chunk's products start with a few coordinates along the top singular directions: Cauchy-Schwarz on
what is left bounds the rest, and only vectors whose bound reaches the score to beat are multiplied out.

Products are those of the integer vectors; the rotated sums only choose what to multiply out, with a margin for rounding.
Queries and vectors meet in blocks of bounded size, each pair of blocks in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, materialize, store

#: Vectors of a block, queries of a block, bins of length, leading coordinates of the rotation, vectors of a chunk.
BLOCK_ROWS, QUERY_ROWS, BINS, LEADING, CHUNK = 8192, 1024, 64, 16, 2048

#: Largest sum that doubles hold exactly.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """vec_id, floor(scale * x) of each component (as doubles, which hold it exactly) and length; unusable rows are left out."""
    xs = F.col(vector).cast("array<double>")
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(F.filter(F.col(vector).cast("array<double>"), lambda x: x.isNotNull()), lambda x: x * scale)
    out = rows.filter(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), ints.alias("_x"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [np.floor(np.asarray(x, dtype=np.float64)) for x in batch.column(1).to_pylist()]
            lengths = [float(np.sqrt(np.dot(x, x))) if x.size else 0.0 for x in xs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, type=pa.list_(pa.float64())), pa.array(lengths, type=pa.float64())], names=["vec_id", "v", "length"])

    return out.mapInArrow(floors, "vec_id long, v array<double>, length double")


def rotation(vectors: DataFrame) -> np.ndarray:
    """Right singular vectors of the table, strongest first, from its second moments; components that are missing are 0.

    Partial sums are d x d for vectors of d components, whatever the number of rows.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            m = padded(batch.column(0).to_pylist())
            size = max(total.shape[0], m.shape[1])
            total = np.pad(total, (0, size - total.shape[0]))
            total[: m.shape[1], : m.shape[1]] += m.T @ m
        if total.size:
            place = np.arange(total.size)
            columns = [pa.array(place // total.shape[0], type=pa.int32()), pa.array(place % total.shape[0], type=pa.int32()), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "s"])

    sums = vectors.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if sums.empty:
        return np.zeros((0, 0))
    gram = np.zeros((int(sums["i"].max()) + 1,) * 2)
    gram[sums["i"], sums["j"]] = np.nan_to_num(sums["s"], posinf=1e300)
    return np.linalg.eigh((gram + gram.T) / max(1.0, np.abs(gram).max()))[1][:, ::-1].copy()


def padded(vectors: list, width: int = 0) -> np.ndarray:
    """The vectors as rows of one matrix, short ones filled up with zeros."""
    width = max([width, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def best_in_block(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, to_beat: np.ndarray, k: int, turn: np.ndarray) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in a block, ties to the smaller id; those below ``to_beat`` may be missing."""
    width = max(block.shape[1], queries.shape[1], turn.shape[0])
    block, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (block, queries))
    turn = np.pad(turn, (0, width - turn.shape[0])) + np.diag([0.0] * turn.shape[0] + [1.0] * (width - turn.shape[0]))
    exact = width == 0 or np.abs(block).max(initial=0) * np.abs(queries).max(initial=0) * width < _EXACT
    lengths = np.sqrt((block * block).sum(1))
    order = np.lexsort((ids, -lengths))
    ids, block, lengths = ids[order], block[order], lengths[order]
    lead = min(LEADING, width)
    rotated, turned = block @ turn[:, :lead], queries @ turn[:, :lead]
    q_length = np.sqrt((queries * queries).sum(1))
    rest = np.sqrt(np.maximum(lengths**2 - (rotated**2).sum(1), 0))
    q_rest = np.sqrt(np.maximum(q_length**2 - (turned**2).sum(1), 0))
    best_s = np.full((len(queries), k), -np.inf)
    best_i = np.full((len(queries), k), _LONG, dtype=np.int64)
    to_beat = to_beat.astype(float).copy()
    if not exact:  # integers beyond doubles: Python's own, each product in full
        big, asked = [[int(x) for x in row] for row in block], [[int(x) for x in row] for row in queries]
        out = []
        for q, own in zip(asked, query_ids, strict=True):
            scored = sorted((-sum(a * b for a, b in zip(q, row, strict=True)), int(i)) for i, row in zip(ids, big, strict=True) if i != own)[:k]
            out += [(int(own), i, max(-_LONG, min(_LONG, -s))) for s, i in scored]
        return out
    for at in range(0, len(ids), CHUNK):
        part = slice(at, at + CHUNK)
        margin = 1e-9 * (1 + q_length * lengths[at])
        live = np.flatnonzero(q_length * lengths[at] + margin >= to_beat)
        if not live.size:
            break
        bound = turned[live] @ rotated[part].T + np.outer(q_rest[live], rest[part]) + margin[live, None]
        maybe = (bound >= to_beat[live, None]).any(0)
        if not maybe.any():
            continue
        place = at + np.flatnonzero(maybe)
        scores = queries[live] @ block[place].T
        scores[ids[place][None, :] == query_ids[live, None]] = -np.inf
        scores = np.concatenate([best_s[live], scores], axis=1)
        owners = np.concatenate([best_i[live], np.broadcast_to(ids[place], (live.size, place.size))], axis=1)
        top = np.lexsort((owners, -scores), axis=1)[:, :k]
        best_s[live], best_i[live] = np.take_along_axis(scores, top, 1), np.take_along_axis(owners, top, 1)
        to_beat[live] = np.maximum(to_beat[live], best_s[live, -1])
    found = np.isfinite(best_s)
    return [(int(query_ids[q]), int(best_i[q, j]), int(best_s[q, j])) for q, j in zip(*np.nonzero(found), strict=True)]


def search(rows: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The k greatest integer inner products of each query with every other row: query_id, rank, vec_id, score.

    Queries are the rows where ``asked`` (on the column vec_id) holds. Ids or vectors that are null, and vectors with a
    null or non-finite component, take no part. Vectors of unlike lengths are filled up with zeros. Rows that share a
    query's id count as its own; a repeated query id asks once, with the least of its vectors. Other repeated rows are
    candidates one by one. Scores beyond a long stop at its ends. An empty table gives an empty result.
    """
    vectors = materialize(whole_vectors(rows, key, vector, scale))
    turn = rotation(vectors)
    total = vectors.count()
    bins = max(1, min(BINS, -(-total // BLOCK_ROWS)))
    cuts = vectors.agg(F.percentile_approx("length", [i / bins for i in range(bins - 1, 0, -1)] or [0.0]).alias("c")).collect()[0]["c"] or []
    cuts = list(cuts) if bins > 1 else []
    bin_of = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: F.col("length") < c)) if cuts else F.lit(0)
    binned = vectors.withColumn("bin", bin_of.cast("int"))
    found = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).collect()  # BINS rows
    parts = {r["bin"]: -(-r["n"] // BLOCK_ROWS) for r in found}
    most = {r["bin"]: r["most"] for r in found}
    if not parts:
        parts, most = {0: 1}, {0: 0.0}
    first = min(parts)
    parts_of = F.element_at(F.create_map(*[F.lit(x) for b, n in parts.items() for x in (b, n)]), F.col("bin"))
    binned = binned.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts_of).cast("int"))

    queries = binned.filter(asked).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    queries = queries.withColumn("q_length", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)))
    queries = materialize(queries.withColumn("q_group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        got = best_in_block(left["vec_id"].to_numpy(), padded(list(left["v"])), right["query_id"].to_numpy(), padded(list(right["q"])), right["to_beat"].to_numpy(), k, turn)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

    def met(blocks: DataFrame, asking: DataFrame) -> DataFrame:
        """Vectors go only to the groups with a query that still asks their part."""
        on = ["bin", "part", "q_group"]
        asked_by = store(asking.select("bin", "part", "q_group").distinct())
        dealt = blocks.join(bounded(asked_by, 32), ["bin", "part"])
        return dealt.groupBy(*on).cogroup(asking.groupBy(*on)).applyInPandas(meet, "query_id long, vec_id long, score long")

    columns = ["bin", "part", "q_group", "query_id", "q", "to_beat"]
    start = (F.col("bin") == first) & (F.col("part") == 0)
    seeds = queries.withColumns({"bin": F.lit(first), "part": F.lit(0), "to_beat": F.lit(float("-inf"))}).select(*columns)
    seeded = materialize(met(binned.filter(start), seeds))
    floor = seeded.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_s"))
    asking = queries.join(floor, F.col("query_id") == F.col("_q"), "left")
    asking = asking.withColumn("to_beat", F.when(F.col("_n") >= k, F.col("_s").cast("double")).otherwise(F.lit(float("-inf"))))
    # A bin stays for a query if its longest vector could reach the score to beat; there are at most BINS of them.
    places = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(n).alias("parts"), F.lit(float(most[b])).alias("most")) for b, n in sorted(parts.items())])
    reach = F.filter(places, lambda p: F.col("q_length") * p["most"] * (1 + 1e-9) + 1e-6 >= F.col("to_beat"))
    asking = asking.withColumn("place", F.explode(reach)).withColumn("bin", F.col("place.bin"))
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("place.parts") - 1)))
    asking = asking.filter(~start).select(*columns)
    scored = seeded.unionByName(met(binned.filter(~start), asking))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
