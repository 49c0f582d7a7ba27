"""Exact nearest neighbours by pivots, pairs within a distance, and DBSCAN on a graph of cells; in any dimension.

Points are kept in blocks of bounded size, which stay where they are: what travels is the point that asks, to the blocks
that can hold an answer for it. A block that very many points ask is copied once for every ``ASKED`` of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import bounded, store
from . import allpairs
from .graph import connected_components
from .metrics import distance2

#: Points of a block, and points that ask one copy of it.
BLOCK, ASKED = 4096, 4096

#: Most pivots; there are as many as the root of the points, up to this.
PIVOTS = 1024

#: Relative and absolute room for rounding in bounds (not in answers).
_SLACK = 1e-9


def _vectors(df: DataFrame, key: str, vector: str | list[str], name: str) -> DataFrame:
    """The key and the vector, as doubles, of rows whose vector has only finite components."""
    v = F.array(*[F.col(c) for c in vector]) if isinstance(vector, list) else F.col(vector)
    rows = df.select(F.col(key).alias(name), v.cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _away(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of points from centres."""
    out = np.empty((len(x), len(centres)))
    few = 1 if centres.shape[1] > 8 else 256
    for at in range(0, len(x), few):
        some = x[at : at + few]
        if few == 1:
            out[at] = np.sqrt(((centres - some[0]) ** 2).sum(1))
            continue
        total = np.zeros((len(some), len(centres)))
        for c in range(centres.shape[1]):  # a component at a time, so that no row of few numbers is added up alone
            step = some[:, c, None] - centres[:, c]
            step *= step
            total += step
        np.sqrt(total, out=out[at : at + few])
    return out


def _reached(reach: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Of each row, the least reach within which cells hold n points; infinite where all of them don't."""
    bound, open_, most = np.full(len(reach), np.inf), np.arange(len(reach)), 16
    while open_.size and sizes.sum() >= n:
        rows = reach[open_]
        near = np.argpartition(rows, most - 1, axis=1)[:, :most] if most < rows.shape[1] else np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
        values = np.take_along_axis(rows, near, 1)
        order = np.argsort(values, axis=1)
        enough = np.cumsum(sizes[np.take_along_axis(near, order, 1)], axis=1) >= n
        done = enough.any(1)
        bound[open_[done]] = np.take_along_axis(values, order, 1)[done, enough.argmax(1)[done]]
        open_, most = open_[~done], 4 * most
    return bound


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _meet(asked: DataFrame, blocks: DataFrame, by: str, answer: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``answer`` for the asking rows (block, ``by``, ...) of each block and the block's own row, up to ``ASKED`` rows at a time."""
    asked = store(asked)
    shares = asked.groupBy(F.col("block").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_shares"))
    shares = bounded(store(shares), 24)
    one = asked.join(shares, F.col("block") == F.col("_b")).withColumn("_share", F.pmod(F.xxhash64(by), F.col("_shares")).cast("int")).drop("_b", "_shares")
    two = blocks.join(shares, F.col("block") == F.col("_b")).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_b", "_shares")
    return one.groupBy("block", "_share").cogroup(two.groupBy("block", "_share")).applyInArrow(lambda left, right: answer(left, right), schema)


def nearest(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int = 5, pivots: int | None = None, block: int = BLOCK, log: dict | None = None) -> DataFrame:
    """Exact k nearest points of each query: key, rank, near_key, distance (ties to the smaller key).

    Each point belongs to its nearest pivot, in a block of points of a similar distance to it. A query asks a block of its
    own pivot first, which bounds the distance of its k-th neighbour; then only blocks that the triangle inequality doesn't
    rule out: by the block's distances to its pivot, and as a point is never nearer to another pivot than to its own.
    Vectors that are null or hold null or non-finite components take no part; a point isn't its own neighbour. ``log``
    receives the points compared and all pairs.
    """
    kind = dict(queries.dtypes)[key]
    own, asked = store(_vectors(points, key, vector, "p")), store(_vectors(queries, key, vector, "q"))
    n = own.count()
    most = pivots or (1 if n <= block else min(PIVOTS, math.isqrt(n)))
    drawn = own.orderBy(F.xxhash64("p"), "p").limit(most).select("v").collect()  # a pivot a row, PIVOTS at most
    centres = np.array([r["v"] for r in drawn]) if drawn else np.zeros((1, 1))
    room = _SLACK * (1.0 + float(np.abs(centres).max()))

    def away(x: np.ndarray) -> np.ndarray:
        return _away(x, centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = away(_matrix(batch.column(1)))
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, type=pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["p", "v", "cell", "r"])

    placed = store(own.mapInArrow(place, f"p {kind}, v array<double>, cell int, r double"))
    cells = store(placed.groupBy(F.col("cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.min("r").alias("_low"), F.max("r").alias("_high")))
    known = cells.orderBy("_c").collect()  # a row a pivot
    ids = np.array([r["_c"] for r in known], dtype=int)
    sizes, low, high = (np.array([r[c] for r in known], dtype=float) for c in ("_n", "_low", "_high"))

    # Rings of a cell, by distance to the pivot, and parts of rings that hold more points than a block.
    rings = F.ceil(F.col("_n") / block)
    ring = F.when(F.col("_high") > F.col("_low"), F.least(rings - 1, F.floor((F.col("r") - F.col("_low")) / (F.col("_high") - F.col("_low")) * rings))).otherwise(F.lit(0))
    ringed = placed.join(F.broadcast(cells), F.col("cell") == F.col("_c")).select("p", "v", "r", "cell", ring.cast("long").alias("ring"))
    full = ringed.groupBy(F.col("cell").alias("_c"), F.col("ring").alias("_r")).agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts")).filter("_parts > 1")
    parted = ringed.join(bounded(store(full), 32), (F.col("cell") == F.col("_c")) & (F.col("ring") == F.col("_r")), "left")
    part = F.pmod(F.xxhash64("p"), F.coalesce("_parts", F.lit(1)))
    blocks = parted.groupBy("cell", "ring", part.alias("part")).agg(F.collect_list(F.struct("p", "r", "v")).alias("members"), F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    blocks = store(blocks.withColumn("block", F.monotonically_increasing_id()))
    summary = store(blocks.select("block", F.col("cell").alias("_cell"), "low", "high", "n"))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's own cell, and a bound of its k-th distance from the cells' sizes alone."""
        for batch in batches:
            d = away(_matrix(batch.column(1)))[:, ids]
            bound = _reached(d + high, sizes, k + 1)
            near = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids[near], type=pa.int32()), pa.array(d[np.arange(len(d)), near]), pa.array(bound)], names=["q", "v", "cell", "away", "bound"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that may hold a point within a query's bound."""
        for batch in batches:
            d, bound = away(_matrix(batch.column(1)))[:, ids], batch.column(2).to_numpy(zero_copy_only=False)
            least = np.maximum(np.maximum(d - high, low - d), (d - d.min(1, initial=np.inf)[:, None]) / 2)
            row, cell = np.nonzero(least <= (bound + room)[:, None] * (1 + _SLACK))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(ids[cell], type=pa.int32()), pa.array(d[row, cell]), pa.array(bound[row])], names=["q", "v", "cell", "away", "bound"])

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            members = _column(right, "members").flatten()
            names, r, x = np.array(members.field("p").to_pylist()), members.field("r").to_numpy(), _matrix(members.field("v"))
            order = np.argsort(names, kind="stable")
            names, r, x = names[order], r[order], x[order]
            rows = zip(left.column("q").to_pylist(), _matrix(_column(left, "v")), left.column("away").to_pylist(), left.column("bound").to_pylist(), strict=True)
            for q, v, at, bound in rows:
                wide = bound * (1 + _SLACK) + room
                some = np.flatnonzero((np.abs(r - at) <= wide) & (names != q))
                d = np.sqrt(((x[some] - v) ** 2).sum(1))
                # Points are in key order and the sort is stable, so ties go to the smaller key.
                best = np.argsort(d, kind="stable")[:k]
                best = best[d[best] <= wide]
                out[0].extend([q] * len(best))
                out[1].extend(names[some[best]].tolist())
                out[2].extend(d[best].tolist())
        return pa.table([pa.array(out[0], type=left.schema.field("q").type), pa.array(out[1], type=left.schema.field("q").type), pa.array(out[2], type=pa.float64())], names=["q", "p", "distance"])

    schema, rows = f"q {kind}, p {kind}, distance double", f"q {kind}, v array<double>, cell int, away double, bound double"
    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("away"), F.col("away") - F.col("high"))
    first = asked.mapInArrow(home, rows) if known else asked.select("q", "v", F.lit(0).alias("cell"), F.lit(0.0).alias("away"), F.lit(0.0).alias("bound")).limit(0)
    first = store(first)
    met = first.join(bounded(summary, 48), F.col("cell") == F.col("_cell")).withColumn("gap", gap)
    before = Window.partitionBy("q").orderBy("gap", "block").rowsBetween(Window.unboundedPreceding, -1)  # the blocks of a query's own cell
    met = met.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("_before") < k + 1)
    found = _meet(met.select("block", "q", "v", "away", "bound"), blocks, "q", visit, schema)
    rank = Window.partitionBy("q").orderBy("distance", "p")  # at most k a block

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(F.col("q").alias(key), "rank", F.col("p").alias("near_key"), "distance")

    if log is None and summary.count() <= 1:  # there is nothing else to ask
        return ranked(found)
    kth = found.groupBy(F.col("q").alias("_q")).agg(F.get(F.array_sort(F.collect_list("distance")), F.lit(k - 1)).alias("_kth"))
    bound = first.join(store(kth), F.col("q") == F.col("_q"), "left").select("q", "v", F.least("bound", F.coalesce("_kth", F.lit(float("inf")))).alias("bound"))
    second = (bound.mapInArrow(others, rows) if known else first).join(bounded(summary, 48), F.col("cell") == F.col("_cell"))
    second = store(second.filter(gap <= F.col("bound") * (1 + _SLACK) + room).select("block", "q", "v", "away", "bound", "n"))
    if log is not None:
        log |= {"compared": second.agg(F.sum("n")).first()[0] or 0, "pairs": n * asked.count()}
    return ranked(_meet(second.drop("n"), blocks, "q", visit, schema))


def nearest_vote(queries: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """key and prediction: the most frequent label of the k nearest train rows (ties to the smaller label)."""
    near = nearest(queries, train, key, vector, k).join(train.select(F.col(key).alias("near_key"), F.col(label).alias("_label")), "near_key")
    votes = near.groupBy(key, "_label").agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(key).agg(F.min_by("_label", F.struct(-F.col("_n"), F.col("_label"))).alias("prediction"))


def nearest_mean(queries: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """key and prediction: the mean label of the k nearest train rows."""
    near = nearest(queries, train, key, vector, k).join(train.select(F.col(key).alias("near_key"), F.col(label).alias("_label")), "near_key")
    return near.groupBy(key).agg(F.avg("_label").alias("prediction"))


def _bands(v: Column, d: int, side: float) -> Column:
    """The band of a vector along up to three directions at right angles, ``side`` wide.

    A projection brings no two points further apart, so points within ``side`` are in bands that are the same or next to
    each other along each direction, in any dimension. Beyond three dimensions the directions are drawn by a fixed seed.
    """
    ways = np.eye(d) if d <= 3 else np.linalg.qr(np.random.default_rng(7).normal(size=(d, 3)))[0].T
    at = [F.get(v, F.lit(i)) if d <= 3 else F.aggregate(F.zip_with(v, F.array(*map(F.lit, way.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for i, way in enumerate(ways)]
    return F.array(*[F.floor(x / side) for x in at])


def _beside(bands: Column, n: int) -> Column:
    """The bands of ``n`` directions, one place longer at a time by each of the three neighbouring coordinates."""

    def longer(near: Column, at: Column) -> Column:
        steps = F.array(*[F.array(at + o) for o in (-1, 0, 1)])
        return F.flatten(F.transform(near, lambda p: F.transform(steps, lambda s: F.concat(p, s))))

    near = F.array(F.array().cast("array<bigint>"))
    for i in range(n):
        near = longer(near, F.get(bands, F.lit(i)))
    return near


def _dimensions(rows: DataFrame) -> tuple[int, int]:
    """The most and the least components of a vector."""
    most, least = rows.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    return most or 1, least or 0


def epsilon_pairs(df: DataFrame, key: str, columns: str | list[str], eps: float = 0.5) -> DataFrame:
    """Pairs (a, b), a < b, of points within ``eps``; exact in any dimension.

    Up to three dimensions neighbouring bands are joined; beyond, blocks of points meet those near them (see ``allpairs``).
    ``columns`` are numeric ones, or one column of vectors. Rows with null or non-finite components take no part.
    """
    point = _vectors(df, key, columns, "k")
    d, least = (len(columns), len(columns)) if isinstance(columns, list) else _dimensions(point)
    if d > 3 and d == least:
        return _pairs_of_blocks(point, d, eps)
    point = point.withColumn("c", _bands(F.col("v"), d, eps * (1 + _SLACK)))
    left = point.select(F.col("k").alias("a"), F.col("v").alias("av"), "c")
    right = point.select(F.col("k").alias("b"), F.col("v").alias("bv"), F.explode(_beside(F.col("c"), min(d, 3))).alias("c"))
    return left.join(right, "c").filter((F.col("a") < F.col("b")) & (distance2(F.col("av"), F.col("bv")) <= eps * eps)).select("a", "b")


def _arranged(point: DataFrame, d: int, eps: float, size: int | None = None) -> tuple[allpairs.Blocks, list[list[int]]]:
    """Blocks of points that are near each other, and those that each has to meet."""
    found = allpairs.blocks(point, d, [_bands(F.col("v"), d, 2 * eps), F.xxhash64("k")], size)
    return found, allpairs.beside(found, d, eps)


def _pairs_of_blocks(point: DataFrame, d: int, eps: float) -> DataFrame:
    """Pairs of points (k, v) within ``eps``: a block meets itself and the blocks after it."""
    kind = dict(point.dtypes)["k"]
    found, near = _arranged(point, d, eps)

    def pairs(i: int) -> Iterator[pa.RecordBatch]:
        mine = found.read(i)
        x, names = allpairs.matrix(mine), _column(mine, "k")
        for j in (j for j in near[i] if j >= i):
            other = mine if j == i else found.read(j)
            y, others = allpairs.matrix(other), _column(other, "k")
            for one, two in allpairs.near_pairs(x, y, eps):
                if j == i:
                    one, two = one[one < two], two[one < two]
                a, b = names.take(pa.array(one)), others.take(pa.array(two))
                first = pc.less(a, b)
                both = pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a)], names=["a", "b"])
                yield both.filter(pc.not_equal(a, b))

    return found.each(pairs, f"a {kind}, b {kind}")


def touch(a: np.ndarray, b: np.ndarray, reach: float) -> bool:
    """Whether a point of one set is within ``reach`` of one of the other: sets are halved while their boxes leave it open."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        (a_low, a_high), (b_low, b_high) = ((x.min(0), x.max(0)) for x in (a, b))
        if (np.maximum(np.maximum(a_low - b_high, b_low - a_high), 0) ** 2).sum() > reach * reach * (1 + _SLACK):
            continue
        if (np.maximum(a_high - b_low, b_high - a_low) ** 2).sum() <= reach * reach * (1 - _SLACK):
            return True
        if len(a) * len(b) <= 4096:
            if (((a[:, None] - b[None]) ** 2).sum(2) <= reach * reach).any():
                return True
            continue
        if len(a) < len(b):
            a, b, a_low, a_high = b, a, b_low, b_high
        way = int((a_high - a_low).argmax())
        order = np.argsort(a[:, way], kind="stable")
        todo += [(a[order[: len(a) // 2]], b), (a[order[len(a) // 2 :]], b)]
    return False


def _gap2(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Squared distance between two boxes."""
    apart = F.zip_with(F.zip_with(a_low, b_high, lambda x, y: x - y), F.zip_with(b_low, a_high, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def _span2(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Squared distance of the two points of two boxes that are furthest apart, or more."""
    apart = F.zip_with(F.zip_with(a_high, b_low, lambda x, y: x - y), F.zip_with(b_high, a_low, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def _blocks(rows: DataFrame, side: float, block: int) -> DataFrame:
    """Blocks of the points (cell, band, n, k, v, tag) of each cell and band with n points: block, cell, band, n, members, low, high.

    Where there are more points than a block takes, finer cells come first.
    """
    fine = F.when(F.col("n") > block, F.transform("v", lambda x: F.floor(4 * x / side)))
    rows = rows.withColumn("fine", fine)
    by = ["cell", "band", "fine"]
    full = rows.filter("fine IS NOT NULL").groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts")).filter("_parts > 1")
    rows = rows.join(bounded(store(full), 96), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left")
    part = F.pmod(F.xxhash64("k"), F.coalesce("_parts", F.lit(1)))
    made = rows.groupBy(*by, part.alias("part")).agg(F.collect_list(F.struct("k", "v", "tag")).alias("members")).select("cell", "band", "members")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(2)
            found = [_matrix(members[i].values.field("v")) for i in range(len(members))]
            low, high = ([f(x, axis=0).tolist() for x in found] for f in (np.min, np.max))
            boxed = [pa.array([len(x) for x in found], type=pa.int64()), pa.array(low, type=pa.list_(pa.float64())), pa.array(high, type=pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *boxed], names=["cell", "band", "members", "n", "low", "high"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in made.dtypes)
    return store(made.mapInArrow(boxes, f"{kinds}, n long, low array<double>, high array<double>").withColumn("block", F.monotonically_increasing_id()))


def _near(eps: float, make: Callable[[pa.Table], tuple[Callable[[int, np.ndarray, list], None], list[list], pa.Schema]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """An answer made of each asking row's number, the block's members within ``eps`` of it, and the members' tags."""

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        take, out, schema = make(left)
        if left.num_rows and right.num_rows:
            members = _column(right, "members").flatten()
            x, tags = _matrix(members.field("v")), members.field("tag").to_pylist()
            for i, v in enumerate(_matrix(_column(left, "v"))):
                near = np.flatnonzero(((x - v) ** 2).sum(1) <= eps * eps)
                if near.size:
                    take(i, near, tags)
        return pa.table([pa.array(c, type=t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return answer


def _counts(left: pa.Table):
    """k and c: how many members are near."""
    names, out = left.column("k").to_pylist(), [[], []]

    def take(i: int, near: np.ndarray, tags: list) -> None:
        out[0].append(names[i])
        out[1].append(len(near))

    return take, out, pa.schema([("k", left.schema.field("k").type), ("c", pa.int64())])


def _links(left: pa.Table):
    """Pairs (a, b) of cells: of those that an asking row's cell is linked with, as many as join what isn't joined yet here."""
    cells, out, up = left.column("cell").to_pylist(), [[], []], {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def take(i: int, near: np.ndarray, tags: list) -> None:
        for tag in {tags[j] for j in near}:
            one, two = top(cells[i]), top(tag)
            if one != two:
                up[one] = two
                out[0].append(cells[i])
                out[1].append(tag)

    kind = left.schema.field("cell").type
    return take, out, pa.schema([("a", kind), ("b", kind)])


def _tags(left: pa.Table):
    """k and cell: the cells of the members that are near."""
    names, out = left.column("k").to_pylist(), [[], []]

    def take(i: int, near: np.ndarray, tags: list) -> None:
        found = {tags[j] for j in near}
        out[0].extend([names[i]] * len(found))
        out[1].extend(found)

    kind = left.schema.field("k").type
    return take, out, pa.schema([("k", kind), ("cell", kind)])


def _dbscan_blocks(point: DataFrame, d: int, kind: str, eps: float, least: int, size: int | None) -> DataFrame:
    """_k and cluster of the points (k, v) that aren't noise: a pass over blocks near each other finds the cores, a second one
    links them and finds the cores near other points, which are fewer than ``least`` a point."""
    points, near = _arranged(point, d, eps, size)

    def count(i: int) -> Iterator[pa.RecordBatch]:
        mine = points.read(i)
        x, n = allpairs.matrix(mine), np.zeros(mine.num_rows, dtype=np.int64)
        for j in near[i]:
            for one, _ in allpairs.near_pairs(x, allpairs.matrix(points.read(j)), eps):
                n += np.bincount(one, minlength=len(n))
        yield from mine.append_column("core", pa.array(n >= least)).to_batches()

    judged = allpairs.kept(points.each(count, f"k {kind}, v array<double>, core boolean"))  # the blocks stay as they are

    def cores(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
        table = table.filter(table.column("core"))
        return _column(table, "k"), allpairs.matrix(table)

    def link(i: int) -> Iterator[pa.RecordBatch]:
        def batch(a: pa.Array, b: pa.Array, edge: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([a, b, pa.array(np.full(len(a), edge))], names=["a", "b", "edge"])

        table = judged.read(i)
        names, x = cores(table)
        table = table.filter(pc.invert(table.column("core")))
        edges, z = _column(table, "k"), allpairs.matrix(table)
        up = np.arange(len(x))
        for j in near[i]:
            others, y = (names, x) if j == i else cores(judged.read(j))
            for one, two in allpairs.near_pairs(z, y, eps):
                yield batch(edges.take(pa.array(one)), others.take(pa.array(two)), True)
            if j < i:
                continue
            if j == i:
                for one, two in allpairs.near_pairs(x, x, eps):
                    up = allpairs.join(up, one, two)
                continue
            both = np.concatenate([up, len(x) + np.arange(len(y))])
            for one, two in allpairs.near_pairs(x, y, eps):
                both = allpairs.join(both, one, len(x) + two)
            up, top = both[: len(x)], both[len(x) :]  # the top of a group that has points here is one of them
            at = np.flatnonzero(top < len(x))
            yield batch(others.take(pa.array(at)), names.take(pa.array(top[at])), False)
        at = np.flatnonzero(up != np.arange(len(up)))
        yield batch(names.take(pa.array(at)), names.take(pa.array(up[at])), False)

    links = store(judged.each(link, f"a {kind}, b {kind}, edge boolean"))
    groups = connected_components(links.filter("NOT edge").select("a", "b"))
    inner = judged.rows().filter("core").select("k").join(groups, F.col("k") == F.col("node"), "left").select("k", F.coalesce("component", "k").alias("_group"))
    inner = store(inner)
    names = inner.groupBy(F.col("_group").alias("_g")).agg(F.min("k").alias("cluster"))
    inner = store(inner.join(bounded(store(names), 64), F.col("_group") == F.col("_g")).select(F.col("k").alias("_k"), "cluster"))
    outer = links.filter("edge").select("a", "b").join(inner, F.col("b") == F.col("_k")).groupBy("a").agg(F.min("cluster").alias("cluster"))
    return inner.unionByName(outer.select(F.col("a").alias("_k"), "cluster"))


def dbscan(df: DataFrame, key: str, columns: str | list[str], eps: float = 0.5, least: int = 5, block: int = BLOCK, log: dict | None = None) -> DataFrame:
    """key and cluster (the smallest core key; null for noise): cores have ``least`` points within ``eps``, themselves included.

    Cells are so small that their points are all within ``eps`` of each other: a cell of ``least`` points is dense. It has
    only cores, which are one cluster, so no pair in it is looked at. Points of other cells ask the blocks near them: of
    dense cells, and of the points of many small cells together. A small cell's cores link it to what they find near. Dense
    cells are joined where their boxes or first points are near enough; only those near each other that aren't connected
    by then compare points, block by block. A border point goes to the smallest label near it.

    That is how it goes up to three dimensions. Beyond, cells hold few points; blocks of points near each other meet
    (see ``allpairs``), which compares all points where all are near each other, and stores and shuffles none of the pairs.

    ``columns`` are numeric ones, or one column of vectors, of any dimension. Rows with null or non-finite components are
    noise. Keys are distinct. ``log`` receives the numbers of points that asked and of blocks that were compared.
    """
    point = _vectors(df, key, columns, "k")
    d, shortest = (len(columns), len(columns)) if isinstance(columns, list) else _dimensions(point)
    kind = dict(point.dtypes)["k"]
    if d > 3:
        if shortest < d:
            raise ValueError("vectors of several lengths")
        found = _dbscan_blocks(point, d, kind, eps, least, None if block == BLOCK else block)
        return df.select(F.col(key)).join(found, F.col(key) == F.col("_k"), "left").select(key, "cluster")
    side, near2 = eps / math.sqrt(d) * (1 - _SLACK), eps * eps
    at = F.transform("v", lambda x: F.floor(x / side))
    # Centres of cells with points within eps of each other are at most 2 eps apart.
    band = _bands(F.transform("at", lambda x: (x + 0.5) * side), d, 2 * eps * (1 + _SLACK))
    cells = store(point.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("cell")).withColumn("band", band))
    named = cells.select(F.col("at").alias("_at"), "n", "cell", "band")
    points = store(point.withColumn("_here", at).join(bounded(named, 16 * d + 96), F.col("_here") == F.col("_at")).select("cell", "band", "n", "k", "v"))
    small = points.filter(F.col("n") < least)

    def together(rows: DataFrame) -> DataFrame:
        """Blocks of the points of small cells, by bands; their numbers are negative."""
        sizes = store(rows.groupBy(F.col("band").alias("_band")).agg(F.count(F.lit(1)).alias("_n")))
        own = rows.join(bounded(sizes, 64), F.col("band") == F.col("_band"))
        made = _blocks(own.select(F.lit(None).cast(kind).alias("cell"), "band", F.col("_n").alias("n"), "k", "v", F.col("cell").alias("tag")), side, block)
        return made.withColumn("block", -1 - F.col("block"))

    def asks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """Each point with the blocks near it."""
        boxes = blocks.select("block", F.col("band").alias("_band"), F.col("n").alias("_n"), "low", "high")
        by = rows.withColumn("_beside", F.explode(_beside(F.col("band"), min(d, 3)))).join(boxes, F.col("_beside") == F.col("_band"))
        return by.filter(_gap2(F.col("v"), F.col("v"), F.col("low"), F.col("high")) <= near2 * (1 + _SLACK))

    dense = _blocks(points.filter(F.col("n") >= least).select("cell", "band", "n", "k", "v", F.col("cell").alias("tag")), side, block)
    blocks = dense.unionByName(together(small))
    asked = store(asks(small, blocks).select("k", "v", "block", "_n", (_span2(F.col("v"), F.col("v"), F.col("low"), F.col("high")) <= near2 * (1 - _SLACK)).alias("all")))
    found = _meet(asked.filter("NOT all").select("block", "k", "v"), blocks, "k", _near(eps, _counts), f"k {kind}, c long")
    sums = found.unionByName(asked.filter("all").select("k", F.col("_n").alias("c"))).groupBy(F.col("k").alias("_k")).agg(F.sum("c").alias("c"))
    judged = store(small.join(store(sums), F.col("k") == F.col("_k"), "left").select("cell", "band", "k", "v", (F.coalesce("c", F.lit(0)) >= least).alias("core")))
    cores, edge = judged.filter("core"), judged.filter("NOT core")
    whole = dense.unionByName(together(cores))

    # Links of small cells' cores, and of dense cells that are surely near each other.
    links = _meet(asks(cores, whole).select("block", "k", "v", "cell"), whole, "k", _near(eps, _links), f"a {kind}, b {kind}").filter("a <> b")
    boxes = store(dense.select("block", F.col("cell").alias("_cell"), "band", "low", "high", F.get("members", F.lit(0))["v"].alias("one")))
    ours = boxes.select(F.col("block").alias("a_block"), F.col("_cell").alias("a"), F.explode(_beside(F.col("band"), min(d, 3))).alias("_beside"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("one").alias("a_one"))
    theirs = boxes.select(F.col("block").alias("b_block"), F.col("_cell").alias("b"), F.col("band").alias("_band"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("one").alias("b_one"))
    sides = [F.col(c) for c in ("a_low", "a_high", "b_low", "b_high")]
    met = ours.join(theirs, F.col("_beside") == F.col("_band")).filter((F.col("a") < F.col("b")) & (_gap2(*sides) <= near2 * (1 + _SLACK)))
    sure = (_span2(*sides) <= near2 * (1 - _SLACK)) | (distance2(F.col("a_one"), F.col("b_one")) <= near2)
    met = store(met.select("a", "b", "a_block", "b_block", sure.alias("sure")))
    links = store(links.unionByName(met.filter("sure").select("a", "b")).distinct())

    # Dense cells near each other that aren't connected yet compare points.
    groups = connected_components(links)
    one, two = (groups.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"_{x}c")) for x in "ab")
    open_ = met.join(bounded(one, 64), F.col("a") == F.col("_a"), "left").join(bounded(two, 64), F.col("b") == F.col("_b"), "left")
    open_ = store(open_.filter(F.coalesce("_ac", "a") != F.coalesce("_bc", "b")).select("a", "b", "a_block", "b_block"))
    data = dense.select(F.col("block").alias("_block"), F.transform("members", lambda m: m["v"]).alias("v"))
    both = open_.join(data.withColumnsRenamed({"_block": "_one", "v": "left"}), F.col("a_block") == F.col("_one"))
    both = both.join(data.withColumnsRenamed({"_block": "_two", "v": "right"}), F.col("b_block") == F.col("_two")).select("a", "b", "left", "right")

    def touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array([touch(_matrix(batch.column(2)[i].values), _matrix(batch.column(3)[i].values), eps) for i in range(batch.num_rows)], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    links = store(links.unionByName(both.mapInArrow(touching, f"a {kind}, b {kind}")).distinct())
    groups = connected_components(links)

    # The smallest core key of each cell (a dense cell's name is its smallest key), and of each cluster.
    homes = cells.filter(F.col("n") >= least).select("cell", F.col("cell").alias("first")).unionByName(cores.groupBy("cell").agg(F.min("k").alias("first")))
    labels = store(homes.join(bounded(groups, 64), F.col("cell") == F.col("node"), "left").select("cell", "first", F.coalesce("component", "cell").alias("group")))
    names = labels.groupBy(F.col("group").alias("_g")).agg(F.min("first").alias("cluster"))
    label = bounded(store(labels.join(bounded(store(names), 64), F.col("group") == F.col("_g")).select(F.col("cell").alias("_home"), "cluster")), 64)
    inner = points.filter(F.col("n") >= least).select("cell", "k").unionByName(cores.select("cell", "k"))
    inner = inner.join(label, F.col("cell") == F.col("_home")).select("k", "cluster")
    asked = asks(edge, whole).select("block", "k", "v")
    if log is not None:
        asked = store(asked)
        log |= {"asked": small.count(), "asked_again": asked.count(), "compared": open_.count()}
    reached = _meet(asked, whole, "k", _near(eps, _tags), f"k {kind}, cell {kind}")
    outer = reached.join(label, F.col("cell") == F.col("_home")).groupBy("k").agg(F.min("cluster").alias("cluster"))
    found = inner.unionByName(outer).withColumnRenamed("k", "_k")
    return df.select(F.col(key)).join(found, F.col(key) == F.col("_k"), "left").select(key, "cluster")
