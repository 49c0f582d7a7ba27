"""Exact quantiles and prefix sums of groups of any size: ordered cells first, then the rows of the cells that matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import bounded, store

#: Rows meant for a cell, and the most cells of a group; beyond, cells grow.
CELL_ROWS, MAX_CELLS = 200_000, 1_000

#: Cells of equal width that a pass for quantiles counts.
FINE = 4096

#: A column of at most this many rows is sorted by one aggregation.
SMALL_ROWS = 2_000_000


def edges_of(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """_e_<group> and _edges: cell edges of each group from a bounded sketch; as many cells as ``n`` rows ask for."""
    cells = max(2, min(MAX_CELLS, -(-n // CELL_ROWS)))
    points = [i / cells for i in range(1, cells)]
    return rows.groupBy(*[F.col(c).alias(f"_e_{c}") for c in by]).agg(F.percentile_approx(value, points, 4 * cells).alias("_edges"))


def placed(rows: DataFrame, by: list[str], value: str, edges: DataFrame) -> DataFrame:
    """The rows with ``_cell``, the number of edges below their value."""
    same = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in by]
    joined = rows.join(F.broadcast(edges), same) if by else rows.crossJoin(F.broadcast(edges))  # a row a group
    return joined.withColumn("_cell", below(F.col("_edges"), F.col(value))).drop("_edges", *[f"_e_{c}" for c in by])


def below(edges: Column, value: Column) -> Column:
    """How many of the sorted edges are smaller than the value."""
    return F.size(F.filter(edges, lambda e: e < value))


def _cells(rows: DataFrame, group: str, value: str, windows: DataFrame) -> DataFrame:
    """_w (window), _cell, _n, _min, _max, _before, _all: the rows of each window counted by ``FINE`` equal cells of its span.

    A cell's number rises with the value. Values beyond the window's finite ends are in cells of their own.
    """
    v, low, high = F.col(value), F.col("_low"), F.col("_high")
    inside = F.when(high > low, F.least(F.lit(FINE - 1), F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * FINE))).otherwise(F.lit(0))
    cell = F.when(v < low, -1).when(v > high, FINE).otherwise(inside).cast("int")
    met = rows.join(F.broadcast(windows), (F.col(group).eqNullSafe(F.col("_g"))) & (v >= F.col("_from")) & (v <= F.col("_to")))
    return met.groupBy("_w", "_g", "_before", "_all", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"))


def exact_quantiles(rows: DataFrame, points: list[float], group: str = "column", value: str = "value", n: int | None = None) -> DataFrame:
    """group and q: interpolated quantiles, exact, of each group's non-null values.

    Tables of up to ``SMALL_ROWS`` rows take one aggregation. Beyond, rows are counted by cells of equal width between the
    least and the greatest value. The ranks that a quantile lies between fall into one or two cells; a cell with more than
    ``CELL_ROWS`` rows is counted again by cells of its own span, until the values of what is left are counted and walked.
    A pass is one aggregation, whose groups are cells.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(group, value)
    n = rows.count() if n is None else n
    if n <= SMALL_ROWS:
        return rows.groupBy(group).agg(F.percentile(value, points).alias("q"))
    spark, kind = rows.sparkSession, dict(rows.dtypes)[group]
    finite = (F.abs(value) < float("inf")) & ~F.isnan(value)
    ends = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(finite, F.col(value))).alias("low"), F.max(F.when(finite, F.col(value))).alias("high"), F.min(value).alias("from"), F.max(value).alias("to"))
    # A row a group, then a few a point and group: what is walked on the driver are cells, not values.
    windows = [(k, r[group], r["low"] if r["low"] is not None else 0.0, r["high"] if r["high"] is not None else 0.0, r["from"], r["to"], 0, r["n"]) for k, r in enumerate(ends.collect())]
    schema = f"_w int, _g {kind}, _low double, _high double, _from double, _to double, _before long, _all long"
    asked = lambda all_: sorted({r for p in points for r in (math.floor((all_ - 1) * p), math.ceil((all_ - 1) * p))})
    done: list[tuple] = []
    while windows:
        frame = spark.createDataFrame(windows, schema)
        running = Window.partitionBy("_w").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
        counts = _cells(rows, group, value, frame).withColumn("_at", F.col("_before") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
        ranks = F.array(*[F.lit(p) for p in points])
        hit = F.exists(ranks, lambda p: ((F.floor((F.col("_all") - 1) * p) < F.col("_at") + F.col("_n")) & (F.ceil((F.col("_all") - 1) * p) >= F.col("_at"))))
        found, windows = counts.filter(hit).collect(), []
        for r in found:
            own = (r["_g"], r["_min"], r["_max"], r["_min"], r["_max"], r["_at"], r["_all"])
            again = r["_n"] > CELL_ROWS and r["_min"] < r["_max"] and math.isfinite(r["_min"]) and math.isfinite(r["_max"])
            (windows if again else done).append((len(windows if again else done), *own))
    wanted = spark.createDataFrame([(d[0], d[1], d[4], d[5], d[6], d[7], [r for r in asked(d[7])]) for d in done], f"_w int, _g {kind}, _from double, _to double, _before long, _all long, _ranks array<long>")
    inner = rows.join(F.broadcast(wanted.drop("_ranks")), F.col(group).eqNullSafe(F.col("_g")) & (F.col(value) >= F.col("_from")) & (F.col(value) <= F.col("_to"))).groupBy("_w", "_before", value).agg(F.count(F.lit(1)).alias("_k"))
    last = F.sum("_k").over(Window.partitionBy("_w").orderBy(value)) + F.col("_before")
    inner = inner.withColumn("_last", last).select(F.col("_w").alias("_w2"), value, (F.col("_last") - F.col("_k")).alias("_first"), "_last")
    each = wanted.select("_w", "_g", "_all", F.explode("_ranks").alias("_rank"))
    ranks = inner.join(F.broadcast(each), (F.col("_w") == F.col("_w2")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last")))
    at = ranks.groupBy(F.col("_g").alias(group), F.col("_all").alias("_all")).agg(F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("_at"))  # two a point

    def point(p: float) -> Column:
        exact = (F.col("_all") - 1) * p
        low, high = F.col("_at")[F.floor(exact)], F.col("_at")[F.ceil(exact)]
        return low + (high - low) * (exact - F.floor(exact))

    return at.select(group, F.array(*[point(p) for p in points]).alias("q"))


def prefix_sums(counts: DataFrame, by: list[str], value: str, sums: list[str], n: int | None = None) -> DataFrame:
    """Adds before_x for each x of ``sums``: its sum over rows of the same group with a smaller value.

    ``counts`` has one row a group and value. Values fall into ordered cells between quantiles of their group, as many as
    the number of rows asks for; cell totals are summed up first, and rows only within their cell, so no task sorts a
    whole group.
    """
    counts = store(counts)  # it is read for its size, its edges, its totals and its rows
    own = placed(counts, by, value, edges_of(counts, by, value, counts.count() if n is None else n))
    total = own.groupBy(*by, "_cell").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    total = total.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_cell"]], *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums])
    joined = own.join(F.broadcast(total), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_cell"]])  # at most MAX_CELLS rows a group
    inside = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumns({f"before_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_b_{s}") for s in sums})
    return out.select(*counts.columns, *[f"before_{s}" for s in sums])


def running_sums(rows: DataFrame, group: list[str], order: list[str], weight: str, name: str = "before") -> DataFrame:
    """The rows with ``name``: the sum of ``weight`` over the rows before each in its group (non-null), in full ``order``.

    Rows are dealt by ranges of group and order, so that a group may span many tasks; a range starts at the sums of those
    before it.
    """
    at = rows.withColumn("_at", F.monotonically_increasing_id())
    placed = at.repartitionByRange(*group, *order, "_at").sortWithinPartitions(*group, *order, "_at").drop("_at")
    placed = store(placed.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    totals = placed.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p")).agg(F.sum(weight).alias("_t"))
    ahead = Window.partitionBy(*[f"_g_{c}" for c in group]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = store(totals.withColumn("_start", F.coalesce(F.sum("_t").over(ahead), F.lit(0))).drop("_t"))
    inside = Window.partitionBy(*group, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    met = summed.join(bounded(starts, 64), [F.col(c) == F.col(f"_g_{c}") for c in group] + [F.col("_part") == F.col("_p")])
    return met.select(*rows.columns, (F.col("_own") + F.col("_start")).alias(name))
