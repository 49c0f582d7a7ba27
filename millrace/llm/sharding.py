"""Shards by a consistent-hash ring with virtual nodes and bounded loads (Mirrokni, Thorup and Zadimoghaddam 2018).

Each shard owns ``virtual`` points of a 64-bit ring; a key belongs to the first point at or after its hash. A shard that
is over its bound keeps its share of each of its arcs, and the rest of each arc continues clockwise to shards with room.
Only counts per arc reach the driver (shards times points, whatever the number of keys). It returns, for each arc, runs
of ranks and the shard each run goes to; rows find their rank within the arc and their run by a small join.

Ranks go by hashes of id and text, in cells: totals of cells first, then inside each. Equal rows are counted before they
are ranked (in each part of the input apart) and numbered after, so the shards don't depend on the partitioning and no
task ranks or numbers a whole group of them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Points of a shard on the ring, and cells in which the rows of an arc are ranked.
VIRTUAL, CELLS = 128, 64


def ring(shards: int, virtual: int = VIRTUAL, seed: int = 0) -> tuple[list[int], list[int]]:
    """Sorted ring points (signed 64-bit) and the shard that owns each."""
    points = {}
    for shard in range(shards):
        for v in range(virtual):
            digest = hashlib.blake2b(f"{seed}:{shard}:{v}".encode(), digest_size=8).digest()
            points.setdefault(int.from_bytes(digest, "big", signed=True), shard)
    places = sorted(points)
    return places, [points[p] for p in places]


def bounded_runs(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, first slot) that fill each shard to its bound.

    The bounds are the rows over the shards, rounded down or up; those up go to the shards with the highest own loads,
    so that the fewest rows move. ``counts`` and ``owner`` are in ring order.
    """
    load = [0] * shards
    for n, shard in zip(counts, owner, strict=True):
        load[shard] += n
    low, more = divmod(sum(counts), shards)
    highest = sorted(range(shards), key=lambda s: (-load[s], s))[:more]
    bound = [low + (s in set(highest)) for s in range(shards)]
    keep, left = list(counts), [min(b, n) for b, n in zip(bound, load, strict=True)]
    for arc, (n, shard) in enumerate(zip(counts, owner, strict=True)):
        if load[shard] > bound[shard]:
            keep[arc] = n * bound[shard] // load[shard]
        left[shard] -= keep[arc]
    for arc, shard in enumerate(owner):  # what rounding down has left
        extra = min(left[shard], counts[arc] - keep[arc])
        keep[arc] += extra
        left[shard] -= extra
    room = [b - min(b, n) for b, n in zip(bound, load, strict=True)]
    places = {s: [a for a, o in enumerate(owner) if o == s] for s in range(shards)}
    runs, slot = [], [0] * shards

    def put(arc: int, begin: int, n: int, shard: int) -> None:
        if n:
            runs.append((arc, begin, begin + n, shard, slot[shard]))
            slot[shard] += n

    for arc, shard in enumerate(owner):
        put(arc, 0, keep[arc], shard)
    for arc, n in enumerate(counts):
        begin = keep[arc]
        while begin < n:
            free = [s for s in range(shards) if room[s]]
            steps = {s: (places[s][bisect_left(places[s], arc + 1) % len(places[s])] - arc - 1) % len(owner) for s in free}
            shard = min(free, key=steps.__getitem__)
            moved = min(room[shard], n - begin)
            put(arc, begin, moved, shard)
            room[shard] -= moved
            begin += moved
    return runs


def assign_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", virtual: int = VIRTUAL, seed: int = 0) -> DataFrame:
    """Shard and slot of every row; shards differ by one row at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law ("rows"), shard, slot (gapless from 0 in each
    shard), grown_shard (null, as other rows have a say in a row's place). A null text has no bytes and the crc of an
    empty one. Rows with one id, null included, share an arc and are spread clockwise once shards are full. Ties in an arc
    go by the hash of id and text; equal rows are interchangeable. A very long text is only measured and hashed, where it
    is read. An empty table gives an empty result; further columns are left out.
    """
    spark = docs.sparkSession
    points, owner = ring(shards, virtual, seed)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series((np.searchsorted(np.array(points, dtype="int64"), h.to_numpy(), side="left") % len(points)).astype("int32"))

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
                       F.xxhash64(F.lit(seed), F.col(key)).alias("_hash"), F.xxhash64(F.col(key), whole).alias("_content"), F.spark_partition_id().alias("_part"))
    content = ["_content", "doc_id", "size", "text_crc32"]
    rows = rows.withColumn("_arc", arc_of("_hash")).groupBy("_arc", *content, "_part").agg(F.count(F.lit(1)).alias("_n"))
    rows = materialize(rows.withColumn("_cell", F.pmod("_content", F.lit(CELLS))))

    cells = rows.groupBy("_arc", "_cell").agg(F.sum("_n").alias("_n"))
    by_arc = {r["_arc"]: r["n"] for r in cells.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    runs = bounded_runs([by_arc.get(a, 0) for a in range(len(owner))], owner, shards)
    plan = spark.createDataFrame(runs or [(-1, 0, 0, 0, 0)], "_run_arc int, _from long, _to long, shard int, _slot long")

    before = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("_arc").alias("_a"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_arc", "_cell").orderBy(*content, "_part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_rank", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, (F.col("_arc") == F.col("_a")) & (F.col("_cell") == F.col("_c")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    ranked = ranked.select("_arc", "doc_id", "size", "text_crc32", (F.col("_start") + F.col("_rank")).alias("_rank"), each.alias("_copy")).withColumn("_rank", F.col("_rank") + F.col("_copy"))
    # The plan has at most two rows for each arc and one for each shard: its size follows the ring, not the data.
    placed = ranked.join(F.broadcast(plan), (F.col("_arc") == F.col("_run_arc")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
