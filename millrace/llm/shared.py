"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than these six white-space characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Most bytes of a table that is broadcast, and bits of a filter that is.
BROADCAST_BYTES, BITS = 32 << 20, 1 << 27

#: Bytes of an Arrow batch, unless the session says so itself; the engine's own bound, 10,000 rows, is tens of megabytes of texts.
BATCH_BYTES, _BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_kept: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where it is unset and the session is local, a temporary folder takes its place.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile workers get batches of about ``BATCH_BYTES``, which lie beside a full JVM, there and in the worker."""
    if spark.conf.get(_BATCH_CONF, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_CONF)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder; later uses read that copy."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder; later uses read the columns that they need of it."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """A stored table to join with: broadcast if its counted rows (or the given number) take ``BROADCAST_BYTES`` at most."""
    size = row_bytes * (df.count() if rows is None else rows)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def in_bits(df: DataFrame, key: str, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose key (a long) may be in ``wanted``, a stored table with a column of that name; no row whose key is goes.

    Hashes of the wanted keys set bits of bitmaps that the engine builds, 32,768 bits each, ``bits`` in all (16 MB by
    default), which are broadcast whatever the number of keys.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = wanted.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_at")).groupBy("_bucket")
    maps = store(maps.agg(F.bitmap_construct_agg("_at").alias("_map")))
    bit = F.bitmap_bit_position(F.col("_place"))
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    asked = df.withColumn("_place", place).join(F.broadcast(maps), F.bitmap_bucket_number(F.col("_place")) == F.col("_bucket"))
    return asked.filter(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8 + 1).cast("int"))) > 0).select(*df.columns)


def kept(cache: dict) -> dict:
    """Register what a module keeps in a worker from task to task, so that ``make_room`` finds it."""
    _kept.append(cache)
    return cache


def make_room(*own: dict) -> None:
    """At a task's start: drop what other operators' tasks left in this worker, which stays and takes tasks of any kind."""
    others = [cache for cache in _kept if cache and not any(cache is x for x in own)]
    for cache in others:
        cache.clear()
    if others:
        give_back()


def give_back() -> None:
    """Return a task's freed memory to the system: workers stay and go on to other tasks beside a full JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI, usable in tasks and on the driver."""
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def word_array(text: Column) -> Column:
    """Words of a text as an array (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def word_count(text: Column) -> Column:
    """Number of words (null text: 0)."""
    return F.size(word_array(text)).cast("long")


def gapless(df: DataFrame, group: list[str], cell: Column, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    ``cell`` splits a group into many parts, so that no task sorts a whole group: each part is numbered alone and
    starts at the summed sizes of the parts before it. The input is read twice; pass a materialized one. Group columns
    and ``cell`` are never null.
    """
    keys = [*group, "_cell"]
    parts = df.withColumn("_cell", cell)
    sizes = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(c).alias(f"_key_{c}") for c in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    joined = ranked.join(starts, [F.col(c) == F.col(f"_key_{c}") for c in keys])
    return joined.select(*df.columns, (F.col("_start") + F.col("_rank")).cast("long").alias(name))
