"""Tables that are computed once into the shared folder, and joins with them by their size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import scratch_dir

#: Most bytes of a table that is broadcast.
BROADCAST_BYTES = 32 << 20


def store(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder once; later uses read the columns that they need of it."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """A stored table to join with: broadcast if its counted rows take ``BROADCAST_BYTES`` at most."""
    size = row_bytes * (df.count() if rows is None else rows)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
