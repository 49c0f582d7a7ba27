"""Encodings of categories: out-of-fold target means, frequencies, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

#: A lookup of at most this many categories is broadcast; a larger one is joined by shuffle.
BROADCAST_CATEGORIES = 100_000


def lookup(df: DataFrame, column: str, table: DataFrame, value: str, default: Column, small: bool | None = None) -> DataFrame:
    """``df`` with ``value`` from a table (category, value), ``default`` where the category is unknown or null."""
    small = table.limit(BROADCAST_CATEGORIES + 1).count() <= BROADCAST_CATEGORIES if small is None else small
    side = table.select(F.col("category").alias("_cat"), F.col(value).alias("_val"))
    joined = df.join(F.broadcast(side) if small else side, F.col(column).cast("string") == F.col("_cat"), "left")
    return joined.withColumn(value, F.coalesce("_val", default)).drop("_cat", "_val")


def category_means(df: DataFrame, column: str, target: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(F.avg(target).alias("mean"), F.count(target).alias("n"))


def target_map(train: DataFrame, column: str, target: str, smoothing: float = 10.0) -> tuple[DataFrame, float]:
    """(category, encoded) over all train rows, and the global mean."""
    overall = train.agg(F.avg(target)).collect()[0][0]
    overall = float("nan") if overall is None else float(overall)
    means = category_means(train, column, target)
    return means.select("category", ((F.col("n") * F.col("mean") + smoothing * overall) / (F.col("n") + smoothing)).alias("encoded")), overall


def target_encode_apply(df: DataFrame, column: str, table: DataFrame, overall: float) -> DataFrame:
    return lookup(df, column, table, "encoded", F.lit(overall))


def target_encode_oof(train: DataFrame, key: str, column: str, target: str, folds: int = 5, smoothing: float = 10.0, seed: int = 42) -> DataFrame:
    """Train rows with ``fold`` and ``encoded``, the smoothed mean of their category over the other folds.

    Totals by category less the fold's own: one grouping for all folds, and the rows themselves are joined to small sums.
    """
    rows = train.withColumn("fold", X.hash_bucket(F.col(key), folds, seed))
    overall = float(rows.agg(F.avg(target)).collect()[0][0] or 0.0)
    parts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("_cat"), F.col("fold").alias("_fold")).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    totals = parts.groupBy(F.col("_cat").alias("_c")).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    other = parts.join(totals, F.col("_cat") == F.col("_c")).select("_cat", "_fold", (F.col("_ts") - F.col("_s")).alias("_os"), (F.col("_tn") - F.col("_n")).alias("_on"))
    small = other.limit(BROADCAST_CATEGORIES + 1).count() <= BROADCAST_CATEGORIES
    joined = rows.join(F.broadcast(other) if small else other, (F.col(column).cast("string") == F.col("_cat")) & (F.col("fold") == F.col("_fold")), "left")
    value = F.when(F.coalesce("_on", F.lit(0)) > 0, (F.col("_os") + smoothing * overall) / (F.col("_on") + smoothing)).otherwise(F.lit(overall))
    return joined.withColumn("encoded", value).drop("_cat", "_fold", "_os", "_on")


def unseen_categories(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """category: values of the column that occur in test rows only."""
    one, two = (d.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("category")) for d in (train, test))
    return two.subtract(one)


def frequency_map(train: DataFrame, column: str) -> DataFrame:
    counts = train.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("category", (F.col("n") / F.col("_all")).alias("frequency"))  # one row


def frequency_encode_apply(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    return lookup(df, column, table, "frequency", F.lit(0.0))


def one_hot_categories(train: DataFrame, columns: list[str], most: int = 1000) -> dict[str, list[str]]:
    """Categories by column in order; more than ``most`` are refused (use frequencies or target means instead)."""
    out: dict[str, list[str]] = {}
    for c in columns:
        found = [r[0] for r in train.filter(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} categories")
        out[c] = sorted(found)
    return out


def one_hot_apply(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Other columns first, then column_category indicators; null and unknown categories give zeros."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in categories]
    flags = [F.when(F.col(c).cast("string") == v, 1).otherwise(0).alias(f"{c}_{v}") for c, vs in categories.items() for v in vs]
    return df.select(*rest, *flags)


def encoding_report(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    from .profile import cardinality

    made = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(sum(a.startswith(c) for a in after.columns)))])
    return cardinality(before, columns).withColumn("columns_after_encoding", made[F.col("column")])
