"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels of skewness, by descending lower or upper bound. Fixed texts of the report.
SHAPES = {
    "high right": "highly right-skewed (long tail high) — consider log/box-cox transform, use median imputation",
    "right": "moderately right-skewed — consider square root or log transform",
    "high left": "highly left-skewed (long tail low) — consider reflect+log transform, use median imputation",
    "left": "moderately left-skewed",
    "none": "approximately symmetric — standard scaling and mean imputation are appropriate",
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def missing_free(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that both count as missing."""
    return df.select(*[F.nanvl(F.col(f"`{f.name}`"), F.lit(None)).cast(f.dataType).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def long_form(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """(column, value) rows of the columns, in which a plan's size doesn't depend on their number."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns])).alias("_p")).select("_p.column", "_p.value")


def hash_fraction(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from a key; the same in every engine and for every partitioning."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_bucket(key: Column, buckets: int, seed: int = 42) -> Column:
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def skew_shape(skew: Column) -> Column:
    return (F.when(skew > 1.0, SHAPES["high right"]).when(skew > 0.5, SHAPES["right"]).when(skew < -1.0, SHAPES["high left"])
            .when(skew < -0.5, SHAPES["left"]).otherwise(SHAPES["none"]))


def cardinality_bucket(n: Column) -> Column:
    return F.when(n <= 10, "low").when(n <= 50, "medium").when(n <= 1000, "high").otherwise("very_high")


def recommended_bins(n: Column, low: Column, high: Column, q1: Column, q3: Column) -> Column:
    """Freedman-Diaconis bins, 1 to 100; the root of n where the middle half is one value."""
    root = F.greatest(F.lit(1), F.floor(F.sqrt(n)).cast("int"))
    width = 2 * (q3 - q1) / F.pow(n, F.lit(1.0 / 3.0))
    bins = F.least(F.lit(100), F.greatest(F.lit(1), F.ceil((high - low) / width).cast("int")))
    return F.when(n < 2, F.lit(1)).when(q3 == q1, root).otherwise(bins)


def unbiased_skew(skew: Column, n: Column) -> Column:
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def clip(value: Column, low: Column, high: Column) -> Column:
    """Null stays null."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)
