"""Schema operators: target resolution, contracts and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known target names by priority. Fixed values.
TARGET_NAMES = ["target", "label", "churn", "y", "class", "status", "price", "is_churn", "fraud"]


def target_candidates(columns: list[str], requested: str | None = None) -> list[tuple[str, str, float]]:
    """(column, method, confidence) of every column that may be the target, the likeliest first.

    The requested column, then columns of its name in another case, then known names by their priority (a later column
    before an earlier one of the same name), then the last column. A column is listed once, where it ranks highest.
    """
    asked = [c for c in columns if requested and c.lower() == requested.lower()]
    found = [(c, "explicit", 1.0) for c in asked if c == requested] + [(c, "explicit", 0.98) for c in asked if c != requested]
    for name in TARGET_NAMES:
        found += [(c, "common_name", 0.90) for c in reversed(columns) if c.lower() == name]
    found += [(c, "last_column", 0.60) for c in columns[-1:]]
    firsts: dict[str, tuple[str, str, float]] = {}
    for candidate in found:
        firsts.setdefault(candidate[0], candidate)
    return list(firsts.values())


def resolve_target(columns: list[str], requested: str | None = None) -> tuple[str | None, str, float]:
    """The likeliest target (column, method, confidence); none for a table without columns."""
    return next(iter(target_candidates(columns, requested)), (None, "none", 0.0))


def target_report(df: DataFrame, requested: str | None = None) -> DataFrame:
    """rank, column, method, confidence of all candidates, with what the table says of them: n_values and null_share.

    One pass over the candidates' columns. A candidate of one value, or of as many as rows, is unlikely to be a target.
    """
    spark, found = df.sparkSession, target_candidates(df.columns, requested)
    names = spark.createDataFrame([(k + 1, *c) for k, c in enumerate(found)], "rank int, column string, method string, confidence double")
    if not found:
        return names.withColumns({"n_values": F.lit(0).cast("long"), "null_share": F.lit(0.0)})
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.xxhash64(F.col(f"`{c}`")).alias("h"), F.col(f"`{c}`").isNull().alias("null")) for c, _, _ in found]))
    by = df.select(cells.alias("_x")).select("_x.*").groupBy("_c").agg(F.count_distinct(F.when(~F.col("null"), F.col("h"))).alias("n_values"), F.avg(F.col("null").cast("double")).alias("null_share"))
    return names.join(by, F.col("column") == F.col("_c"), "left").select("rank", "column", "method", "confidence", F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"), F.coalesce("null_share", F.lit(0.0)).alias("null_share"))


def extract_schema(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def require_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Exactly the expected columns in their order; a missing one is an error, others are dropped."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in expected])


def has_columns(df: DataFrame, expected: list[str]) -> bool:
    return set(expected) <= set(df.columns)


def contract_findings(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """column, expected, actual, status (ok, missing, type) of a contract {column: dtype}."""
    have = dict(df.dtypes)
    rows = [(c, want, have.get(c), "missing" if c not in have else "ok" if have[c] == want else "type") for c, want in contract.items()]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string, status string")


def align_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """The expected columns in their order, 0 where one is missing."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c) for c in expected])


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def drop_target(df: DataFrame, target: str) -> DataFrame:
    return df.drop(target)


def head_sample(df: DataFrame, key: str, rows: int = 20) -> DataFrame:
    """The first rows by key, for a look at them."""
    return df.orderBy(key).limit(rows)
