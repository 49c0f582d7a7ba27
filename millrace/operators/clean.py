"""Cleaning: duplicates, imputation, clipping and scaling, fitted on train rows and applied as plain projections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from .profile import describe, missing_counts, quantiles, value_counts


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """With a subset, the row with the most known values of each key stays (ties by ``order``); else one of equal rows."""
    if not subset:
        return df.dropDuplicates()
    known = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns), F.lit(0))
    # The best row of a key is a minimum: tasks reduce their own rows first, so that a frequent (or null) key is no hot task.
    rank = F.struct((-known).alias("k"), *[F.struct(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")).alias(f"o{i}") for i, c in enumerate(order or df.columns)])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*[F.col(f"`{c}`").alias(f"key_{i}") for i, c in enumerate(subset)]).agg(F.min_by(row, rank).alias("best"))
    return best.select("best.*")


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, missing_before, missing_after of the columns that both have."""
    one = missing_counts(before).select("column", F.col("missing_count").alias("missing_before"))
    return one.join(F.broadcast(missing_counts(after).select(F.col("column").alias("_c"), F.col("missing_count").alias("missing_after"))), F.col("column") == F.col("_c")).drop("_c")


def clip_columns(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: X.clip(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in fences.items() if c in df.columns})


def fit_imputer(df: DataFrame, numeric: str = "median", exact: bool = True) -> dict[str, float | str]:
    """A fill value by column: median or mean (0 without values), most frequent text (the smallest on ties; "missing")."""
    numbers, texts = X.numeric_columns(df), X.categorical_columns(df)
    fill: dict[str, float | str] = {c: 0.0 for c in numbers} | {c: "missing" for c in texts}
    if numbers:
        fill |= {r["column"]: r["median" if numeric == "median" else "mean"] for r in describe(df, numbers, exact).collect()}
    if texts:
        first = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        fill |= {r["column"]: r["value"] for r in value_counts(df, texts).withColumn("r", F.row_number().over(first)).filter("r = 1").collect()}
    return fill


def impute(df: DataFrame, fill: dict[str, float | str]) -> DataFrame:
    """Missing values (NaN too) replaced; columns keep their types, but a whole column takes a fractional value as double."""
    return X.missing_free(df).withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in fill.items() if c in df.columns})


@dataclass
class Scaler:
    """Subtracts ``centre`` and divides by ``spread`` (1 where it is zero)."""

    method: str = "standard"
    centre: dict[str, float] = field(default_factory=dict)
    spread: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> "Scaler":
        columns = columns or X.numeric_columns(df)
        known = X.long_form(X.missing_free(df), columns).filter("value IS NOT NULL")
        rows = known.groupBy("column")
        if self.method == "minmax":
            stats = rows.agg(F.min("value").alias("a"), (F.max("value") - F.min("value")).alias("b"))
        elif self.method == "robust":
            stats = quantiles(known, [0.25, 0.5, 0.75], exact).select("column", F.col("q")[1].alias("a"), (F.col("q")[2] - F.col("q")[0]).alias("b"))
        else:
            stats = rows.agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("b"))
        for r in stats.collect():  # a row a column
            self.centre[r["column"]], self.spread[r["column"]] = r["a"], r["b"] or 1.0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.centre[c]) / self.spread[c] for c in self.centre if c in df.columns})


@dataclass
class Preprocessor:
    """Median fill, optional clipping to Tukey's fences, standard scaling. Fit on train rows; transform is one projection."""

    clip: bool = False
    k: float = 1.5
    exact: bool = True
    medians: dict[str, float] = field(default_factory=dict)
    fences: dict[str, tuple[float, float]] = field(default_factory=dict)
    scaler: Scaler = field(default_factory=Scaler)

    def fit(self, train: DataFrame, columns: list[str] | None = None) -> "Preprocessor":
        """Two jobs: quantiles of the raw values, then moments of the filled and clipped ones."""
        columns = columns or X.numeric_columns(train)
        self.medians = dict.fromkeys(columns, 0.0)
        for r in describe(train, columns, self.exact).collect():  # a row a column
            self.medians[r["column"]] = float(r["median"])
            spread = self.k * (r["q3"] - r["q1"])
            self.fences[r["column"]] = (r["q1"] - spread, r["q3"] + spread) if r["n"] > 1 else (float("-inf"), float("inf"))
        self.scaler.fit(self._filled(train).select(*columns))
        return self

    def _filled(self, df: DataFrame) -> DataFrame:
        cast = df.withColumns({c: F.col(c).cast("double") for c in self.medians if c in df.columns})
        filled = impute(cast, self.medians)
        return clip_columns(filled, self.fences) if self.clip else filled

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(self._filled(df))

    def fit_transform(self, df: DataFrame, key: str, target: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
        """Without duplicate rows, split by key; fitted on the features of train rows. The transformed train and test rows, with key and target."""
        from .models import train_test_split

        train, held = train_test_split(drop_duplicates(df), key, test, seed)
        self.fit(train, [c for c in X.numeric_columns(df) if c not in (key, target)])
        return self.transform(train), self.transform(held)
