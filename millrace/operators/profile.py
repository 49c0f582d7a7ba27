"""Profiles of tables: one grouped pass over (column, value) rows, whatever the number of columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import stats
from ..functions.ranks import exact_quantiles
from .wide import correlation_matrix

#: Names that mark a column as an id. Fixed values.
ID_NAMES = {"id", "index", "uuid", "rowid", "customer_id", "user_id"}

#: Most columns whose pairs are expressions of one aggregation.
NARROW = 16

#: Rank error of an approximate quantile is a row in this many.
APPROX_ACCURACY = 10_000


def quantiles(rows: DataFrame, points: list[float], exact: bool = True) -> DataFrame:
    """column and q of (column, value) rows: exact interpolated quantiles by ordered cells, or those of a bounded sketch."""
    if exact:
        return exact_quantiles(rows, points)
    return rows.groupBy("column").agg(F.percentile_approx("value", points, APPROX_ACCURACY).alias("q"))


def missing_counts(df: DataFrame) -> DataFrame:
    """column, dtype, n_rows, missing_count, missing_pct; most missing first."""
    clean = X.missing_free(df)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"`{c}`").isNull()).alias("missing_count")) for c, t in df.dtypes]
    rows = clean.agg(F.array(*parts).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")
    pct = F.round(F.col("missing_count") * 100.0 / F.greatest(F.col("n_rows"), F.lit(1)), 2)
    return rows.withColumn("missing_pct", pct).orderBy(F.desc("missing_pct"), "column")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows, duplicate_rows (beyond the first of each group; null equals null) and their percentage."""
    groups = df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    out = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    return out.withColumn("duplicate_pct", F.round(F.col("duplicate_rows") * 100.0 / F.greatest(F.col("n_rows"), F.lit(1)), 2))


def quality_check(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, duplicate_rows, is_empty and the columns with missing values as name:count."""
    missing = missing_counts(df).filter("missing_count > 0").agg(F.array_sort(F.collect_list(F.concat_ws(":", "column", "missing_count"))).alias("nulls"))
    return duplicate_rows(df).crossJoin(missing).select(  # one row each
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), "duplicate_rows", (F.col("n_rows") == 0).alias("is_empty"), F.array_join("nulls", ",").alias("nulls"))


def table_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """column, dtype, kind (numeric, categorical, other), is_target, n_rows, missing_count."""
    numeric, categorical = set(X.numeric_columns(df)), set(X.categorical_columns(df))
    kind = F.when(F.col("column").isin(*numeric or [""]), "numeric").when(F.col("column").isin(*categorical or [""]), "categorical").otherwise("other")
    return missing_counts(df).select("column", "dtype", kind.alias("kind"), (F.col("column") == F.lit(target)).alias("is_target"), "n_rows", "missing_count")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """value, n, share and minority_pct over the rows whose target isn't missing."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.min("n").alias("_min"))
    both = counts.crossJoin(F.broadcast(total))  # one row
    return both.select("value", "n", F.round(F.col("n") / F.col("_all"), 4).alias("share"), F.round(F.col("_min") * 100.0 / F.col("_all"), 2).alias("minority_pct"))


def describe(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles, max, skewness and excess kurtosis (biased; 0 below three values) by column."""
    rows = X.long_form(X.missing_free(df), columns or X.numeric_columns(df)).filter("value IS NOT NULL")
    n = F.count("value")
    out = rows.groupBy("column").agg(
        n.alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.coalesce(F.skewness("value"), F.lit(0.0)).alias("_s"), F.coalesce(F.kurtosis("value"), F.lit(0.0)).alias("_k"))
    q = quantiles(rows, [0.25, 0.5, 0.75], exact).select(F.col("column").alias("_c"), F.col("q").alias("_q"))
    out = out.join(F.broadcast(q), F.col("column") == F.col("_c"))  # a row a column
    return out.select("column", "n", "mean", "std", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max",
                      F.when(F.col("n") < 3, 0.0).otherwise(F.round("_s", 4)).alias("skewness"), F.when(F.col("n") < 3, 0.0).otherwise(F.round("_k", 4)).alias("kurtosis_excess"))


def numeric_cards(df: DataFrame, columns: list[str] | None = None, k: float = 1.5, exact: bool = True) -> DataFrame:
    """Distribution card by column: moments, fences, outliers, bins, shape. Two passes: figures, then outliers."""
    columns = columns or X.numeric_columns(df)
    d = describe(df, columns, exact)
    spread = k * (F.col("q3") - F.col("q1"))
    d = d.withColumns({"low": F.col("q1") - spread, "high": F.col("q3") + spread, "bins": X.recommended_bins(F.col("n"), F.col("min"), F.col("max"), F.col("q1"), F.col("q3"))})
    rows = X.long_form(X.missing_free(df), columns).filter("value IS NOT NULL")
    fences = d.select(F.col("column").alias("_c"), "low", "high")  # one row a column
    outside = rows.join(F.broadcast(fences), F.col("column") == F.col("_c")).groupBy("_c").agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("outlier_count"))
    d = d.join(F.broadcast(outside), F.col("column") == F.col("_c"))
    r = lambda c: F.round(c, 4).alias(c)
    return d.select("column", "n", r("mean"), r("std"), r("median"), F.round("low", 4).alias("lower_fence"), F.round("high", 4).alias("upper_fence"), "outlier_count",
                    F.round(F.col("outlier_count") * 100.0 / F.col("n"), 2).alias("outlier_pct"), "bins", "skewness", "kurtosis_excess", X.skew_shape(F.col("skewness")).alias("shape"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bin (from 1), low, high and n with the recommended number of bins."""
    figures = describe(df, [column]).withColumn("bins", X.recommended_bins(F.col("n"), F.col("min"), F.col("max"), F.col("q1"), F.col("q3"))).select("min", "max", "bins")
    rows = X.missing_free(df.select(column)).filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value"))
    width = (F.col("max") - F.col("min")) / F.col("bins")
    both = rows.crossJoin(F.broadcast(figures))  # one row
    at = F.when(F.col("max") == F.col("min"), 1).otherwise(F.least(F.col("bins"), F.floor((F.col("value") - F.col("min")) / width) + 1)).cast("int")
    return both.groupBy(at.alias("bin"), "min", width.alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", F.round(F.col("min") + (F.col("bin") - 1) * F.col("_w"), 4).alias("low"), F.round(F.col("min") + F.col("bin") * F.col("_w"), 4).alias("high"), "n")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return X.long_form(df, columns, "string").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_cards(df: DataFrame, columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """column, rank, value, n of the top values, with cardinality, bucket, top_share and is_imbalanced (over 0.6)."""
    counts = value_counts(df, columns or X.categorical_columns(df))
    by = Window.partitionBy("column")
    # Only the first values of each column leave the ranking; the engine keeps no more than these in a task.
    ranked = counts.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= top)
    whole = counts.groupBy(F.col("column").alias("_c")).agg(F.count(F.lit(1)).alias("cardinality"), F.sum("n").alias("_all"), F.max("n").alias("_top"))
    out = ranked.join(F.broadcast(whole), F.col("column") == F.col("_c"))
    share = F.col("_top") / F.col("_all")
    return out.select("column", "rank", "value", "n", "cardinality", X.cardinality_bucket(F.col("cardinality")).alias("bucket"), F.round(share, 4).alias("top_share"), (share > 0.6).alias("is_imbalanced"))


def cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    counts = value_counts(df, columns or df.columns)
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("cardinality")).withColumn("bucket", X.cardinality_bucket(F.col("cardinality")))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature_1, feature_2, place, r of each pair in column order, over rows where both are known.

    A few columns take one aggregation with an expression a pair; more go through ``wide.correlation_matrix``.
    """
    columns = columns or X.numeric_columns(df)
    if len(columns) > NARROW:
        return correlation_matrix(df, columns).select("feature_1", "feature_2", "place", "r")
    clean = X.missing_free(df.select(*columns)).select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = [F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.lit(i).alias("place"), F.corr(a, b).alias("r")) for i, (a, b) in enumerate(combinations(columns, 2))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_1 string, feature_2 string, place int, r double")
    return clean.agg(F.array(*pairs).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*")


def multicollinear(df: DataFrame, target: str | None = None, threshold: float = 0.80, columns: list[str] | None = None) -> DataFrame:
    """Pairs with |r| at the threshold or above; suggest_drop is the one that says less about the target."""
    r = correlations(df, columns)
    flagged = r.filter(F.abs("r") >= threshold).select("feature_1", "feature_2", F.round("r", 4).alias("pearson_r"))
    if target is None:
        return flagged
    ends = r.select(F.explode(F.array(F.struct(F.col("feature_1").alias("c"), F.col("feature_2").alias("o"), "r"), F.struct(F.col("feature_2").alias("c"), F.col("feature_1").alias("o"), "r"))).alias("_e")).select("_e.*")
    to_target = ends.filter(F.col("o") == target).select("c", F.abs("r").alias("t"))
    one, two = (to_target.select(F.col("c").alias(f"_c{k}"), F.col("t").alias(f"_t{k}")) for k in (1, 2))
    joined = flagged.join(F.broadcast(one), F.col("feature_1") == F.col("_c1"), "left").join(F.broadcast(two), F.col("feature_2") == F.col("_c2"), "left")
    t1 = F.when(F.col("feature_1") == target, 1.0).otherwise(F.col("_t1"))
    t2 = F.when(F.col("feature_2") == target, 1.0).otherwise(F.col("_t2"))
    return joined.select("feature_1", "feature_2", "pearson_r", F.when(t1 < t2, F.col("feature_1")).otherwise(F.col("feature_2")).alias("suggest_drop"))


def iqr_outliers(df: DataFrame, key: str, column: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """key, value, lower_fence, upper_fence of the rows outside Tukey's fences; below two values there are none."""
    d = describe(df, [column], exact).select(F.when(F.col("n") < 2, float("-inf")).otherwise(F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower_fence"),
                                             F.when(F.col("n") < 2, float("inf")).otherwise(F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper_fence"))
    rows = X.missing_free(df.select(key, column)).select(key, F.col(column).cast("double").alias("value"))
    return rows.crossJoin(F.broadcast(d)).filter((F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence")))


def mad_outliers(df: DataFrame, key: str, column: str, threshold: float = 3.5, exact: bool = True) -> DataFrame:
    """key and value of rows whose modified z-score, 0.6745 (v - median) / MAD, is beyond the threshold.

    A zero MAD falls back to the mean absolute deviation; if that is zero too, or below two values, there are none.
    """
    rows = X.missing_free(df.select(key, column)).select(key, F.col(column).cast("double").alias("value")).filter("value IS NOT NULL")
    values = rows.select(F.lit(column).alias("column"), "value")
    found = quantiles(values, [0.5], exact).collect()  # one number
    if not found:
        return rows.filter(F.lit(False))
    middle = found[0]["q"][0]
    away = values.withColumn("value", F.abs(F.col("value") - middle))
    mad = quantiles(away, [0.5], exact).collect()[0]["q"][0]
    n, mean = away.agg(F.count(F.lit(1)), F.avg("value")).collect()[0]
    spread = mean if mad == 0 else mad
    if n < 2 or not spread:
        return rows.filter(F.lit(False))
    return rows.filter(F.abs(0.6745 * (F.col("value") - middle) / spread) > threshold)


def missing_mechanism(df: DataFrame, target: str, columns: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Welch tests of other numeric columns between rows whose target is missing and not: column, t, df, p_value, likely_not_mcar."""
    columns = [c for c in (columns or X.numeric_columns(df)) if c != target]
    clean = X.missing_free(df).withColumn("_gone", F.col(target).isNull())
    rows = clean.select("_gone", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_p")).select("_gone", "_p.*")
    g, h = F.col("_gone"), ~F.col("_gone")
    v = F.col("value")
    sums = rows.filter("value IS NOT NULL").groupBy("column").agg(F.count_if(g).alias("n1"), F.count_if(h).alias("n2"), F.avg(F.when(g, v)).alias("m1"), F.avg(F.when(h, v)).alias("m2"),
                                                                  F.var_samp(F.when(g, v)).alias("v1"), F.var_samp(F.when(h, v)).alias("v2")).filter("n1 >= 2 AND n2 >= 2")
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    out = sums.select("column", ((F.col("m1") - F.col("m2")) / F.sqrt(a + b)).alias("t"), ((a + b) ** 2 / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("df"))
    tail = F.udf(lambda t, d: None if t is None or d is None else float(stats.t_two_sided(t, d)), "double")  # a row a column
    return out.withColumn("p_value", F.round(tail("t", "df"), 4)).withColumn("likely_not_mcar", F.col("p_value") < alpha)


def validate(df: DataFrame, target: str | None = None, task: str = "classification") -> DataFrame:
    """Findings about a table: column, check, severity (error, warning), value.

    Checks: empty, target_missing, target_cardinality, missing, constant, id_name, id_unique, duplicates.
    """
    spark = df.sparkSession
    clean = X.missing_free(df)
    counts = cardinality(clean)
    rows = missing_counts(df)
    both = rows.join(F.broadcast(counts.select(F.col("column").alias("_c"), "cardinality")), F.col("column") == F.col("_c"), "left").withColumn("cardinality", F.coalesce("cardinality", F.lit(0)))
    numeric, text = F.col("column").isin(*X.numeric_columns(df) or [""]), F.col("column").isin(*X.categorical_columns(df) or [""])
    target = None if task == "clustering" else target or (df.columns[-1] if df.columns else None)
    n, k = F.col("n_rows"), F.col("cardinality")
    is_target = F.col("column") == F.lit(target)
    named = F.lower("column").isin(*sorted(ID_NAMES))

    def finding(when, check: str, severity: str, value):
        return F.when(when, F.struct("column", F.lit(check).alias("check"), F.lit(severity).alias("severity"), value.cast("double").alias("value")))

    found = F.array_compact(F.array(
        finding(is_target & (k > 50) if task == "classification" else is_target & (k < 10), "target_cardinality", "warning", k),
        finding(F.col("missing_count") > 0.8 * n, "missing", "warning", F.col("missing_pct")), finding(numeric & (k <= 1), "constant", "warning", k),
        finding(named, "id_name", "warning", k), finding(~named & text & (k == n), "id_unique", "warning", k)))
    out = both.select(F.explode(found).alias("_f")).select("_f.*")
    dup = duplicate_rows(df)
    whole = dup.select(F.explode(F.array_compact(F.array(
        F.when(F.col("n_rows") == 0, F.struct(F.lit(None).cast("string").alias("column"), F.lit("empty").alias("check"), F.lit("error").alias("severity"), F.lit(0.0).alias("value"))),
        F.when(F.col("duplicate_rows") > 0, F.struct(F.lit(None).cast("string").alias("column"), F.lit("duplicates").alias("check"), F.lit("warning").alias("severity"), F.col("duplicate_pct").alias("value")))))).alias("_f")).select("_f.*")
    out = out.unionByName(whole)
    if target is not None and target not in df.columns:
        out = out.unionByName(spark.createDataFrame([(target, "target_missing", "error", None)], out.schema))
    return out


def eda_bundle(df: DataFrame) -> dict[str, DataFrame]:
    """The reports of an exploration, by name."""
    return {"summary": describe(df), "numeric": numeric_cards(df), "categorical": categorical_cards(df), "correlations": correlations(df)}
