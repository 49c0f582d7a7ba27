"""Feature engineering and selection."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import stats
from ..functions.ranks import exact_quantiles, running_sums
from ..sources.stored import store


def log_features(df: DataFrame, threshold: float = 1.0, columns: list[str] | None = None) -> DataFrame:
    """Adds column_log = log1p(column) where the corrected skewness is above the threshold and all values are known and >= 0."""
    columns = columns or X.numeric_columns(df)
    rows = X.long_form(X.missing_free(df), columns).groupBy("column").agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("all"), F.min("value").alias("low"), F.skewness("value").alias("s"))
    picked = {r["column"] for r in rows.filter((F.col("n") == F.col("all")) & (F.col("low") >= 0) & (X.unbiased_skew(F.col("s"), F.col("n")) > threshold)).collect()}
    return df.withColumns({f"{c}_log": F.log1p(F.col(c)) for c in columns if c in picked})


def interactions(df: DataFrame, degree: int = 2, max_features: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Products of up to ``degree`` of the first ``max_features`` numeric columns, named "a b"."""
    base = (columns or X.numeric_columns(df))[:max_features]
    made = {}
    for d in range(2, degree + 1):
        for group in combinations(base, d):
            product = F.col(group[0])
            for c in group[1:]:
                product = product * F.col(c)
            made[" ".join(group)] = product
    return df.withColumns({name: p for name, p in made.items() if name not in df.columns}) if made else df


def ratio(df: DataFrame, numerator: str, denominator: str, epsilon: float = 1e-6) -> DataFrame:
    if not {numerator, denominator} <= set(df.columns):
        return df
    return df.withColumn(f"ratio_{numerator}_per_{denominator}", F.col(numerator) / (F.col(denominator) + epsilon))


def _sums(df: DataFrame, features: list[str], label: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])
    return df.select(F.col(label).alias("_y"), F.explode(parts).alias("_p")).select("_y", "_p.*").filter(F.col("v").isNotNull() & F.col("_y").isNotNull())


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, place, f, p_value: one-way F of each feature over the classes, from counts and sums."""
    by = _sums(df, features, label).groupBy("place", "feature", "_y").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    within = F.sum(F.col("n") * F.col("s"))
    total = by.groupBy("place", "feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), within.alias("within"), (F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("between"))
    f = (F.col("between") / (F.col("k") - 1)) / F.nullif(F.col("within") / (F.col("n") - F.col("k")), F.lit(0.0))
    tail = F.udf(lambda f, a, b: None if f is None or a < 1 or b < 1 else float(stats.f_tail(f, a, b)), "double")  # a row a feature
    return total.select("feature", "place", f.alias("f"), tail(f, F.col("k") - 1, F.col("n") - F.col("k")).alias("p_value"))


def f_regression(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, place, f: r^2 / (1 - r^2) (n - 2)."""
    by = _sums(df, features, label).groupBy("place", "feature").agg(F.count(F.lit(1)).alias("n"), F.corr("v", F.col("_y").cast("double")).alias("r"))
    return by.select("feature", "place", (F.col("r") ** 2 / F.nullif(1 - F.col("r") ** 2, F.lit(0.0)) * (F.col("n") - 2)).alias("f"))


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """feature, place, mi in nats between quantile bins of the feature and the label (binned too if it is fractional)."""
    points = [i / bins for i in range(1, bins)]
    cuts = dict.fromkeys(features) | {r["column"]: r["q"] for r in exact_quantiles(X.long_form(X.missing_free(df.select(*features)), features), points).collect()}
    parts = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"),
                      sum((F.when(F.col(c) > x, 1).otherwise(0) for x in sorted(set(cuts[c] or []))), F.lit(0)).alias("x")) for i, c in enumerate(features)]
    y = F.col(label)
    if dict(df.dtypes)[label] in ("double", "float"):
        found = exact_quantiles(X.long_form(X.missing_free(df.select(label)), [label]), points).collect()
        edges = sorted(set(found[0]["q"])) if found else []
        y = sum((F.when(F.col(label) > x, 1).otherwise(0) for x in edges), F.lit(0))
    joint = df.filter(F.col(label).isNotNull()).select(y.alias("y"), F.explode(F.array(*parts)).alias("_p")).select("y", "_p.*").groupBy("place", "feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    px, py, all_ = (Window.partitionBy("place", "feature", *c) for c in (["x"], ["y"], []))  # over the cells of the table
    joint = joint.withColumns({"nx": F.sum("n").over(px), "ny": F.sum("n").over(py), "na": F.sum("n").over(all_)})
    return joint.groupBy("feature", "place").agg(F.sum(F.col("n") / F.col("na") * F.log(F.col("n") * F.col("na") / (F.col("nx") * F.col("ny")))).alias("mi"))


def _last_nearer(v: np.ndarray, r: np.ndarray, side: int) -> np.ndarray:
    """The furthest numbers on a side of v whose difference to it, as it rounds, is below r; by halving."""
    near, far = v.copy(), v + 2 * side * r
    for _ in range(130):
        middle = (near + far) / 2
        nearer = np.abs(middle - v) < r
        near, far = np.where(nearer, middle, near), np.where(nearer, far, middle)
    return near


def neighbour_information(df: DataFrame, features: list[str], label: str, k: int = 3, cell_rows: int = 50_000) -> DataFrame:
    """feature, place, mi in nats between each continuous feature and the classes, by nearest neighbours (Ross 2014).

    A row's radius is the distance to its k-th neighbour of its own class (fewer, if the class is smaller); it counts the
    rows of all classes that are nearer. Then mi is digamma(n) plus the means of digamma(k), less those of digamma of the
    class size and of the count, 0 at least. Neighbours are found in ordered cells of a class that overlap by k rows, and
    counts are differences of ranks. Rows with null or non-finite values take no part, nor do classes of one row.
    """
    rows = _sums(df, features, label).filter(~F.isnan("v") & (F.abs("v") != float("inf")))
    rows = running_sums(rows.withColumn("one", F.lit(1)), ["place", "_y"], ["v"], "one", "rank")
    own = rows.select("place", "feature", "_y", "v", "rank").withColumn("cells", F.array_distinct(F.transform(F.array(*map(F.lit, (-k, 0, k))), lambda o: F.floor((F.col("rank") + o) / cell_rows))))
    cells = own.select("place", "feature", "_y", "v", "rank", F.explode("cells").alias("cell")).filter("cell >= 0")
    kind = dict(cells.dtypes)["_y"]

    def radii(table: pa.Table) -> pa.Table:
        """The bounds of a cell's own rows: the least and the greatest values nearer than the k-th neighbour of the class."""
        rank = table.column("rank").to_numpy()
        order = np.argsort(rank)
        v, home = table.column("v").to_numpy()[order], rank[order] // cell_rows == table.column("cell")[0].as_py()
        most = min(k, len(v) - 1)
        if most == 0:
            return table.slice(0, 0).select(["place", "feature", "_y"]).append_column("v", pa.array([], pa.float64())).append_column("low", pa.array([], pa.float64())).append_column("high", pa.array([], pa.float64())).append_column("k", pa.array([], pa.int32()))
        padded = np.concatenate((np.full(most, -np.inf), v, np.full(most, np.inf)))
        away = np.stack([np.abs(padded[most + s : most + s + len(v)] - v) for s in [*range(-most, 0), *range(1, most + 1)]])
        r = np.sort(away, axis=0)[most - 1]
        low, high = (np.where(r > 0, _last_nearer(v, r, side), v) for side in (-1, 1))
        at = np.flatnonzero(home)
        head = table.take(pa.array(order[at])).select(["place", "feature", "_y"])
        return head.append_column("v", pa.array(v[at])).append_column("low", pa.array(low[at])).append_column("high", pa.array(high[at])).append_column("k", pa.array(np.full(len(at), most, np.int32)))

    found = store(cells.groupBy("place", "_y", "cell").applyInArrow(radii, f"place int, feature string, _y {kind}, v double, low double, high double, k int"))
    found = found.withColumn("id", F.monotonically_increasing_id())
    # Values, lower bounds before equal values and upper ones after them, in one order: a bound's rank is its count of values.
    line = found.select("place", F.col("v").alias("x"), F.lit(1).alias("turn"), F.lit(1).alias("weight"), F.lit(None).cast("long").alias("id"))
    for turn, bound in ((0, "low"), (2, "high")):
        line = line.unionByName(found.select("place", F.col(bound).alias("x"), F.lit(turn).alias("turn"), F.lit(0).alias("weight"), "id"))
    ranks = running_sums(line, ["place"], ["x", "turn"], "weight").filter("turn <> 1")
    count = ranks.groupBy("id").agg(F.sum(F.when(F.col("turn") == 2, F.col("before")).otherwise(-F.col("before"))).alias("m"))
    sizes = found.groupBy(F.col("place").alias("_p"), F.col("_y").alias("_l")).agg(F.count(F.lit(1)).alias("size"), F.first("feature").alias("feature"), F.first("k").alias("k"))
    of = F.pandas_udf(lambda x: pd.Series(stats.digamma(x.to_numpy())), "double")
    near = found.select("id", "place").join(count, "id").groupBy(F.col("place").alias("_q")).agg(F.avg(of(F.col("m").cast("double"))).alias("near"))
    size = F.col("size")
    by = store(sizes).groupBy("_p", "feature").agg(F.sum("size").alias("n"), (F.sum(size * of(F.col("k").cast("double"))) / F.sum(size)).alias("psi_k"), (F.sum(size * of(size.cast("double"))) / F.sum(size)).alias("psi_size"))
    mi = of(F.col("n").cast("double")) + F.col("psi_k") - F.col("psi_size") - F.col("near")
    return by.join(near, F.col("_p") == F.col("_q")).select("feature", F.col("_p").alias("place"), F.greatest(mi, F.lit(0.0)).alias("mi"))


def variance_filter(df: DataFrame, features: list[str], threshold: float = 0.0) -> DataFrame:
    """feature, place, variance, keep: population variance above the threshold (and not all one value)."""
    by = X.long_form(X.missing_free(df), features).filter("value IS NOT NULL").groupBy("column").agg(F.var_pop("value").alias("variance"), (F.max("value") - F.min("value")).alias("range"))
    place = F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(c), F.lit(i))])
    return by.select(F.col("column").alias("feature"), place[F.col("column")].alias("place"), "variance", ((F.col("variance") > threshold) & (F.col("range") > 0)).alias("keep"))


def top_k(scores: DataFrame, score: str, k: int) -> list[str]:
    """The k best features by score (ties to the earlier column), in column order."""
    best = scores.orderBy(F.desc_nulls_last(score), "place").limit(k).collect()
    return [r["feature"] for r in sorted(best, key=lambda r: r["place"])]


def select_top_k(df: DataFrame, features: list[str], label: str, k: int = 4, method: str = "anova", task: str = "classification") -> list[str]:
    """By ``method``: anova (F scores), mutual_info (of quantile bins) or neighbour_info (of nearest neighbours, for classes)."""
    if method == "neighbour_info":
        return top_k(neighbour_information(df, features, label), "mi", k)
    if method == "mutual_info":
        return top_k(mutual_information(df, features, label), "mi", k)
    return top_k(anova_f(df, features, label) if task == "classification" else f_regression(df, features, label), "f", k)


def _forest(task: str, trees: int, seed: int):
    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    return kind(numTrees=trees, seed=seed, maxDepth=8, featuresCol="_x", labelCol="_y")


def tree_importance(df: DataFrame, features: list[str], label: str, task: str = "classification", trees: int = 50, seed: int = 42) -> list[tuple[str, float]]:
    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.withColumn("_y", F.col(label).cast("double")))
    found = _forest(task, trees, seed).fit(rows.select("_x", "_y")).featureImportances.toArray()
    return sorted(zip(features, map(float, found), strict=True), key=lambda p: (-p[1], features.index(p[0])))


def recursive_elimination(df: DataFrame, features: list[str], label: str, keep: int = 4, task: str = "classification", trees: int = 30, seed: int = 42) -> list[str]:
    """Drops the feature with the least forest importance, one by one, over a cached projection."""
    rows = df.select(*features, label).persist()
    try:
        left = list(features)
        while len(left) > keep:
            left.remove(tree_importance(rows, left, label, task, trees, seed)[-1][0])
        return left
    finally:
        rows.unpersist()
