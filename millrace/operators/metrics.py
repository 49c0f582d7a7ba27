"""Metrics of predictions, clusters and runs, as aggregations. Ranks come from a distributed prefix sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import prefix_sums
from . import allpairs

#: Fixed values of the metric registry: direction, tasks and the value that passes.
DIRECTION = {
    "accuracy": "maximize", "precision": "maximize", "recall": "maximize", "f1": "maximize", "roc_auc": "maximize",
    "pr_auc": "maximize", "r2": "maximize", "adjusted_r2": "maximize", "mae": "minimize", "mse": "minimize", "rmse": "minimize",
    "loss": "minimize", "silhouette": "maximize", "davies_bouldin": "minimize", "calinski_harabasz": "maximize",
}
PASS_AT = {"accuracy": 0.70, "precision": 0.65, "recall": 0.65, "f1": 0.65, "roc_auc": 0.70, "r2": 0.50, "rmse": 1.0, "mae": 1.0, "mse": 1.0, "silhouette": 0.30, "davies_bouldin": 1.5}
PREFERRED = {"classification": ["f1", "accuracy", "roc_auc", "precision", "recall"], "clustering": ["silhouette"], "regression": ["r2", "rmse", "mae", "mse"]}


#: Clusters whose pairs are compared, and whose means are sent to all tasks.
MAX_CLUSTERS = 10_000


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, label: str, prediction: str, positive=1, beta: float = 2.0) -> DataFrame:
    """One row of accuracy, precision, recall, f1, specificity, f_beta and the four counts; 0 where undefined."""
    y, p = F.col(label) == positive, F.col(prediction) == positive
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"), F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    b = beta * beta
    return c.select("tp", "fp", "fn", "tn", "accuracy", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"),
                    ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), ratio((1 + b) * precision * recall, b * precision + recall).alias("f_beta"))


def weighted_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """accuracy and support-weighted precision, recall and f1."""
    cells = confusion(df, label, prediction)
    ends = cells.select("n", F.explode(F.array(F.struct(F.col("label").cast("string").alias("c"), F.lit(0).alias("side")), F.struct(F.col("prediction").cast("string").alias("c"), F.lit(1).alias("side")))).alias("e"),
                        (F.col("label").cast("string") == F.col("prediction").cast("string")).alias("same"))
    side = F.col("e.side")
    by = ends.groupBy(F.col("e.c").alias("c")).agg(F.sum(F.when(side == 0, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(side == 1, F.col("n")).otherwise(0)).alias("predicted"),
                                                   F.sum(F.when((side == 0) & F.col("same"), F.col("n")).otherwise(0)).alias("hit"))
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    w = lambda x: F.sum(x * F.col("support")) / F.sum("support")
    return by.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), w(p).alias("precision"), w(r).alias("recall"), w(ratio(2 * p * r, p + r)).alias("f1"))


def regression_metrics(df: DataFrame, label: str, prediction: str, features: int | None = None) -> DataFrame:
    """mse, rmse, mae, r2 and, given the number of features, adjusted_r2."""
    y, e = F.col(label).cast("double"), F.col(label) - F.col(prediction)
    a = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"), F.count(F.lit(1)).alias("_n"))
    r2 = 1 - F.col("mse") / F.nullif(F.col("_v"), F.lit(0.0))
    out = [F.col("mse"), F.sqrt("mse").alias("rmse"), F.col("mae"), r2.alias("r2")]
    if features is not None:
        out.append(F.when(F.col("_n") > features + 1, 1 - (1 - r2) * (F.col("_n") - 1) / (F.col("_n") - features - 1)).alias("adjusted_r2"))
    return a.select(*out)


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Area under the ROC curve by ranks, ties half; null where a class is missing."""
    y = F.col(label) == positive
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    summed = prefix_sums(counts, [], "s", ["n"])
    won = F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2.0))
    return summed.agg((won / F.nullif((F.sum("p") * F.sum("n")).cast("double"), F.lit(0.0))).alias("roc_auc"))


def pr_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Average precision: precision at each score from the top, weighted by the recall it adds."""
    y = F.col(label) == positive
    counts = df.filter(F.col(score).isNotNull()).groupBy((-F.col(score).cast("double")).alias("s")).agg(F.count_if(y).alias("p"), F.count(F.lit(1)).alias("a"))
    summed = prefix_sums(counts, [], "s", ["p", "a"])
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_a") + F.col("a"))
    return summed.agg((F.sum(F.col("p") * precision) / F.nullif(F.sum("p").cast("double"), F.lit(0.0))).alias("pr_auc"))


def _points(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    return df.select(F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v"))


def _centroids(points: DataFrame) -> DataFrame:
    """c, n and the mean vector m; there is a row for each cluster."""
    means = points.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    means = means.groupBy("c").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_m"))
    return means.select("c", "n", F.transform("_m", lambda p: p["x"]).alias("m"))


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cluster_metrics(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """n_clusters, davies_bouldin, inertia, calinski_harabasz; below two clusters infinity and 0.

    Two passes over the points: centroids, then distances to them; the rest is between centroids.
    """
    points = _points(df, vector, cluster)
    centres = _centroids(points)
    near = points.join(F.broadcast(centres.select(F.col("c").alias("_c"), "m")), F.col("c") == F.col("_c")).select("c", distance2(F.col("v"), F.col("m")).alias("d2"))
    spread = near.groupBy(F.col("c").alias("_s")).agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"))
    k = centres.join(F.broadcast(spread), F.col("c") == F.col("_s")).select("c", "n", "m", "s", "w")
    if k.count() > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters: pairs of clusters are compared")
    other = k.select(F.col("c").alias("oc"), F.col("m").alias("om"), F.col("s").alias("os"))
    pair = k.join(F.broadcast(other), F.col("c") != F.col("oc")).select("c", ((F.col("s") + F.col("os")) / F.sqrt(distance2(F.col("m"), F.col("om")))).alias("r"))
    db = pair.groupBy("c").agg(F.max("r").alias("r")).agg(F.avg("r").alias("_db"))
    weights = k.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"), F.collect_list(F.struct("n", "m")).alias("cs"))
    middle = weights.withColumn("g", F.aggregate("cs", F.transform(F.col("cs")[0]["m"], lambda x: x * 0.0), lambda s, c: F.zip_with(s, c["m"], lambda x, y: x + y * c["n"])))
    between = F.aggregate("cs", F.lit(0.0), lambda s, c: s + c["n"] * distance2(c["m"], F.transform("g", lambda x: x / F.col("n"))))
    ch = (between / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return middle.crossJoin(F.broadcast(db)).select(F.col("k").alias("n_clusters"), F.when(F.col("k") < 2, float("inf")).otherwise(F.col("_db")).alias("davies_bouldin"), F.col("w").alias("inertia"), F.when(F.col("k") < 2, 0.0).otherwise(ch).alias("calinski_harabasz"))  # one row each


def silhouette_squared(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Mean silhouette by squared Euclidean distance, in closed form from each cluster's n, mean and mean square; 0 below two clusters."""
    points = _points(df, vector, cluster)
    squares = points.groupBy(F.col("c").alias("_q")).agg(F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("q"))
    k = _centroids(points).join(F.broadcast(squares), F.col("c") == F.col("_q")).agg(F.collect_list(F.struct("c", "n", "m", "q")).alias("ks"))
    # Mean squared distance to a cluster: |v|^2 + mean square - 2 v.mean; clusters are few, points stay where they are.
    v2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = points.crossJoin(F.broadcast(k)).withColumn("ds", F.transform("ks", lambda c: F.struct(c["c"].alias("c"), c["n"].alias("n"), (v2 + c["q"] - 2 * dot(F.col("v"), c["m"])).alias("d"))))  # one row
    own = F.element_at(F.filter("ds", lambda d: d["c"] == F.col("c")), 1)
    a = own["d"] * own["n"] / F.nullif(own["n"] - 1, F.lit(0))
    b = F.array_min(F.transform(F.filter("ds", lambda d: d["c"] != F.col("c")), lambda d: d["d"]))
    s = F.when(own["n"] == 1, 0.0).otherwise((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)))
    return rows.agg(F.coalesce(F.avg(F.coalesce(s, F.lit(0.0))), F.lit(0.0)).alias("silhouette"))


def silhouette(df: DataFrame, key: str, vector: str, cluster: str, sample: int | None = None) -> DataFrame:
    """Mean Euclidean silhouette of all points, or of up to ``sample`` ones (by hash of the key), against all points.

    Points lie in blocks, ordered by cluster. A task reads them one by one against its own and keeps two means a point, so disk
    holds the points once and nothing of a pair is shuffled. The work without a sample is quadratic, as the figure's
    definition is. A point alone in its cluster, without a cluster or without another one counts as 0. Keys are distinct.
    """
    points = df.select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    asked = points if sample is None else points.orderBy(F.xxhash64("k")).limit(sample)
    d, n = points.agg(F.max(F.size("v"))).first()[0] or 1, asked.count()
    order = [F.col("c"), F.xxhash64("k")]
    everyone = allpairs.blocks(points.filter("c IS NOT NULL"), d, order)
    ours = everyone if sample is None else allpairs.blocks(asked.filter("c IS NOT NULL"), d, order)

    def worth(i: int) -> Iterator[pa.RecordBatch]:
        mine = ours.read(i)
        x, labels = allpairs.matrix(mine), _labels(mine)
        own, other = np.zeros(len(x)), np.full(len(x), np.inf)
        held, total, size = labels[:0], np.zeros(len(x)), 0  # the cluster that is being read

        def close(which, rows: slice, sums: np.ndarray, sizes: np.ndarray) -> None:
            """Clusters whose sums of distances are whole."""
            same = labels[rows][:, None] == which
            at, of = np.nonzero(same)
            with np.errstate(divide="ignore", invalid="ignore"):
                own[rows][at] = sums[at, of] / (sizes[of] - 1)
            other[rows] = np.minimum(other[rows], np.where(same, np.inf, sums / sizes).min(1))

        for j in range(len(everyone.names)):
            table = everyone.read(j)
            y, theirs = allpairs.matrix(table), _labels(table)
            for at in range(0, len(y), allpairs.WIDE):
                some = theirs[at : at + allpairs.WIDE]
                starts = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
                sizes, names = np.diff(starts, append=len(some)), some[starts]
                goes_on = size > 0 and names[0] == held[0]
                for row, _, away in allpairs.distances(x, y[at : at + allpairs.WIDE]):
                    rows = slice(row, row + len(away))
                    sums = np.add.reduceat(away, starts, axis=1)
                    whole = sizes.copy()
                    if goes_on:
                        sums[:, 0] += total[rows]
                        whole[0] += size
                    elif size:
                        close(held, rows, total[rows][:, None], np.array([size]))
                    if len(names) > 1:
                        close(names[:-1], rows, sums[:, :-1], whole[:-1])
                    total[rows] = sums[:, -1]
                size = int(sizes[-1]) + (size if goes_on and len(names) == 1 else 0)
                held = names[-1:]
        if size and len(x):
            close(held, slice(0, len(x)), total[:, None], np.array([size]))
        most = np.maximum(own, other)
        known = np.isfinite(own) & np.isfinite(other) & (most > 0)
        share = (other[known] - own[known]) / most[known]
        yield pa.RecordBatch.from_arrays([pa.array([float(share.sum())])], names=["s"])

    return ours.each(worth, "s double").agg((F.coalesce(F.sum("s"), F.lit(0.0)) / max(1, n)).alias("silhouette"))


def _labels(table: pa.Table) -> np.ndarray:
    found = table.column("c").to_numpy()
    return found if found.dtype != object else found.astype(str)


def primary_metric(metrics: DataFrame, run: str = "run", task: str = "task") -> DataFrame:
    """Of rows (run, task, place, metric, value), each run's primary metric with its direction: by preference, else the first."""
    rank = F.lit(99)
    for kind, names in PREFERRED.items():
        for k, name in enumerate(names):
            rank = F.when((F.col(task) == kind) & (F.col("metric") == name), k).otherwise(rank)
    first = metrics.groupBy(run).agg(F.min(F.struct(rank.alias("r"), F.col("place"), F.col("metric"), F.col("value"))).alias("m"))
    return first.select(run, F.col("m.metric").alias("metric"), F.col("m.value").alias("value"), direction(F.col("m.metric")).alias("direction"))


def direction(metric: Column) -> Column:
    return F.when(F.lower(metric).isin(*[m for m, d in DIRECTION.items() if d == "minimize"]), "minimize").otherwise("maximize")


def threshold_check(metrics: DataFrame) -> DataFrame:
    """Rows (metric, value, ...) with threshold and passed; metrics without a threshold get null."""
    at = F.create_map(*[x for k, v in PASS_AT.items() for x in (F.lit(k), F.lit(v))])[F.lower("metric")]
    return metrics.withColumn("threshold", at).withColumn("passed", F.when(direction(F.col("metric")) == "minimize", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold")))
