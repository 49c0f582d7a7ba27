"""Splits, model zoos, cross-validation, tuning, saved models and mean shift, on Spark ML."""

from __future__ import annotations

import json
import logging
import random
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.tables import scratch_dir
from . import kernels, neighbours
from .metrics import distance2, regression_metrics, weighted_metrics


def train_test_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """By a hash of the key, the same for every partitioning."""
    share = X.hash_fraction(F.col(key), seed)
    return df.filter(share >= test), df.filter(share < test)


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", X.hash_bucket(F.col(key), k, seed))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, parts: int = 256) -> DataFrame:
    """Folds whose share of each label differs by a row in each part; a label is numbered in parts, not in one task."""
    part = X.hash_bucket(F.col(key), parts, seed + 1)
    order = Window.partitionBy(label, "_part").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    return df.withColumn("_part", part).withColumn("fold", F.pmod(F.row_number().over(order) + F.col("_part"), F.lit(k)).cast("int")).drop("_part")


def classifiers(n: int, seed: int = 42, classes: int = 2) -> dict[str, object]:
    """Estimators on ``features`` and ``label``. ``n`` is the number of train rows, by which the penalty is scaled."""
    zoo: dict[str, object] = {
        "LogisticRegression": C.LogisticRegression(maxIter=100, regParam=1.0 / max(1, n), standardization=False),
        "GaussianNB": C.NaiveBayes(modelType="gaussian"),
        "DecisionTree": C.DecisionTreeClassifier(maxDepth=5, seed=seed),
        "RandomForest": C.RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed),
        "GradientBoosting": C.GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
        "LinearSVM": C.LinearSVC(maxIter=100, regParam=1.0 / max(1, n)),
        "SVM": kernels.RbfClassifier(seed=seed),
        "KNN": kernels.Neighbours(5),
    }
    if classes > 2:
        zoo |= {k: C.OneVsRest(classifier=zoo[k]) for k in ("GradientBoosting", "LinearSVM")}
    return zoo


def regressors(n: int, seed: int = 42) -> dict[str, object]:
    return {
        "LinearRegression": R.LinearRegression(), "Ridge": R.LinearRegression(regParam=1.0 / max(1, n), standardization=False),
        "Lasso": R.LinearRegression(regParam=0.1, elasticNetParam=1.0, standardization=False), "ElasticNet": R.LinearRegression(regParam=0.1, elasticNetParam=0.5, standardization=False),
        "DecisionTree": R.DecisionTreeRegressor(maxDepth=5, seed=seed), "RandomForest": R.RandomForestRegressor(numTrees=100, maxDepth=10, seed=seed),
        "GradientBoosting": R.GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed), "Huber": R.LinearRegression(loss="huber"),
        "SVR": kernels.RbfRegressor(seed=seed), "KNN": kernels.Neighbours(5, vote=False),
    }


def clusterers(k: int = 3, seed: int = 42) -> dict[str, object]:
    """DBSCAN has a radius of 0.5 and cores of 5 points; mean shift, for up to 3 dimensions, a bandwidth of 1."""
    return {
        "KMeans": K.KMeans(k=k, seed=seed), "Bisecting": K.BisectingKMeans(k=k, seed=seed), "Hierarchical": kernels.Agglomerative(k, seed=seed),
        "DBSCAN": kernels.Clustering(lambda rows, key, v: neighbours.dbscan(rows, key, v, 0.5, 5)), "MeanShift": kernels.Clustering(lambda rows, key, v: shifted(rows, key, v, 1.0)),
    }


def shifted(rows: DataFrame, key: str, vector: str, bandwidth: float) -> DataFrame:
    """Mean shift of a column of vectors."""
    d = rows.agg(F.max(F.size(vector))).first()[0] or 1
    return mean_shift(rows.select(key, *[F.get(vector, F.lit(i)).alias(f"x{i}") for i in range(d)]), key, [f"x{i}" for i in range(d)], bandwidth)


def best_kmeans(df: DataFrame, k: int = 3, starts: int = 10, seed: int = 42):
    """The k-means model with the least cost of several starts; ``df`` should be cached."""
    return min((K.KMeans(k=k, seed=seed + i).fit(df) for i in range(starts)), key=lambda m: m.summary.trainingCost)


#: Baseline candidates by task.
DEFAULTS = {"classification": ["RandomForest", "GradientBoosting", "LogisticRegression"], "regression": ["RandomForest", "GradientBoosting", "Ridge"], "clustering": ["KMeans", "Bisecting"]}


def zoo_of(task: str, n: int, seed: int = 42, classes: int = 2) -> dict[str, object]:
    return classifiers(n, seed, classes) if task == "classification" else regressors(n, seed) if task == "regression" else clusterers(3, seed)


def assemble(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    return out if label is None else out.withColumn("label", F.col(label).cast("double"))


def train_candidates(df: DataFrame, task: str = "classification", names: list[str] | None = None, seed: int = 42, zoo: dict | None = None) -> dict[str, object]:
    """Fitted models by name on assembled rows; one that fails is left out, and the log says why."""
    zoo = zoo or zoo_of(task, df.count(), seed)
    out = {}
    for name in names or [n for n in DEFAULTS[task] if n in zoo]:
        try:
            out[name] = zoo[name].fit(df)
        except Exception as e:  # noqa: BLE001 a candidate's failure isn't the run's
            logging.getLogger(__name__).warning("%s failed: %s", name, e)
    return out


def leaderboard(train: DataFrame, test: DataFrame, task: str = "classification", zoo: dict | None = None, seed: int = 42) -> DataFrame:
    """A row a model: metrics on test, seconds, error; failed models last, the best first."""
    spark = train.sparkSession
    train, test = train.persist(), test.persist()
    rows = []
    try:
        for name, estimator in (zoo or zoo_of(task, train.count(), seed)).items():
            try:
                began = time.perf_counter()
                model = estimator.fit(train)
                fitted = time.perf_counter()
                scored = model.transform(test)
                scored.select("prediction").write.format("noop").mode("overwrite").save()
                done = time.perf_counter()
                m = (weighted_metrics if task == "classification" else regression_metrics)(scored, "label", "prediction").collect()[0].asDict()
                rows.append((name, *[None if m.get(k) is None else round(m[k], 4) for k in ("accuracy", "precision", "recall", "f1", "r2", "rmse", "mse")], round(fitted - began, 4), round(done - fitted, 4), None))
            except Exception as e:  # noqa: BLE001
                rows.append((name, *[None] * 9, str(e)[:500]))
    finally:
        train.unpersist()
        test.unpersist()
    schema = "model string, accuracy double, precision double, recall double, f1 double, r2 double, rmse double, mse double, train_seconds double, infer_seconds double, error string"
    return spark.createDataFrame(rows, schema).orderBy(F.desc_nulls_last("accuracy" if task == "classification" else "r2"), "model")


def _evaluator(task: str):
    return MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification" else RegressionEvaluator(metricName="r2") if task == "regression" else ClusteringEvaluator()


def cross_validate(df: DataFrame, task: str = "classification", zoo: dict | None = None, k: int = 5, fold: str = "fold", parallelism: int = 6) -> DataFrame:
    """model, mean, std (population) of the score over folds, error, best. ``df`` has the fold column; a failing model scores 0.

    A model is fitted once a fold, on the other folds; ``parallelism`` fits of any models and folds run at a time.
    """
    evaluator, estimators = _evaluator(task), (zoo or zoo_of(task, df.count())).items()
    parts = [(df.filter(F.col(fold) != i).persist(), df.filter(F.col(fold) == i).persist()) for i in range(k)]

    def score(job: tuple[str, object, DataFrame, DataFrame]) -> tuple[str, float | None, str | None]:
        name, estimator, train, held = job
        try:
            return name, float(evaluator.evaluate(estimator.copy().fit(train).transform(held))), None
        except Exception as e:  # noqa: BLE001 a candidate's failure is a row
            return name, None, str(e)[:500]

    wrong = _unfit(df, parts, fold, k)
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            jobs = [] if wrong else [(name, e, *part) for name, e in estimators for part in parts]
            done = list(pool.map(inheritable_thread_target(df.sparkSession)(score), jobs))
    finally:
        for part in (x for both in parts for x in both):
            part.unpersist()
    rows = []
    for name, _ in estimators:
        scores, error = [s for n, s, _ in done if n == name], next((e for n, _, e in done if n == name and e is not None), wrong)
        rows.append((name, 0.0, 0.0, error) if error is not None else (name, round(float(np.mean(scores)), 4), round(float(np.std(scores)), 4), None))
    best = max((r for r in rows if r[3] is None), key=lambda r: r[1], default=(None,))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "model string, mean double, std double, error string, best boolean")


def _unfit(df: DataFrame, parts: list[tuple[DataFrame, DataFrame]], fold: str, k: int) -> str | None:
    """Why folds can't be used; the cached parts are computed, once for all models."""
    if not df.filter(F.coalesce(~F.col(fold).between(0, k - 1), F.lit(True))).isEmpty():
        return f"{fold} isn't within 0 and {k - 1} everywhere"
    empty = [i for i, both in enumerate(parts) if not min(part.count() for part in both)]
    return f"fold {empty[0]} or its rest is empty" if empty else None


def grid_search(df: DataFrame, estimator, grid: dict[str, list], task: str = "classification", k: int = 3, fold: str | None = None, parallelism: int = 2, picks: int | None = None, seed: int = 42):
    """(best parameters, score, model fitted on all rows) over the grid, or over ``picks`` of its points drawn by seed."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder.addGrid(getattr(estimator, name), values)
    points = builder.build()
    if picks is not None and picks < len(points):
        points = random.Random(seed).sample(points, picks)
    args = {"foldCol": fold} if fold else {"seed": seed}
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=points, evaluator=_evaluator(task), numFolds=k, parallelism=parallelism, **args).fit(df)
    best = max(range(len(points)), key=cv.avgMetrics.__getitem__)
    return {p.name: v for p, v in points[best].items()}, round(float(cv.avgMetrics[best]), 4), cv.bestModel


def save_model(model: PipelineModel, path: str, train: DataFrame, features: list[str], target: str, metrics: dict) -> None:
    """The fitted pipeline and, beside it, its contract: features with their types in ``train``, target and metrics."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    types = {c: kind for c, kind in train.dtypes if c in features}
    contract = json.dumps({"features": features, "types": types, "target": target, "metrics": metrics})
    spark.createDataFrame([(contract,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def predict(df: DataFrame, path: str) -> DataFrame:
    """Predictions of a saved model on a batch or a stream, after the contract's columns are checked."""
    contract = json.loads("".join(r["value"] for r in df.sparkSession.read.text(f"{path}/contract").collect()))
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c)}, not {kind}" for c, kind in contract["types"].items() if have.get(c) != kind]
    if wrong:
        raise ValueError(f"columns that are missing or of another type: {wrong}")
    return PipelineModel.load(f"{path}/model").transform(df)


def feature_pipeline(features: list[str], label: str, estimator, statements: list[str] | None = None) -> Pipeline:
    """SQL statements over __THIS__, then assembly and the estimator, as one unit that folds refit."""
    steps = [SQLTransformer(statement=s) for s in statements or []]
    return Pipeline(stages=[*steps, SQLTransformer(statement=f"SELECT *, CAST({label} AS DOUBLE) AS label FROM __THIS__"), VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), estimator])


def mean_shift(df: DataFrame, key: str, columns: list[str], bandwidth: float) -> DataFrame:
    """key and cluster (from 0, by descending support) of a flat-kernel mean shift whose seeds are the occupied grid cells.

    Points are summed up by cell once (count and sums); in a round each seed takes the mean of the cells' points whose
    cell mean is within the bandwidth. Seeds are few where the bandwidth is wide, and they stay on the cluster: a round is
    a join on neighbouring cells. Modes nearer than the bandwidth merge; each point goes to the nearest mode. More than
    1,000 modes are refused: the bandwidth is too small to find clusters with.
    """
    scratch_dir(df.sparkSession)
    n = len(columns)
    if n > 3:
        raise ValueError("the grid is for up to 3 dimensions")
    point = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).na.drop()
    xs = [f"x{i}" for i in range(n)]
    cell = lambda c: F.floor(F.col(c) / bandwidth)
    fine = [F.floor(F.col(x) / (bandwidth / 4)) for x in xs]
    bins = point.groupBy(*[f.alias(f"f{i}") for i, f in enumerate(fine)]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in xs])
    bins = bins.select("n", *xs, *[cell(x).alias(f"c{i}") for i, x in enumerate(xs)]).checkpoint(eager=True)
    seeds = point.groupBy(*[cell(x).alias(f"c{i}") for i, x in enumerate(xs)]).agg(*[F.avg(x).alias(f"s{i}") for i, x in enumerate(xs)]).select(*[f"s{i}" for i in range(n)])
    seeds = seeds.distinct().checkpoint(eager=True)
    while True:  # each move raises the number of points near a seed or ends it
        around = seeds
        for i in range(n):
            around = around.withColumn(f"c{i}", F.explode(F.array(*[F.floor(F.col(f"s{i}") / bandwidth) + o for o in (-1, 0, 1)])))
        near = around.join(bins, [f"c{i}" for i in range(n)]).filter(sum(((F.col(f"s{i}") - F.col(x)) ** 2 for i, x in enumerate(xs)), F.lit(0.0)) <= bandwidth**2)
        keys = [f"s{i}" for i in range(n)]
        moved = near.groupBy(*keys).agg(*[(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(f"m{i}") for i, x in enumerate(xs)], F.sum("n").alias("support"))
        shift = F.sqrt(sum(((F.col(f"s{i}") - F.col(f"m{i}")) ** 2 for i in range(n)), F.lit(0.0)))
        moved = moved.select(*[F.round(f"m{i}", 9).alias(f"s{i}") for i in range(n)], shift.alias("shift"), "support").checkpoint(eager=True)
        seeds = moved.groupBy(*keys).agg(F.max("support").alias("support")).checkpoint(eager=True)
        if moved.filter(F.col("shift") > 1e-3 * bandwidth).isEmpty():
            break
    places = [f"s{i}" for i in range(n)]
    modes = seeds.groupBy(*[F.round(F.col(p) / bandwidth, 2) for p in places]).agg(F.max(F.struct("support", *places)).alias("m")).select("m.*")
    modes = modes.orderBy(F.desc("support"), *places).limit(1001).collect()
    if len(modes) > 1000:
        raise ValueError("the bandwidth leaves more than 1,000 modes")
    kept: list[tuple[float, ...]] = []
    for m in modes:
        at = tuple(m[f"s{i}"] for i in range(n))
        if all(sum((a - b) ** 2 for a, b in zip(at, o, strict=True)) > bandwidth**2 for o in kept):
            kept.append(at)
    table = df.sparkSession.createDataFrame([([(c, list(map(float, at))) for c, at in enumerate(kept)],)], "modes array<struct<c:int,m:array<double>>>")
    v = F.array(*xs)
    away = F.transform("modes", lambda m: F.struct(distance2(v, m["m"]).alias("d"), m["c"].alias("c")))
    return point.crossJoin(F.broadcast(table)).select(F.col("k").alias(key), F.array_min(away)["c"].alias("cluster"))  # one row
