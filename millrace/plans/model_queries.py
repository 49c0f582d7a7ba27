"""Registered queries of models, neighbours and clusters. The SQL is a closed form, or what a planted signal makes certain."""

from __future__ import annotations

import uuid

from pyspark.ml import regression
from pyspark.sql import functions as F

from ..operators import clean, features, metrics, models, neighbours
from ..sources import tables
from .queries import fraction, query, rounded, t

_CLASSIFIERS = ["LogisticRegression", "GaussianNB", "DecisionTree", "RandomForest", "GradientBoosting", "LinearSVM", "SVM", "KNN"]


def _separable(spark, sf_dir):
    """Customers whose balance tells the class, with a gap between the classes."""
    c = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("z"))
    c = c.withColumn("x", F.col("x") + F.when(F.col("x") > 4.5, 3.0).otherwise(-3.0)).withColumn("y", (F.col("x") > 4.5).cast("int"))
    return models.assemble(c, ["x", "z"], "y").select("c_custkey", "features", "label")


@query("SELECT unnest(['" + "', '".join(_CLASSIFIERS) + "']) AS model, true AS learned, true AS failed_none")
def classifier_leaderboard(spark, sf_dir):
    """All classifiers on separable classes: each gets nine in ten right."""
    train, test = models.train_test_split(_separable(spark, sf_dir), "c_custkey")
    board = models.leaderboard(train, test, "classification")
    return board.select("model", (F.col("accuracy") > 0.9).alias("learned"), F.col("error").isNull().alias("failed_none"))


@query("SELECT unnest(['RandomForest', 'GradientBoosting', 'LogisticRegression']) AS model, true AS learned")
def trained_candidates(spark, sf_dir):
    """The default candidates, fitted and used on held-out rows."""
    train, test = models.train_test_split(_separable(spark, sf_dir), "c_custkey")
    found = models.train_candidates(train.persist())
    rows = [(name, metrics.weighted_metrics(m.transform(test), "label", "prediction").collect()[0]["accuracy"] > 0.9) for name, m in found.items()]
    train.unpersist()
    return spark.createDataFrame(rows, "model string, learned boolean")


@query("SELECT unnest(['" + "', '".join(_CLASSIFIERS) + "']) AS model, true AS learned")
def cross_validated_classifiers(spark, sf_dir):
    rows = models.folds(_separable(spark, sf_dir), "c_custkey", 3).persist()
    out = models.cross_validate(rows, k=3)
    rows.unpersist()
    return out.select("model", (F.col("mean") > 0.9).alias("learned"))


@query("SELECT 5 AS max_depth, true AS learned")
def grid_search(spark, sf_dir):
    """Of trees of depth 0 and 5 the deeper one wins."""
    rows = models.folds(_separable(spark, sf_dir), "c_custkey", 3).persist()
    best, score, _ = models.grid_search(rows, models.classifiers(rows.count())["DecisionTree"], {"maxDepth": [0, 5]}, fold="fold")
    rows.unpersist()
    return spark.createDataFrame([(best["maxDepth"], score > 0.9)], "max_depth int, learned boolean")


@query("SELECT true AS in_grid, true AS learned")
def random_search(spark, sf_dir):
    """Two points of a grid, drawn by seed."""
    rows = models.folds(_separable(spark, sf_dir), "c_custkey", 3).persist()
    best, score, _ = models.grid_search(rows, models.classifiers(rows.count())["DecisionTree"], {"maxDepth": [2, 3, 4, 5]}, fold="fold", picks=2)
    rows.unpersist()
    return spark.createDataFrame([(best["maxDepth"] in (2, 3, 4, 5), score > 0.9)], "in_grid boolean, learned boolean")


_TRAIN, _TEST = f"{fraction('l_orderkey')} >= 0.2", f"{fraction('l_orderkey')} < 0.2"


@query(f"""WITH w AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem WHERE {_TRAIN}),
s AS (SELECT l_extendedprice AS y, a * l_quantity + b AS p FROM lineitem, w WHERE {_TEST}), m AS (SELECT avg(pow(y - p, 2)) AS mse, var_pop(y) AS v FROM s)
SELECT 'LinearRegression' AS model, round(1 - mse / v, 3) AS r2, round(sqrt(mse), 2) AS rmse FROM m""")
def least_squares_leaderboard(spark, sf_dir):
    df = models.assemble(t(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice").select("l_orderkey", "features", "label")
    train, test = models.train_test_split(df, "l_orderkey")
    board = models.leaderboard(train, test, "regression", {"LinearRegression": models.regressors(1)["LinearRegression"]})
    return board.select("model", F.round("r2", 3).alias("r2"), F.round("rmse", 2).alias("rmse"))


@query("SELECT l_orderkey, l_linenumber, round(2 * l_quantity - 40 * l_tax + 1, 3) AS prediction FROM lineitem")
def saved_model_predictions(spark, sf_dir):
    """A linear relation is learned, saved with its contract, loaded and applied to the whole table."""
    df = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax").withColumn("y", 2 * F.col("l_quantity") - 40 * F.col("l_tax") + 1)
    fitted = models.feature_pipeline(["l_quantity", "l_tax"], "y", regression.LinearRegression()).fit(df)
    path = f"{tables.scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    models.save_model(fitted, path, df, ["l_quantity", "l_tax"], "y", {"r2": 1.0})
    return models.predict(df, path).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@query("SELECT 'l_quantity' AS feature")
def recursive_elimination(spark, sf_dir):
    """The label is a function of one feature, which stays."""
    df = t(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_quantity") > 25).cast("int"))
    names = features.recursive_elimination(df, ["l_discount", "l_quantity", "l_tax"], "y", keep=1)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("SELECT 'l_quantity' AS feature, true AS most")
def forest_importance(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_quantity") > 25).cast("int"))
    name, share = features.tree_importance(df, ["l_discount", "l_quantity", "l_tax"], "y")[0]
    return spark.createDataFrame([(name, share > 0.5)], "feature string, most boolean")


_AWAY = "sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2))))"
_NEAR = f"""n AS (SELECT q.vec_id, p.vec_id AS near_key, p.label, {_AWAY} AS d FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = 0 AND p.vec_id % 20 <> 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, near_key) AS INT) AS rank FROM n)"""


@query(f"WITH {_NEAR}, v AS (SELECT vec_id, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY 1, 2) SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS k FROM v) WHERE k = 1")
def nearest_vote(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return neighbours.nearest_vote(e.filter("vec_id % 20 = 0"), e.filter("vec_id % 20 <> 0"), "vec_id", "embedding", "label")


@query(f"WITH {_NEAR} SELECT vec_id, round(avg(label), 4) AS prediction FROM r WHERE rank <= 5 GROUP BY 1")
def nearest_mean(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return rounded(neighbours.nearest_mean(e.filter("vec_id % 20 = 0"), e.filter("vec_id % 20 <> 0"), "vec_id", "embedding", "label"))


def _spots(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 5.0).alias("y"))


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, s_nationkey / 5.0::DOUBLE AS y FROM supplier), e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k <> b.k AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.25),
c AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 4), l AS (SELECT e.a, e.b FROM e JOIN c ON c.a = e.a JOIN c d ON d.a = e.b), r AS (SELECT a AS k, a AS c FROM c UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.k),
g AS (SELECT k, min(c) AS c FROM r GROUP BY k), n AS (SELECT e.a AS k, min(g.c) AS c FROM e JOIN g ON g.k = e.b GROUP BY 1) SELECT p.k AS s_suppkey, coalesce(g.c, n.c) AS cluster FROM p LEFT JOIN g ON g.k = p.k LEFT JOIN n ON n.k = p.k""")
def density_clusters(spark, sf_dir):
    return neighbours.dbscan(_spots(spark, sf_dir), "s_suppkey", ["x", "y"], 0.5, 5)


_PLACES = "(SELECT o_orderkey, o_orderkey % 3 AS g, (o_orderkey % 3) * 10 + (o_orderkey % 97) / 97.0::DOUBLE AS x, (o_orderkey % 3) * -10 + (o_orderkey % 89) / 89.0::DOUBLE AS y FROM orders)"


def _groups(spark, sf_dir):
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").select(k, ((k % 3) * 10 + k % 97 / 97.0).alias("x"), ((k % 3) * -10 + k % 89 / 89.0).alias("y"))


_FIRST = f"WITH f AS (SELECT g, min(o_orderkey) AS cluster FROM {_PLACES} GROUP BY g) SELECT o_orderkey, f.cluster FROM {_PLACES} JOIN f USING (g)"


def _named(rows):
    """Clusters by their smallest key, as numbers have no meaning of their own."""
    first = rows.groupBy(F.col("cluster").alias("_k")).agg(F.min("o_orderkey").alias("_first"))
    return rows.join(F.broadcast(first), F.col("cluster") == F.col("_k")).select("o_orderkey", F.col("_first").alias("cluster"))


@query(_FIRST)
def mean_shift_clusters(spark, sf_dir):
    return _named(models.mean_shift(_groups(spark, sf_dir), "o_orderkey", ["x", "y"], 4.0))


@query(_FIRST)
def kmeans_clusters(spark, sf_dir):
    """The best of several starts on three groups far apart."""
    df = models.assemble(_groups(spark, sf_dir), ["x", "y"]).select("o_orderkey", "features").persist()
    out = _named(models.best_kmeans(df).transform(df).select("o_orderkey", F.col("prediction").alias("cluster")))
    return out


@query(_FIRST)
def bisecting_clusters(spark, sf_dir):
    df = models.assemble(_groups(spark, sf_dir), ["x", "y"]).select("o_orderkey", "features")
    return _named(models.clusterers(3)["Bisecting"].fit(df).transform(df).select("o_orderkey", F.col("prediction").alias("cluster")))


@query(f"""WITH o AS (SELECT DISTINCT o_orderkey, o_totalprice, CAST(o_totalprice > 150000 AS INT) AS y FROM orders), r AS (SELECT * FROM o WHERE {fraction('o_orderkey')} >= 0.2), m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM r)
SELECT o_orderkey, round((o_totalprice - m) / s, 4) + 0 AS o_totalprice, y FROM o, m WHERE {fraction('o_orderkey')} < 0.2""")
def fit_and_transform(spark, sf_dir):
    """Duplicates dropped, split by key, scaled by train rows; the held-out rows."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") > 150000).cast("int").alias("y"))
    _, held = clean.Preprocessor().fit_transform(o.unionByName(o.filter("o_orderkey % 5 = 0")), "o_orderkey", "y")
    return held.select("o_orderkey", (F.round("o_totalprice", 4) + 0).alias("o_totalprice"), "y")
