"""Operators on small literal tables: the reference values of each, and null, empty and constant cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import ranks, stats
from millrace.operators import allpairs, clean, encode, features, metrics, models, monitor, neighbours, profile, schema
from millrace.sources import tables
from millrace.streaming import events as streams


def col(df, column, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(0, 1.0, 10.0, "A", 0), (1, 2.0, 20.0, "B", 1), (2, None, 30.0, "A", 0), (3, 4.0, 40.0, None, 1), (4, 100.0, 50.0, "B", 0)]
    return spark.createDataFrame(rows, "row_id long, num1 double, num2 double, cat string, target int")


def test_tail_probabilities():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert stats.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert stats.ks_tail(1.3580986 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-5)
    assert stats.chi2_tail(0, 3) == 1 and stats.f_tail(0, 1, 5) == 1


def test_missing_and_cleaning(spark, mixed):
    assert {r["column"]: r["missing_count"] for r in profile.missing_counts(mixed).collect()} == {"num1": 1, "cat": 1, "row_id": 0, "num2": 0, "target": 0}
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert col(profile.missing_counts(nan), "missing_count") == [1]
    fill = clean.fit_imputer(mixed)
    assert fill["num1"] == 3.0 and fill["cat"] == "A"
    filled = clean.impute(mixed, fill)
    assert col(filled, "num1", row_id=2) == [3.0] and col(filled, "cat", row_id=3) == ["A"]
    assert {r["column"]: (r["missing_before"], r["missing_after"]) for r in clean.cleaning_report(mixed, filled).collect()}["num1"] == (1, 0)
    none = spark.createDataFrame([(None, None)], "x double, s string")
    assert clean.fit_imputer(none) == {"x": 0.0, "s": "missing"}


def test_outliers(spark):
    v = lambda xs: spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "k long, val double")
    assert col(profile.iqr_outliers(v([1.0, 2, 2, 3, 2, 1, 2, 100]), "k", "val"), "value") == [100.0]
    assert col(profile.mad_outliers(v([10.0, 10, 11, 10, 10, 11, 1000]), "k", "val"), "value") == [1000.0]
    for xs in ([], [5.0], [5.0, 5.0, 5.0]):
        assert profile.mad_outliers(v(xs), "k", "val").count() == 0 and profile.iqr_outliers(v(xs), "k", "val").count() == 0


def test_dedupe_keeps_the_most_complete(spark):
    df = spark.createDataFrame([(1, None), (1, "complete"), (2, "x")], "k int, v string")
    assert sorted(map(tuple, clean.drop_duplicates(df, ["k"]).collect())) == [(1, "complete"), (2, "x")]
    assert clean.drop_duplicates(df.unionAll(df)).count() == 3


def test_quality_check(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, "z"), (4.0, "x")], "a double, b string")
    r = profile.quality_check(df).collect()[0]
    assert (r["n_rows"], r["n_cols"], r["duplicate_rows"], r["is_empty"], r["nulls"]) == (4, 2, 0, False, "a:1")
    assert profile.quality_check(df.limit(0)).collect()[0]["is_empty"]


def test_preprocessor_learns_from_train_rows_only(mixed):
    train = mixed.filter("row_id < 4")
    p = clean.Preprocessor().fit(train, ["num1", "num2"])
    assert p.medians == {"num1": 2.0, "num2": 25.0}
    out = p.transform(mixed)
    assert col(out, "num2", row_id=4)[0] == pytest.approx((50 - 25) / math.sqrt(125))
    constant = clean.Scaler().fit(mixed.withColumn("c", F.lit(3.0)), ["c"])
    assert constant.spread["c"] == 1.0


def test_encoders(spark):
    rows = [(i, c, y) for i, (c, y) in enumerate([("NY", 1), ("NY", 1), ("LA", 0), ("LA", 0), ("CHI", 1), ("CHI", 0)] * 10)]
    df = spark.createDataFrame(rows, "row_id long, city string, target int")
    oof = encode.target_encode_oof(df, "row_id", "city", "target", folds=3)
    assert oof.filter("encoded IS NULL").count() == 0
    table, overall = encode.target_map(df, "city", "target")
    test = encode.target_encode_apply(spark.createDataFrame([("NY",), ("Unknown",), (None,)], "city string"), "city", table, overall)
    got = {r["city"]: r["encoded"] for r in test.collect()}
    assert got["Unknown"] == overall == got[None] and got["NY"] == pytest.approx((20 + 10 * 0.5) / 30)
    freq = spark.createDataFrame([("A",), ("A",), ("A",), ("B",)], "cat string")
    assert {r["category"]: r["frequency"] for r in encode.frequency_map(freq, "cat").collect()} == {"A": 0.75, "B": 0.25}
    hot = encode.one_hot_apply(spark.createDataFrame([("A", 1), ("Z", 2), (None, 3)], "cat string, num int"), {"cat": ["A", "B"]})
    assert hot.columns == ["num", "cat_A", "cat_B"] and sorted(map(tuple, hot.collect())) == [(1, 1, 0), (2, 0, 0), (3, 0, 0)]
    with pytest.raises(ValueError):
        encode.one_hot_categories(df, ["city"], most=2)


def test_features(spark, mixed):
    made = features.interactions(mixed, columns=["num1", "num2"])
    assert col(made, "num1 num2", row_id=1) == [40.0]
    assert "x_log" in features.log_features(spark.createDataFrame([(float(2**i),) for i in range(10)], "x double")).columns
    assert "num1_log" not in features.log_features(mixed, columns=["num1"]).columns  # it has a null
    df = spark.createDataFrame([(float(i), float(i % 2), 1.0, i % 2) for i in range(20)], "a double, b double, c double, y int")
    assert features.select_top_k(df.withColumn("b", F.col("b") + F.col("a") / 100), ["a", "b"], "y", 1) == ["b"]
    assert {r["feature"]: r["keep"] for r in features.variance_filter(df, ["a", "c"]).collect()} == {"a": True, "c": False}


def test_metrics(spark):
    pairs = spark.createDataFrame(list(zip([1, 1, 0, 0, 1, 0], [1, 0, 0, 0, 1, 1], strict=True)), "y int, p int")
    m = metrics.binary_metrics(pairs, "y", "p").collect()[0]
    assert m["accuracy"] == pytest.approx(4 / 6) and m["precision"] == m["recall"] == pytest.approx(2 / 3)
    ones = spark.createDataFrame([(1, 1)] * 4, "y int, p int")
    assert all(metrics.binary_metrics(ones, "y", "p").collect()[0][k] == 1 for k in ("accuracy", "precision", "recall", "f1"))
    assert metrics.weighted_metrics(pairs, "y", "p").collect()[0]["accuracy"] == pytest.approx(4 / 6)
    reg = spark.createDataFrame([(10.0, 12.0), (20.0, 19.0), (30.0, 28.0)], "y double, p double")
    assert metrics.regression_metrics(reg, "y", "p").collect()[0]["mae"] == pytest.approx(5 / 3)
    auc = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert metrics.roc_auc(auc, "y", "s").collect()[0][0] == pytest.approx(0.75)
    assert metrics.pr_auc(auc, "y", "s").collect()[0][0] == pytest.approx(0.8333333)
    assert metrics.roc_auc(ones.withColumn("s", F.lit(0.5)), "y", "s").collect()[0][0] is None
    blobs = spark.createDataFrame([([0.0, 0.0], 0), ([0.1, 0.1], 0), ([5.0, 5.0], 1), ([5.1, 5.1], 1)], "v array<double>, c int").withColumn("k", F.monotonically_increasing_id())
    assert metrics.silhouette(blobs, "k", "v", "c").collect()[0][0] > 0.8 and metrics.silhouette_squared(blobs, "v", "c").collect()[0][0] > 0.8
    assert metrics.cluster_metrics(blobs, "v", "c").collect()[0]["davies_bouldin"] < 0.5
    one = metrics.cluster_metrics(blobs.filter("c = 0"), "v", "c").collect()[0]
    assert one["davies_bouldin"] == float("inf") and metrics.silhouette_squared(blobs.filter("c = 0"), "v", "c").collect()[0][0] == 0
    rows = spark.createDataFrame([("a", "classification", 0, "accuracy", 0.9), ("a", "classification", 1, "f1", 0.8), ("b", "regression", 0, "mae", 2.0), ("b", "regression", 1, "rmse", 3.0)], "run string, task string, place int, metric string, value double")
    assert {r["run"]: (r["metric"], r["direction"]) for r in metrics.primary_metric(rows).collect()} == {"a": ("f1", "maximize"), "b": ("rmse", "minimize")}
    assert {r["metric"]: r["passed"] for r in metrics.threshold_check(rows).collect()} == {"accuracy": True, "f1": True, "mae": False, "rmse": False}


def test_leakage_and_drift(spark):
    train = spark.createDataFrame([(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)], "f1 double, f2 double")
    assert monitor.row_overlap(train, spark.createDataFrame([(1.0, 4.0), (8.0, 10.0)], "f1 double, f2 double"), ["f1", "f2"]).collect()[0][0] == 1
    leaked = spark.createDataFrame([(float(i * i % 7), float(i % 2), i % 2) for i in range(6)], "normal double, leak double, y int")
    report = monitor.leakage_report(leaked, leaked.limit(0), ["normal", "leak"], "y", fit_before_split=True).collect()
    assert {r["check"] for r in report} >= {"fit_before_split", "target_copy"} and all(r["report_severity"] == "HIGH" and not r["passed"] for r in report)
    a = spark.range(500).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    same = monitor.drift_report(a, a).collect()
    assert not any(r["drifted"] for r in same) and same[0]["severity"] == "NONE"
    moved = monitor.drift_report(a, a.withColumn("x", F.col("x") + 30)).collect()
    assert {r["feature"]: r["drifted"] for r in moved} == {"x": True, "c": False} and moved[0]["severity"] == "HIGH" and moved[0]["drift_detected"]


def test_risk_and_failures(spark):
    levels = spark.createDataFrame([(s,) for s in (0, 39, 40, 69, 70, 100)], "s int").withColumns(monitor.risk_level(F.col("s")))
    assert [r["risk_level"] for r in levels.orderBy("s").collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]
    rows = [(0.45, "maximize", 50, 0.9, 0.2, 5.0, "classification"), (0.99, "maximize", 5000, None, None, None, "classification"), (0.45, "maximize", None, None, None, None, "classification")]
    got = monitor.risk_score(spark.createDataFrame(rows, "value double, direction string, row_count long, train_score double, cv_std double, minority_pct double, task string")).collect()
    assert [r["risk_score"] for r in got] == [100, 0, 35]
    runs = spark.createDataFrame([(0.5, 0.48, 0.5, None, None, 0.1, False, "classification"), (0.9, 0.5, 0.9, 0.01, 0.91, 0.5, True, "classification"), (0.7, 0.2, 0.7, 0.01, 0.95, None, None, "regression")],
                                 "best_score double, low_score double, high_score double, cv_std double, train_score double, minority double, leaked boolean, task string")
    assert [r["action"] for r in monitor.failure_categories(runs).collect()] == ["retry_with_resampling", "flag_and_stop", "retry_with_different_model"]


def test_text_and_schema(spark):
    df = spark.createDataFrame([("Predict customer churn",), ("forecast SALES revenue",), ("segment users into groups",), (None,)], "text string")
    assert [r["task_type"] for r in monitor.task_from_text(df, "text").collect()] == ["classification", "regression", "clustering", "classification"]
    assert schema.resolve_target(["a", "Churn", "b"], "churn") == ("Churn", "explicit", 0.98)
    assert schema.resolve_target(["a", "Label", "b"]) == ("Label", "common_name", 0.90)
    assert schema.resolve_target(["a", "b"]) == ("b", "last_column", 0.60) and schema.resolve_target([]) == (None, "none", 0.0)
    with pytest.raises(ValueError):
        schema.require_columns(df, ["other"])
    assert schema.align_columns(df, ["x", "text"]).columns == ["x", "text"]


def test_sources(spark, tmp_path, mixed):
    for kind, write in (("parquet", lambda p: mixed.write.parquet(p)), ("csv", lambda p: mixed.write.option("header", True).csv(p))):
        path = str(tmp_path / f"t.{kind}")
        write(path)
        assert tables.load(spark, path).count() == 5
    (tmp_path / "t.json").write_text('[{"a": 1}, {"a": 2}]')
    assert tables.load(spark, str(tmp_path / "t.json")).count() == 2
    assert tables.fingerprint(mixed).collect() == tables.fingerprint(mixed.repartition(4)).collect()
    assert tables.fingerprint(mixed).collect() != tables.fingerprint(mixed.limit(4)).collect()
    for task in ("classification", "regression", "clustering"):
        df = tables.generate(spark, task, 50, 6)
        assert df.count() == 50 and [c for c in df.columns if c.startswith("feature_")] == [f"feature_{i}" for i in range(6)]
    items = spark.createDataFrame([("a",), ("b",), ("bad",)], "key string")
    done = spark.createDataFrame([("a",)], "key string")

    def fetch(item):
        if item["key"] == "bad":
            raise ValueError("no")
        return {"size": len(item["key"])}

    got = {r["key"]: (r["size"], r["_error"]) for r in tables.collect_new(items, done, fetch, "key", "key string, size double").collect()}
    assert got["b"][0] == 1 and got["bad"][1] == "ValueError: no" and "a" not in got


def test_fingerprints_tell_cells_apart(spark):
    one, two = (spark.createDataFrame([r], "a string, b string") for r in (("x|=y", "z"), ("x", "y|=z")))
    assert tables.fingerprint(one).collect() != tables.fingerprint(two).collect()
    none = spark.createDataFrame([(None, "~")], "a string, b string")
    assert tables.fingerprint(none).collect() != tables.fingerprint(spark.createDataFrame([("~", None)], "a string, b string")).collect()


def test_generated_tables_do_not_depend_on_the_partitioning(spark):
    keys = spark.range(100).withColumnRenamed("id", "row_id")
    for task in ("classification", "regression", "clustering"):
        one, two = (sorted(map(tuple, tables.generate_for(d, "row_id", task).collect())) for d in (keys, keys.repartition(7)))
        assert one == two


def test_file_audit_and_lineage(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "three")):
        (tmp_path / name).write_text(text)
    digest = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.txt", "b.txt")}
    rows = [(f"file:{tmp_path}/a.txt", digest["a.txt"]), (f"file:{tmp_path}/b.txt", digest["a.txt"]), (f"file:{tmp_path}/d.txt", digest["b.txt"])]
    got = {r["path"].rpartition("/")[2]: r["status"] for r in tables.audit_files(spark, str(tmp_path), spark.createDataFrame(rows, "path string, sha256 string")).collect()}
    assert got == {"a.txt": "ok", "b.txt": "mismatch", "c.txt": "unlisted", "d.txt": "missing"}
    row = tables.lineage(spark, "clean", "impute", {"raw": "1"}, {"out": "2"}).collect()[0]
    assert (row["stage"], row["inputs"], row["outputs"]) == ("clean", {"raw": "1"}, {"out": "2"}) and row["at"] is not None


def test_exact_quantiles_by_cells(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, float(rng.randint(0, 50)), rng.gauss(0, 100)])) for c in "abc" for _ in range(rng.randint(300, 900))] + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    df, points = spark.createDataFrame(rows, "column string, value double"), [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    small = {r["column"]: r["q"] for r in ranks.exact_quantiles(df, points).collect()}
    monkeypatch.setattr(ranks, "SMALL_ROWS", 0)
    monkeypatch.setattr(ranks, "CELL_ROWS", 100)
    large = {r["column"]: r["q"] for r in ranks.exact_quantiles(df, points).collect()}
    assert small.keys() == large.keys() == {"a", "b", "c", "one", "same"}
    for c in small:
        assert large[c] == pytest.approx(small[c], rel=1e-12), c


def test_prefix_sums_by_cells(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CELL_ROWS", 10)
    rows = [(g, float(v), v % 7) for g in ("a", "b", None) for v in range(0, 300, 2)]
    got = ranks.prefix_sums(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", ["n"]).collect()
    assert len(got) == len(rows) and all(r["before_n"] == sum(n for g, v, n in rows if g == r["g"] and v < r["v"]) for r in got)


def test_silhouette_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(c * 3, 1), rng.gauss(0, 1)], c) for i, c in enumerate(rng.choices([0, 1, 2], k=60))] + [(99, [50.0, 50.0], 7)]
    means = []
    for k, v, c in rows:
        by = {}
        for k2, v2, c2 in rows:
            if k != k2:
                by.setdefault(c2, []).append(math.dist(v, v2))
        by = {x: sum(d) / len(d) for x, d in by.items()}
        a, b = by.get(c), min(d for x, d in by.items() if x != c)
        means.append(0 if a is None else (b - a) / max(a, b))
    df = spark.createDataFrame(rows, "k long, v array<double>, c long")
    assert metrics.silhouette(df, "k", "v", "c").collect()[0][0] == pytest.approx(sum(means) / len(means))


def test_cross_validation_fits_once_a_fold(spark, monkeypatch):
    rows = [(float(i), float(i % 40 > 19), i // 4 % 3) for i in range(120)]
    df = models.assemble(spark.createDataFrame(rows, "x double, y double, fold int"), ["x"], "y")
    fits, tree = [], models.classifiers(120)["DecisionTree"]
    fit = type(tree).fit
    monkeypatch.setattr(type(tree), "fit", lambda self, data, *args: fits.append(data.count()) or fit(self, data, *args))
    got = models.cross_validate(df, zoo={"tree": tree}, k=3).collect()[0]
    assert sorted(fits) == [80, 80, 80] and got["mean"] > 0.8 and got["error"] is None and got["best"]
    wrong = models.cross_validate(df.withColumn("fold", F.col("fold") + 1), zoo={"tree": tree}, k=3).collect()[0]
    assert wrong["mean"] == 0 and "fold" in wrong["error"] and not wrong["best"] and len(fits) == 3


def test_silhouette_copies_no_points(spark, monkeypatch):
    """Over many blocks and tiles: clusters that go on in the next block, single points, copies, a point without a cluster."""
    monkeypatch.setattr(allpairs, "FEW", 300)
    rng = np.random.default_rng(4)
    c = np.sort(np.array(["a", "long name", "z", "ü"])[rng.integers(0, 4, 2600)].tolist() + ["s1", "s2"])
    x = rng.normal(size=(len(c), 5)) + (c == "a")[:, None] * 2.0 + 1000
    x[:40] = x[0]
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    means = {w: away[:, c == w].sum(1) for w in set(c)}
    worth = 0.0
    for i, w in enumerate(c):
        n = (c == w).sum()
        b = min(means[o][i] / (c == o).sum() for o in means if o != w)
        worth += (b - means[w][i] / (n - 1)) / max(b, means[w][i] / (n - 1)) if n > 1 else 0.0
    rows = [(i, v.tolist(), w) for i, (v, w) in enumerate(zip(x, c.tolist(), strict=True))] + [(-1, x[0].tolist(), None), (-2, None, "a")]
    df = spark.createDataFrame(rows, "k long, v array<double>, c string").repartition(4)
    found = metrics.silhouette(df, "k", "v", "c")
    assert "CoGroups" not in found._jdf.queryExecution().toString()
    assert found.collect()[0][0] == pytest.approx(worth / (len(c) + 1), abs=1e-9)
    assert abs(metrics.silhouette(df, "k", "v", "c", sample=400).collect()[0][0] - worth / len(c)) < 0.05
    assert metrics.silhouette(df.filter("c = 'a'"), "k", "v", "c").collect()[0][0] == 0 == metrics.silhouette(df.limit(0), "k", "v", "c").collect()[0][0]


def test_neighbours_vote_and_ties(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(0, 4)), float(rng.randint(0, 4))], i % 3) for i in range(200)] + [(500, None, 1)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y long")
    got = {}
    for r in neighbours.nearest(df.filter("k % 20 = 0"), df, "k", "v", 7, block=4).collect():
        got.setdefault(r["k"], []).append((r["distance"], r["near_key"]))
    known = [r for r in rows if r[1] is not None]
    near = {q: sorted((math.dist(v, w), p) for p, w, _ in known if p != q)[:7] for q, v, _ in known if q % 20 == 0}
    assert {q: sorted(x) for q, x in got.items()} == near
    label = {k: y for k, _, y in rows}
    for q, p in ((r["k"], r["prediction"]) for r in neighbours.nearest_vote(df.filter("k % 20 = 0"), df, "k", "v", "y", 7).collect()):
        votes = [label[n] for _, n in near[q]]
        assert p == min(set(votes), key=lambda y: (-votes.count(y), y))
    for q, p in ((r["k"], r["prediction"]) for r in neighbours.nearest_mean(df.filter("k % 20 = 0"), df, "k", "v", "y", 7).collect()):
        assert p == pytest.approx(sum(label[n] for _, n in near[q]) / 7)


def test_mean_shift(spark):
    rng = random.Random(7)
    rows = [(i, rng.gauss(c * 10, 0.5), rng.gauss(-c * 10, 0.5)) for i, c in enumerate([0] * 80 + [1] * 50 + [2] * 30)] + [(900, None, 1.0)]
    got = {r["k"]: r["cluster"] for r in models.mean_shift(spark.createDataFrame(rows, "k long, x double, y double"), "k", ["x", "y"], 4.0).collect()}
    assert [{got[i] for i in at} for at in (range(80), range(80, 130), range(130, 160))] == [{0}, {1}, {2}] and 900 not in got


def test_cross_validation_reports_failures(spark):
    df = models.folds(models.assemble(spark.range(60).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 2 * 5.0).alias("x")), ["x"], "y"), "id", 3)
    zoo = {"tree": models.classifiers(60)["DecisionTree"], "broken": models.classifiers(60)["DecisionTree"].copy({}).setMaxBins(1)}
    got = {r["model"]: r for r in models.cross_validate(df, zoo=zoo, k=3).collect()}
    assert got["tree"]["mean"] == 1.0 and got["tree"]["best"] and got["tree"]["error"] is None
    assert got["broken"]["mean"] == 0.0 and got["broken"]["error"] and not got["broken"]["best"]
    assert models.cross_validate(df, zoo={"broken": zoo["broken"]}, k=3).collect()[0]["best"] is False


def test_predictions_check_the_contract(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), 3.0 * i + 1) for i in range(30)], "k long, x double, y double")
    model = models.feature_pipeline(["x"], "y", models.regressors(30)["LinearRegression"]).fit(df)
    path = str(tmp_path / "model")
    models.save_model(model, path, df, ["x"], "y", {"r2": 1.0})
    assert models.predict(df, path).filter("abs(prediction - y) > 1e-3").count() == 0
    for wrong in (df.drop("x"), df.withColumn("x", F.col("x").cast("string"))):
        with pytest.raises(ValueError, match="x"):
            models.predict(wrong, path)
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = models.predict(live, path).writeStream.format("memory").queryName("predicted").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("predicted").count() == 30


def test_streams_forget_and_resume(spark, tmp_path):
    rows = [(f"e{i % 40}", f"2024-01-01 00:{i % 60:02d}:00", float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id string, at string, value double").select("event_id", F.to_timestamp("at").alias("ts"), "value")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.dedupe(live, late="2 hours").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["event_id"] for r in spark.table("once").collect()) == sorted({r[0] for r in rows}) and streams.dedupe(df).count() == 40
    for _ in range(2):  # a second run finds nothing new
        live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        streams.collect_stream(live, str(tmp_path / "out"), str(tmp_path / "state"), "event_id").processAllAvailable()
        for q in spark.streams.active:
            q.stop()
    again = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.collect_stream(again, str(tmp_path / "out"), str(tmp_path / "other"), "event_id").processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_drift_monitor_hands_over_closed_windows(spark, tmp_path):
    reference = spark.range(1000).select((F.col("id") % 100).cast("double").alias("value"))
    late = spark.range(200).select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int), 0)").alias("ts"), (F.col("id") % 100 + F.when(F.col("id") >= 60, 90).otherwise(0)).cast("double").alias("value"))
    late.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("2024-01-02 00:00:00", 1.0)], "ts string, value double").select(F.to_timestamp("ts").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {}
    query = streams.monitor_drift(live, reference, "value", lambda d: found.update({r["start"].hour: r["statistic"] for r in d.collect()}), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    batch = {r["start"].hour: r["statistic"] for r in streams.window_drift(streams.windowed_counts(late, "value", streams.decile_edges(reference, "value")), shares(reference)).collect()}
    assert {h: found[h] for h in (0, 1, 2)} == pytest.approx({h: batch[h] for h in (0, 1, 2)}) and found[1] > 0.8 > found[0]


def shares(reference):
    edges = streams.decile_edges(reference, "value")
    at = sum((F.when(F.col("value") > x, 1).otherwise(0) for x in edges), F.lit(0)).alias("bin")
    return reference.groupBy(at).agg((F.count(F.lit(1)) / F.lit(1000)).alias("share"))


def test_fit_and_transform_learns_from_train_rows(spark):
    df = spark.range(300).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") % 2).alias("y"))
    train, test = clean.Preprocessor().fit_transform(df.unionByName(df), "id", "y")
    assert train.count() + test.count() == 300
    mean, sd = train.agg(F.avg("x"), F.stddev_pop("x")).collect()[0]
    assert mean == pytest.approx(0, abs=1e-9) and sd == pytest.approx(1)


def test_splits_and_neighbours(spark):
    df = spark.range(2000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    train, test = models.train_test_split(df, "id")
    assert train.count() + test.count() == 2000 and 330 < test.count() < 470
    assert {r["id"] for r in test.collect()} == {r["id"] for r in models.train_test_split(df.repartition(17), "id")[1].collect()}
    counts = models.stratified_folds(df, "id", "y", parts=4).filter("y = 1").groupBy("fold").count().collect()
    assert len(counts) == 5 and max(r["count"] for r in counts) - min(r["count"] for r in counts) <= 4
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "k long, v array<double>")
    near = neighbours.nearest(points.filter("k = 10"), points, "k", "v", 2).orderBy("rank").collect()
    assert [(r["near_key"], r["distance"]) for r in near] == [(9, 1.0), (11, 1.0)]


def test_dbscan(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(i, 0.1 * i, 0.0) for i in range(10)] + [(100 + i, 10 + 0.1 * i, 5.0) for i in range(10)] + [(500, 50.0, 50.0)]
    got = {r["k"]: r["cluster"] for r in neighbours.dbscan(spark.createDataFrame(rows, "k long, x double, y double"), "k", ["x", "y"], 0.25, 3).collect()}
    assert got[500] is None and {got[i] for i in range(10)} == {got[0]} and {got[100 + i] for i in range(10)} == {got[100]} and got[0] != got[100]


def test_events(spark, tmp_path):
    rows = [("a", 1), ("a", 1), ("a", 2), ("a", 5), ("b", 1)]
    df = spark.createDataFrame(rows, "run string, n long")
    assert sorted((r["run"], r["number"], r["fault"]) for r in streams.sequence_faults(df, "run", "n").collect()) == [("a", 1, "repeat"), ("a", 5, "gap")]
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streams.sequence_faults_stream(live, "run", "n").writeStream.format("memory").queryName("faults").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["run"], r["number"], r["fault"]) for r in spark.table("faults").collect()) == [("a", 1, "repeat"), ("a", 5, "gap")]
