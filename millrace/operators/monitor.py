"""Leakage, drift, prediction checks, and rules over evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from ..functions import stats
from ..functions.ranks import prefix_sums

#: Fixed values of the task keywords.
CLASSIFICATION_WORDS = ["churn", "classify", "classification", "spam", "fraud", "detect", "detection", "cancer", "default", "approve", "approval", "predict probability", "binary", "multi-class", "sentiment", "diagnostic", "risk score"]
REGRESSION_WORDS = ["price", "pricing", "predict sales", "forecast", "regression", "revenue", "sales", "demand", "estimate", "quantity", "cost", "temperature", "stock", "time series", "continuous"]
CLUSTERING_WORDS = ["cluster", "clustering", "segment", "segmentation", "group", "grouping", "unsupervised", "anomaly", "outlier detection"]


def task_from_text(df: DataFrame, text: str) -> DataFrame:
    """Adds task_type, confidence and method by keyword hits in the text."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in {"c": CLASSIFICATION_WORDS, "r": REGRESSION_WORDS, "g": CLUSTERING_WORDS}.items()}
    out = df.withColumns({f"_{k}": h for k, h in hits.items()})
    c, r, g = (F.col(f"_{k}") for k in "crg")
    task = F.when(g > 0, "clustering").when(r > c, "regression").otherwise("classification")
    sure = F.when(g > 0, 0.6 + g * 0.15).when(r > c, 0.6 + r * 0.1).when(c > 0, 0.6 + c * 0.1).otherwise(0.5)
    method = F.when((g > 0) | (r > c) | (c > 0), "keyword_match").otherwise("default_fallback")
    return out.select(*df.columns, task.alias("task_type"), F.round(F.least(F.lit(1.0), sure), 4).alias("confidence"), method.alias("method"))


def row_overlap(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """overlap: distinct rows that both have, compared by value."""
    return train.select(*columns).intersect(test.select(*columns)).agg(F.count(F.lit(1)).alias("overlap"))


def target_copies(train: DataFrame, features: list[str], target: str, most: int = 20) -> DataFrame:
    """feature and r where |r| with the target is above 0.99 (nulls as 0), for targets of up to ``most`` values."""
    y = F.col(target).cast("double")
    parts = [F.struct(F.lit(c).alias("feature"), F.corr(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), y).alias("r")) for c in features]
    out = train.agg(F.count_distinct(y).alias("_k"), F.array(*parts).alias("_p")).select("_k", F.explode("_p").alias("_p")).filter(F.col("_k") <= most).select("_p.*")
    return out.filter(~F.isnan("r") & (F.abs("r") > 0.99)).withColumn("r", F.round("r", 4))


def near_constant(train: DataFrame, columns: list[str], share: float = 0.99) -> DataFrame:
    """column, cardinality, top_share of the columns of one value, or whose top value has the share or more."""
    from .profile import value_counts

    by = value_counts(train, columns).groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"), F.round(F.max("n") / F.sum("n"), 4).alias("top_share"))
    return by.filter((F.col("cardinality") <= 1) | (F.col("top_share") >= share))


def leakage_report(train: DataFrame, test: DataFrame, features: list[str], target: str, fit_before_split: bool = False) -> DataFrame:
    """Findings (check, severity, column, value), and on every row the report's severity and whether it passed."""
    spark = train.sparkSession
    flag = spark.createDataFrame([("fit_before_split", "CRITICAL", None, 1.0)] if fit_before_split else [], "check string, severity string, column string, value double")
    none = F.lit(None).cast("string")
    overlap = row_overlap(train, test, features).filter("overlap > 0").select(F.lit("row_overlap").alias("check"), F.lit("WARNING").alias("severity"), none.alias("column"), F.col("overlap").cast("double").alias("value"))
    copies = target_copies(train, features, target).select(F.lit("target_copy").alias("check"), F.lit("HIGH RISK").alias("severity"), F.col("feature").alias("column"), F.col("r").alias("value"))
    constant = near_constant(train, features).select(F.lit("near_constant").alias("check"), F.lit("WARNING").alias("severity"), "column", F.col("top_share").alias("value"))
    found = flag.unionByName(overlap).unionByName(copies).unionByName(constant)
    worst = found.agg(F.max(F.when(F.col("severity") == "CRITICAL", 2).when(F.col("severity") == "HIGH RISK", 1).otherwise(0)).alias("_w"))
    level = F.when(F.col("_w") == 2, "HIGH").when(F.col("_w") == 1, "MEDIUM").otherwise("LOW")
    return found.crossJoin(F.broadcast(worst)).select(*found.columns, level.alias("report_severity"), (F.col("_w") < 2).alias("passed"))  # one row


def ks_statistics(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """column, n1, n2, statistic: the largest gap between the distributions, from counts by value and prefix sums."""
    one, two = (X.long_form(X.missing_free(d), columns).filter("value IS NOT NULL").withColumn("_s", F.lit(s)) for s, d in ((1, reference), (2, current)))
    counts = one.unionByName(two).groupBy("column", "value").agg(F.count_if(F.col("_s") == 1).alias("a"), F.count_if(F.col("_s") == 2).alias("b"))
    totals = counts.groupBy(F.col("column").alias("_c")).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    summed = prefix_sums(counts, ["column"], "value", ["a", "b"]).join(F.broadcast(totals), F.col("column") == F.col("_c"))
    gap = F.abs((F.col("before_a") + F.col("a")) / F.col("n1") - (F.col("before_b") + F.col("b")) / F.col("n2"))
    return summed.groupBy("column", "n1", "n2").agg(F.max(gap).alias("statistic"))


def chi2_statistics(reference: DataFrame, current: DataFrame, columns: list[str], mode: str = "counts") -> DataFrame:
    """column, n1, n2, df, statistic of current values against the reference's shares, over all categories of both.

    "counts" tests numbers of rows; "proportions" tests shares, as if there were one row. Empty shares count as 1e-10.
    """
    from .profile import value_counts

    one = value_counts(reference, columns).select(F.col("column").alias("c1"), F.col("value").alias("v1"), F.col("n").alias("a"))
    two = value_counts(current, columns).select(F.col("column").alias("c2"), F.col("value").alias("v2"), F.col("n").alias("b"))
    both = one.join(two, (F.col("c1") == F.col("c2")) & (F.col("v1") == F.col("v2")), "full_outer").select(F.coalesce("c1", "c2").alias("column"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    totals = both.groupBy(F.col("column").alias("_c")).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    both = both.join(F.broadcast(totals), F.col("column") == F.col("_c"))
    e, o = F.greatest(F.col("a") / F.col("n1"), F.lit(1e-10)), F.greatest(F.col("b") / F.col("n2"), F.lit(1e-10))
    scale = F.col("n2") if mode == "counts" else F.lit(1.0)
    return both.groupBy("column", "n1", "n2").agg((F.count(F.lit(1)) - 1).alias("df"), F.sum(scale * (o - e) * (o - e) / e).alias("statistic"))


def drift_report(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, alpha: float = 0.05, mode: str = "counts") -> DataFrame:
    """feature, test, statistic, p_value, drifted and, on every row, drift_fraction, severity, drift_detected.

    Numeric columns get a Kolmogorov-Smirnov test, others (booleans too) a chi-squared one. The fraction is of all
    reference columns, those that are missing now included.
    """
    columns = columns or [f.name for f in reference.schema if not isinstance(f.dataType, (T.TimestampType, T.DateType))]
    numbers = [c for c in X.numeric_columns(reference) if c in columns and c in current.columns]
    others = [c for c in columns if c in current.columns and c not in numbers]
    ks = F.udf(lambda s, n, m: float(stats.ks_tail(s, n, m)), "double")  # a row a column
    chi = F.udf(lambda s, d: float(stats.chi2_tail(s, d)) if d > 0 else 1.0, "double")
    parts = []
    if numbers:
        parts.append(ks_statistics(reference, current, numbers).select(F.col("column").alias("feature"), F.lit("KS").alias("test"), "statistic", ks("statistic", "n1", "n2").alias("p")))
    if others:
        parts.append(chi2_statistics(reference, current, others, mode).select(F.col("column").alias("feature"), F.lit("chi2").alias("test"), "statistic", chi("statistic", "df").alias("p")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = found.select("feature", "test", F.round("statistic", 4).alias("statistic"), F.round("p", 6).alias("p_value"), (F.col("p") < alpha).alias("drifted"))
    share = found.agg((F.count_if("drifted") / F.lit(max(1, len(columns)))).alias("drift_fraction"))
    f = F.col("drift_fraction")
    severity = F.when(f == 0, "NONE").when(f < 0.15, "LOW").when(f < 0.30, "MEDIUM").otherwise("HIGH")
    return found.crossJoin(F.broadcast(share)).withColumns({"severity": severity, "drift_detected": f >= 0.30})  # one row


def prediction_check(scored: DataFrame, expected_rows: int, prediction: str = "prediction", probability: str | None = None) -> DataFrame:
    """One row of counts over the whole table: rows, bad predictions, bad probabilities, bad sums; with status and reason."""
    p = F.col(prediction).cast("double")
    out = [F.count(F.lit(1)).alias("rows"), F.count_if(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))).alias("bad_predictions")]
    if probability is None:
        out += [F.lit(0).cast("long").alias("bad_probabilities"), F.lit(0).cast("long").alias("bad_sums")]
    else:
        q = F.col(probability)
        outside = F.exists(q, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
        out += [F.count_if(q.isNull() | outside).alias("bad_probabilities"), F.count_if(F.abs(F.aggregate(q, F.lit(0.0), lambda s, x: s + x) - 1) > 1e-3).alias("bad_sums")]
    reason = F.when(F.col("rows") != expected_rows, "row count").when(F.col("bad_predictions") > 0, "invalid predictions").when(F.col("bad_probabilities") > 0, "probabilities out of range").when(F.col("bad_sums") > 0, "probabilities do not sum to 1")
    return scored.agg(*out).withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "passed").otherwise("failed"))


def risk_score(runs: DataFrame) -> DataFrame:
    """Rows (metric value, direction, row_count, train_score, cv_std, minority_pct, task; all but value nullable) with
    risk_score 0-100, risk_level, decision and needs_review. A null factor adds nothing."""
    v, up = F.col("value"), F.col("direction") == "maximize"
    quality = F.when(up, F.when(v < 0.55, 35).when(v < 0.70, 20).when(v < 0.85, 8).otherwise(0)).otherwise(F.when(v > 1.5, 35).when(v > 0.8, 20).otherwise(0))
    n = F.col("row_count")
    size = F.when(n > 0, F.when(n < 100, 30).when(n < 500, 15).otherwise(0))
    gap = F.greatest(F.lit(0.0), F.col("train_score") - v)
    gap_risk = F.when(up & F.col("train_score").isNotNull(), F.when(gap > 0.20, 20).when(gap > 0.10, 10).otherwise(0))
    sd = F.col("cv_std")
    spread = F.when(sd > 0.12, 15).when(sd > 0.06, 8)
    m = F.col("minority_pct")
    imbalance = F.when(F.col("task") == "classification", F.when(m < 10, 20).when(m < 20, 10))
    score = F.least(F.lit(100), sum((F.coalesce(x, F.lit(0)) for x in (quality, size, gap_risk, spread, imbalance)), F.lit(0)))
    out = runs.withColumn("risk_score", score.cast("int"))
    return out.withColumns(risk_level(F.col("risk_score")))


def risk_level(score: Column) -> dict[str, Column]:
    at = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(score).cast("int")))
    return {"risk_level": F.when(at <= 39, "LOW").when(at <= 69, "MEDIUM").otherwise("HIGH"), "decision": F.when(at <= 39, "AUTO_APPROVE").otherwise("HUMAN_REQUIRED"), "needs_review": at > 39}


def failure_categories(runs: DataFrame) -> DataFrame:
    """Rows (best_score, low_score, high_score, cv_std, train_score, minority, leaked, task) with categories, action, retry."""
    best, minority = F.col("best_score"), F.col("minority")
    low = best < 0.55
    cases = {
        "data_leakage": F.col("leaked"), "class_imbalance": low & (minority < 0.20),
        "low_sample": low & (F.col("high_score") - F.col("low_score") < 0.05) & (best < 0.65), "high_variance": F.col("cv_std") > 0.08,
        "overfitting": F.col("train_score") - best > 0.15, "poor_recall": (F.col("task") == "classification") & (minority < 0.30) & (best < 0.60),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in cases.items()]))
    found = F.when(F.size(found) == 0, F.array(F.lit("low_performance"))).otherwise(found)
    out = runs.withColumn("categories", found)
    has = lambda *names: F.arrays_overlap("categories", F.array(*[F.lit(n) for n in names]))
    action = (F.when(has("data_leakage"), "flag_and_stop").when(has("class_imbalance", "poor_recall"), "retry_with_resampling").when(has("overfitting", "high_variance"), "retry_with_different_model")
              .when(has("low_sample"), "retry_preprocessing").otherwise("retry_with_different_model"))
    return out.withColumns({"action": action, "retry": ~has("data_leakage")})


def evaluation_audit(runs: DataFrame) -> DataFrame:
    """Findings (run, finding) over rows (run, task, train_score, val_score, majority, accuracy_only, on_train, tuned_on_test, scaler_fit_on)."""
    cls = F.col("task") == "classification"
    cases = {"evaluated_on_train": F.col("on_train"), "accuracy_only": cls & F.col("accuracy_only") & (F.col("majority") > 0.8), "threshold_on_test": cls & F.col("tuned_on_test"),
             "fit_on_all": F.col("scaler_fit_on") == "train+test", "overfitting": F.col("train_score") - F.col("val_score") > 0.15}
    return runs.select("run", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cases.items()]))).alias("finding"))


def passes(runs: DataFrame) -> DataFrame:
    """Adds passed: best score of 0.55 or more and no critical leakage."""
    return runs.withColumn("passed", (F.col("best_score") >= 0.55) & ~F.coalesce(F.col("leaked"), F.lit(False)))
