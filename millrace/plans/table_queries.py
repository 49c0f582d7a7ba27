"""Registered queries of sources, sinks, schema operators, reports and rules, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clean, encode, features, metrics, models, monitor, profile, schema
from ..sources import tables
from ..streaming import events as streams
from .queries import FINGERPRINT, HOLED, NUMBERS, bucket, fingerprint, holed, priced, query, rounded, runs, t


def _folder(spark, name: str) -> str:
    return f"{tables.scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def load_parquet(spark, sf_dir):
    return tables.load(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS c_name, c_acctbal, c_nationkey FROM customer")
def append_and_load_csv(spark, sf_dir):
    """Two appends of a table to CSV, read back with its types."""
    df = t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("c_name"), "c_acctbal", "c_nationkey")
    path = _folder(spark, "csv")
    tables.append_csv(df.filter("c_custkey % 2 = 0"), path)
    tables.append_csv(df.filter("c_custkey % 2 = 1"), path)
    return tables.load(spark, path, schema=df.schema)


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def save_and_load_json(spark, sf_dir):
    df = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    path = _folder(spark, "json")
    tables.save_report(df, path)
    return tables.load(spark, path, "json", schema=df.schema, lines=True)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def save_and_load_parquet(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return tables.load(spark, tables.save_parquet(df, _folder(spark, "runs"), "run", "cleaning", "lineitem.parquet"))


@query("""SELECT '{"c_custkey":' || c_custkey || CASE WHEN c_custkey % 3 <> 0 THEN ',"c_mktsegment":"' || c_mktsegment || '"' ELSE '' END || ',"c_nationkey":' || c_nationkey || '}' AS json FROM customer""")
def report_as_json(spark, sf_dir):
    df = t(spark, sf_dir, "customer")
    return tables.report_json(df.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey"))


@query("""SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events""")
def parsed_json(spark, sf_dir):
    return tables.parse_json(t(spark, sf_dir, "events"), "props", "k int").select("event_id", "k")


@query(f"SELECT 'validation' AS stage, 'split' AS operation, 'lineitem' AS input, substr(sha256(n || ':' || d), 1, 16) AS input_id, 'train' AS output FROM {FINGERPRINT}")
def lineage_row(spark, sf_dir):
    found = fingerprint(spark, sf_dir).collect()[0]["dataset_id"]
    row = tables.lineage(spark, "validation", "split", {"lineitem": found}, {"train": ""})
    return row.select("stage", "operation", F.map_keys("inputs")[0].alias("input"), F.map_values("inputs")[0].alias("input_id"), F.map_keys("outputs")[0].alias("output"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def skip_done(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey")
    return tables.skip_done(o, o.filter("o_orderkey % 3 = 0"), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey * 2 END AS twice, CASE WHEN o_orderkey % 7 = 0 THEN 'ValueError: ' || o_orderkey END AS _error FROM orders WHERE o_orderkey % 3 <> 0""")
def collect_new(spark, sf_dir):
    """Items that aren't done yet are fetched; one in seven fails and becomes an error row."""

    def fetch(item: dict) -> dict:
        if item["o_orderkey"] % 7 == 0:
            raise ValueError(item["o_orderkey"])
        return {"twice": item["o_orderkey"] * 2}

    o = t(spark, sf_dir, "orders").select("o_orderkey")
    return tables.collect_new(o, o.filter("o_orderkey % 3 = 0"), fetch, "o_orderkey", "o_orderkey long, twice long")


def _uniform(name: str, seed: int) -> str:
    return f"((CAST('0x' || substr(md5(CAST({name} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _normal(name: str, seed: int) -> str:
    return f"(sqrt(-2 * ln({_uniform(name, 2 * seed)})) * cos(2 * pi() * {_uniform(name, 2 * seed + 1)}))"


_FOUR = ", ".join(f"{_normal('o_orderkey', 42 + i)} AS f{i}" for i in range(4))
_FORM = "(f0 + f1 * 2 + f2 * 3 + f3)"
_MADE = "round(f0, 6) + 0 AS feature_0, round(f1, 6) + 0 AS feature_1, round(f2, 6) + 0 AS feature_2, round(f3, 6) + 0 AS feature_3, round(0.6 * f0 - 0.4 * f0, 6) + 0 AS feature_4, round(0.6 * f0 - 0.4 * f1, 6) + 0 AS feature_5"


def _made(spark, sf_dir, task):
    df = tables.generate_for(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", task)
    return df.select(*[(F.round(c, 6) + 0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(f"SELECT o_orderkey, {_MADE}, CAST({_FORM} > 0 AS INT) AS target FROM (SELECT o_orderkey, {_FOUR} FROM orders)")
def generated_classification(spark, sf_dir):
    return _made(spark, sf_dir, "classification")


@query(f"SELECT o_orderkey, {_MADE}, round({_FORM} + 0.1 * e, 6) + 0 AS target FROM (SELECT o_orderkey, {_FOUR}, {_normal('o_orderkey', 1042)} AS e FROM orders)")
def generated_regression(spark, sf_dir):
    return _made(spark, sf_dir, "regression")


@query("SELECT o_orderkey, " + ", ".join(f"round({_normal('o_orderkey', 42 + i)} + 20 * {_uniform('target', 5042 + i)} - 10, 6) + 0 AS feature_{i}" for i in range(6))
       + f", target FROM (SELECT o_orderkey, {bucket('o_orderkey', 3)} AS target FROM orders)")
def generated_clusters(spark, sf_dir):
    return _made(spark, sf_dir, "clustering")


# --- schemas


@query("""SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS dtype FROM (DESCRIBE SELECT * FROM lineitem)""")
def schema_columns(spark, sf_dir):
    df = schema.extract_schema(t(spark, sf_dir, "lineitem"))
    return df.withColumn("dtype", F.when(F.col("dtype").startswith("timestamp"), "timestamp_ntz").otherwise(F.col("dtype")))


@query("""SELECT column_name AS "column", CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'other' END AS kind FROM (DESCRIBE SELECT * FROM lineitem)""")
def column_kinds(spark, sf_dir):
    return profile.table_profile(t(spark, sf_dir, "lineitem")).select("column", "kind")


@query("""SELECT * FROM (VALUES ('embeddings', 'label', 'common_name', 0.9::DOUBLE), ('customer', 'c_name', 'explicit', 0.98::DOUBLE), ('orders', 'o_custkey', 'explicit', 1.0::DOUBLE), ('orders', 'o_orderpriority', 'last_column', 0.6::DOUBLE)) v(name, "column", method, confidence)""")
def resolved_targets(spark, sf_dir):
    asked = [("embeddings", None), ("customer", "C_NAME"), ("orders", "o_custkey"), ("orders", None)]
    parts = [schema.target_report(t(spark, sf_dir, name), wanted).filter("rank = 1").select("column", "method", "confidence", F.lit(name).alias("name")) for name, wanted in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT o_totalprice, o_orderkey FROM orders")
def contract_projection(spark, sf_dir):
    return schema.require_columns(schema.require_rows(t(spark, sf_dir, "orders")), ["o_totalprice", "o_orderkey"])


@query("""SELECT * FROM (VALUES ('l_orderkey', 'ok'), ('l_quantity', 'type'), ('l_colour', 'missing')) v("column", status)""")
def contract_findings(spark, sf_dir):
    return schema.contract_findings(t(spark, sf_dir, "lineitem"), {"l_orderkey": "bigint", "l_quantity": "string", "l_colour": "string"}).select("column", "status")


@query("SELECT c_acctbal, 0 AS c_age, c_custkey FROM customer")
def aligned_columns(spark, sf_dir):
    return schema.align_columns(t(spark, sf_dir, "customer"), ["c_acctbal", "c_age", "c_custkey"])


@query("SELECT p_partkey, p_brand, p_type, p_size FROM part")
def without_target(spark, sf_dir):
    return schema.drop_target(t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"), "p_retailprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def head_sample(spark, sf_dir):
    return schema.head_sample(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


# --- reports


_GONE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_before, 0 AS missing_after FROM {HOLED}" for c in ("l_orderkey", "l_quantity", "l_tax", "l_returnflag", "l_extendedprice"))


@query(_GONE)
def cleaning_report(spark, sf_dir):
    df = holed(spark, sf_dir)
    return clean.cleaning_report(df, clean.impute(df, clean.fit_imputer(df.drop("l_orderkey"))))


@query("""SELECT 'summary' AS report, 3 AS n UNION ALL SELECT 'numeric', 3 UNION ALL SELECT 'correlations', 3 UNION ALL
SELECT 'categorical', least(10, count(DISTINCT o_orderstatus)) + least(10, count(DISTINCT o_orderpriority)) FROM orders""")
def eda_reports(spark, sf_dir):
    """How many rows each report of an exploration has."""
    found = profile.eda_bundle(t(spark, sf_dir, "orders").drop("o_orderdate"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("report", F.lit(name)) for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""SELECT 'cat' AS "column", count(DISTINCT o_orderpriority) AS cardinality, 'low' AS bucket, CAST(count(DISTINCT o_orderpriority) AS INT) AS columns_after_encoding FROM orders WHERE o_orderkey % 13 <> 0""")
def encoding_report(spark, sf_dir):
    df = priced(spark, sf_dir)
    return encode.encoding_report(df, encode.one_hot_apply(df, encode.one_hot_categories(df, ["cat"])), ["cat"])


@query("""SELECT DISTINCT o_orderpriority AS category FROM orders WHERE o_orderkey % 2 = 1 EXCEPT SELECT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '2-HIGH'""")
def unseen_categories(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return encode.unseen_categories(o.filter("o_orderkey % 2 = 0 AND o_orderpriority <> '2-HIGH'"), o.filter("o_orderkey % 2 = 1"), "o_orderpriority")


_F = " UNION ALL ".join(f"""SELECT '{c}' AS feature, {i} AS place, (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*))) AS f
 FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS s FROM lineitem GROUP BY l_returnflag)""" for i, c in enumerate(NUMBERS))  # fmt: skip


@query(f"SELECT feature FROM ({_F}) ORDER BY f DESC, place LIMIT 2")
def top_features(spark, sf_dir):
    names = features.select_top_k(t(spark, sf_dir, "lineitem"), NUMBERS, "l_returnflag", k=2)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("""WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice END AS sparse, 1.5::DOUBLE AS flat, CAST(o_orderkey AS VARCHAR) AS code, o_orderpriority AS label FROM orders)
SELECT 'sparse' AS "column", 'missing' AS "check", 'warning' AS severity, round(count(*) FILTER (WHERE sparse IS NULL) * 100.0::DOUBLE / count(*), 2) AS value FROM d
UNION ALL SELECT 'flat', 'constant', 'warning', 1 UNION ALL SELECT 'id', 'id_name', 'warning', count(DISTINCT id) FROM d UNION ALL SELECT 'code', 'id_unique', 'warning', count(*) FROM d""")
def table_findings(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return profile.validate(o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice")).alias("sparse"), F.lit(1.5).alias("flat"), F.col("o_orderkey").cast("string").alias("code"), F.col("o_orderpriority").alias("label")), "label")


@query(f"""WITH r AS (SELECT o_orderkey, o_orderpriority, {bucket('o_orderkey', 256, 43)} AS part, md5(CAST(o_orderkey AS VARCHAR) || '|42') AS h FROM orders)
SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority, part ORDER BY h) + part) % 5 AS INT) AS fold FROM r""")
def stratified_folds(spark, sf_dir):
    return models.stratified_folds(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


# --- rules over runs


def _measures(spark, sf_dir):
    """Metric rows of runs: one part a run, five metrics each."""
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), F.element_at(F.array(F.lit("classification"), F.lit("regression"), F.lit("clustering"), F.lit("other")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("task"))
    names = ["mae", "rmse", "silhouette", "accuracy", "f1", "r2"]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), ((F.col("run") * (i + 3)) % 97 / 96.0).alias("value")) for i, m in enumerate(names)])
    return p.select("run", "task", F.explode(rows).alias("m")).select("run", "task", "m.*").filter((F.col("run") + F.col("place")) % 3 != 0)


_MEASURES = """(SELECT run, task, place, metric, (run * (place + 3)) % 97 / 96.0::DOUBLE AS value FROM (SELECT p_partkey AS run, ['classification', 'regression', 'clustering', 'other'][p_partkey % 4 + 1] AS task,
 unnest(['mae', 'rmse', 'silhouette', 'accuracy', 'f1', 'r2']) AS metric, unnest([0, 1, 2, 3, 4, 5]) AS place FROM part) WHERE (run + place) % 3 <> 0)"""


@query(f"""WITH r AS (SELECT *, CASE WHEN task = 'classification' THEN coalesce(list_position(['f1', 'accuracy', 'roc_auc', 'precision', 'recall'], metric), 99) WHEN task = 'clustering' THEN coalesce(list_position(['silhouette'], metric), 99)
 WHEN task = 'regression' THEN coalesce(list_position(['r2', 'rmse', 'mae', 'mse'], metric), 99) ELSE 99 END AS k FROM {_MEASURES})
SELECT run, metric, value, CASE WHEN metric IN ('mae', 'rmse') THEN 'minimize' ELSE 'maximize' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k, place) AS n FROM r) WHERE n = 1""")
def primary_metric(spark, sf_dir):
    return metrics.primary_metric(_measures(spark, sf_dir))


@query(f"""SELECT run, metric, value, threshold, CASE WHEN metric IN ('mae', 'rmse') THEN value <= threshold ELSE value >= threshold END AS passed
FROM (SELECT *, CASE metric WHEN 'mae' THEN 1.0::DOUBLE WHEN 'rmse' THEN 1.0::DOUBLE WHEN 'silhouette' THEN 0.3::DOUBLE WHEN 'accuracy' THEN 0.7::DOUBLE WHEN 'f1' THEN 0.65::DOUBLE WHEN 'r2' THEN 0.5::DOUBLE END AS threshold FROM {_MEASURES})""")
def threshold_check(spark, sf_dir):
    return metrics.threshold_check(_measures(spark, sf_dir)).select("run", "metric", "value", "threshold", "passed")


@query("""WITH p AS (SELECT CASE WHEN l_orderkey % 1000 = 1 THEN NULL WHEN l_orderkey % 1000 = 2 THEN 'nan'::DOUBLE ELSE l_quantity END AS p, l_discount AS q FROM lineitem)
SELECT count(*) AS rows, count(*) FILTER (WHERE p IS NULL OR NOT isfinite(p)) AS bad_predictions, 0 AS bad_probabilities, count(*) FILTER (WHERE q > 0.05) AS bad_sums,
 CASE WHEN count(*) FILTER (WHERE p IS NULL OR NOT isfinite(p)) > 0 THEN 'invalid predictions' WHEN count(*) FILTER (WHERE q > 0.05) > 0 THEN 'probabilities do not sum to 1' END AS reason,
 CASE WHEN count(*) FILTER (WHERE p IS NULL OR NOT isfinite(p)) > 0 OR count(*) FILTER (WHERE q > 0.05) > 0 THEN 'failed' ELSE 'passed' END AS status FROM p""")
def prediction_check(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    p = F.when(F.col("l_orderkey") % 1000 == 1, F.lit(None)).when(F.col("l_orderkey") % 1000 == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    q = F.array(F.col("l_discount"), 1 - F.col("l_discount") - F.when(F.col("l_discount") > 0.05, 0.01).otherwise(0.0))
    return monitor.prediction_check(df.select(p.alias("prediction"), q.alias("probability")), df.count(), probability="probability")


_AUDIT = """(SELECT p_partkey AS run, CASE WHEN p_partkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS task, (p_partkey % 89) / 88.0::DOUBLE AS train_score, (p_partkey % 101) / 100.0::DOUBLE AS val_score,
 (p_partkey % 11) / 10.0::DOUBLE AS majority, p_partkey % 3 = 0 AS accuracy_only, p_partkey % 13 = 0 AS on_train, p_partkey % 17 = 0 AS tuned_on_test, CASE WHEN p_partkey % 19 = 0 THEN 'train+test' ELSE 'train' END AS scaler_fit_on FROM part)"""


@query(f"""SELECT run, unnest(list_filter([CASE WHEN on_train THEN 'evaluated_on_train' END, CASE WHEN task = 'classification' AND accuracy_only AND majority > 0.8::DOUBLE THEN 'accuracy_only' END,
 CASE WHEN task = 'classification' AND tuned_on_test THEN 'threshold_on_test' END, CASE WHEN scaler_fit_on = 'train+test' THEN 'fit_on_all' END, CASE WHEN train_score - val_score > 0.15::DOUBLE THEN 'overfitting' END], lambda x: x IS NOT NULL)) AS finding FROM {_AUDIT}""")
def evaluation_audit(spark, sf_dir):
    k = F.col("p_partkey")
    df = t(spark, sf_dir, "part").select(
        k.alias("run"), F.when(k % 2 == 0, "classification").otherwise("regression").alias("task"), (k % 89 / 88.0).alias("train_score"), (k % 101 / 100.0).alias("val_score"), (k % 11 / 10.0).alias("majority"),
        (k % 3 == 0).alias("accuracy_only"), (k % 13 == 0).alias("on_train"), (k % 17 == 0).alias("tuned_on_test"), F.when(k % 19 == 0, "train+test").otherwise("train").alias("scaler_fit_on"))
    return monitor.evaluation_audit(df)


@query("SELECT p_partkey, p_partkey % 101 / 100.0::DOUBLE >= 0.55::DOUBLE AND p_partkey % 50 <> 0 AS passed FROM part")
def pass_rule(spark, sf_dir):
    df = runs(spark, sf_dir).withColumns({"best_score": F.col("value"), "leaked": F.col("p_partkey") % 50 == 0})
    return monitor.passes(df).select("p_partkey", "passed")


# --- streams, as their batch twins


@query("""WITH b AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, (value > 10)::INT + (value > 20)::INT + (value > 40)::INT AS bin FROM events WHERE value IS NOT NULL), bins AS (SELECT unnest([0, 1, 2, 3]) AS bin),
r AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER ()::DOUBLE AS ref FROM (SELECT bins.bin, count(b.bin) AS n FROM bins LEFT JOIN b ON b.bin = bins.bin GROUP BY 1)),
w AS (SELECT start, count(*) AS n FROM b GROUP BY 1), c AS (SELECT start, bin, count(*) AS k FROM b GROUP BY 1, 2),
g AS (SELECT w.start, w.n, sum(coalesce(k, 0)) OVER (PARTITION BY w.start ORDER BY r.bin) / w.n::DOUBLE AS cum, ref FROM w CROSS JOIN r LEFT JOIN c ON c.start = w.start AND c.bin = r.bin)
SELECT start, n, round(max(abs(cum - ref)), 4) AS statistic FROM g GROUP BY 1, 2""")
def window_drift(spark, sf_dir):
    e, edges = t(spark, sf_dir, "events"), [10.0, 20.0, 40.0]
    at = sum((F.when(F.col("value") > x, 1).otherwise(0) for x in edges), F.lit(0)).alias("bin")
    known = e.filter("value IS NOT NULL").groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    total = known.agg(F.sum("n").alias("_all"))
    shares = known.crossJoin(F.broadcast(total)).select("bin", (F.col("n") / F.col("_all")).alias("share"))  # one row
    return rounded(streams.window_drift(streams.windowed_counts(e, "value", edges, "1 day"), shares))
