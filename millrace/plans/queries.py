"""Registered queries of the library's own operators, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import SHAPES
from ..operators import clean, encode, features, metrics, models, monitor, neighbours, profile
from ..sources import tables
from ..streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing values: quantity where the order key divides by 7, tax by 5, flag by 11."""
    key = F.col("l_orderkey")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", *[F.when(key % d != 0, F.col(c)).alias(c) for c, d in (("l_quantity", 7), ("l_tax", 5), ("l_returnflag", 11))], "l_extendedprice")


HOLED = """(SELECT l_orderkey, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, CASE WHEN l_orderkey % 5 <> 0 THEN l_tax END AS l_tax,
  CASE WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS l_returnflag, l_extendedprice FROM lineitem)"""
LONG = "(UNPIVOT (SELECT " + ", ".join(NUMBERS) + " FROM lineitem) ON " + ", ".join(NUMBERS) + " INTO NAME \"column\" VALUE value)"


def fraction(key: str, seed: int = 42) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def bucket(key: str, n: int, seed: int = 42) -> str:
    return f"CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT) % {n} AS INT)"


# --- profiles

_DESCRIBE = f"""d AS (SELECT "column", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3,
  round(skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)), 4) AS skewness, round(kurtosis_pop(value), 4) AS kurtosis_excess
  FROM {LONG} GROUP BY 1)"""


@query(f"""WITH {_DESCRIBE}, o AS (SELECT l."column", count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS k FROM {LONG} l JOIN d USING ("column") GROUP BY 1)
SELECT "column", n, round(mean, 4) AS mean, round(std, 4) AS std, round(median, 4) AS median, round(q1 - 1.5 * (q3 - q1), 4) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 4) AS upper_fence,
 k AS outlier_count, round(k * 100.0::DOUBLE / n, 2) AS outlier_pct,
 CAST(CASE WHEN q1 = q3 THEN greatest(1, floor(sqrt(n))) ELSE least(100, greatest(1, ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1.0::DOUBLE / 3))))) END AS INT) AS bins, skewness, kurtosis_excess,
 CASE WHEN skewness > 1 THEN '{SHAPES["high right"]}' WHEN skewness > 0.5 THEN '{SHAPES["right"]}' WHEN skewness < -1 THEN '{SHAPES["high left"]}' WHEN skewness < -0.5 THEN '{SHAPES["left"]}' ELSE '{SHAPES["none"]}' END AS shape
FROM d JOIN o USING ("column")""")
def profile_numeric(spark, sf_dir):
    return profile.numeric_cards(t(spark, sf_dir, "lineitem").select(*NUMBERS))


@query(f"""WITH {_DESCRIBE} SELECT "column", n, round(mean, 4) AS mean, round(std, 4) AS std, lo AS min, q1, median, q3, hi AS max, skewness, kurtosis_excess FROM d""")
def describe(spark, sf_dir):
    d = profile.describe(t(spark, sf_dir, "lineitem").select(*NUMBERS))
    return d.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(f"""SELECT c.name AS "column", count(*) AS n_rows, count(*) FILTER (WHERE c.gone) AS missing_count, round(count(*) FILTER (WHERE c.gone) * 100.0::DOUBLE / count(*), 2) AS missing_pct
FROM (SELECT unnest([{{'name': 'l_orderkey', 'gone': l_orderkey IS NULL}}, {{'name': 'l_quantity', 'gone': l_quantity IS NULL}}, {{'name': 'l_tax', 'gone': l_tax IS NULL}},
 {{'name': 'l_returnflag', 'gone': l_returnflag IS NULL}}, {{'name': 'l_extendedprice', 'gone': l_extendedprice IS NULL}}]) AS c FROM {HOLED}) GROUP BY 1""")
def missingness_report(spark, sf_dir):
    return profile.missing_counts(holed(spark, sf_dir)).drop("dtype")


@query("""SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(sum(n - 1) * 100.0::DOUBLE / sum(n), 2) AS duplicate_pct
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity)""")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query(f"""SELECT CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS n_rows, 5 AS n_cols, CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {HOLED} GROUP BY ALL l_orderkey, l_quantity, l_tax, l_returnflag, l_extendedprice)) AS BIGINT) AS duplicate_rows,
 false AS is_empty, (SELECT 'l_quantity:' || count(*) FILTER (WHERE l_quantity IS NULL) || ',l_returnflag:' || count(*) FILTER (WHERE l_returnflag IS NULL) || ',l_tax:' || count(*) FILTER (WHERE l_tax IS NULL) FROM {HOLED}) AS nulls""".replace("GROUP BY ALL ", "GROUP BY "))
def quality_check(spark, sf_dir):
    return profile.quality_check(holed(spark, sf_dir))


@query("""WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT value, n, round(n / sum(n) OVER ()::DOUBLE, 4) AS share, round(min(n) OVER () * 100.0::DOUBLE / sum(n) OVER (), 2) AS minority_pct FROM c""")
def class_distribution(spark, sf_dir):
    return profile.class_distribution(t(spark, sf_dir, "orders"), "o_orderpriority")


_CATS = "(SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)"


@query(f"""WITH c AS (SELECT "column", value, count(*) AS n FROM {_CATS} WHERE value IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INT) AS rank, count(*) OVER p AS cardinality, sum(n) OVER p AS a, max(n) OVER p AS m FROM c WINDOW p AS (PARTITION BY "column"))
SELECT "column", rank, value, n, cardinality, CASE WHEN cardinality <= 10 THEN 'low' WHEN cardinality <= 50 THEN 'medium' WHEN cardinality <= 1000 THEN 'high' ELSE 'very_high' END AS bucket,
 round(m / a::DOUBLE, 4) AS top_share, m / a::DOUBLE > 0.6 AS is_imbalanced FROM w WHERE rank <= 10""")
def categorical_card(spark, sf_dir):
    return profile.categorical_cards(t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))


@query("""SELECT c AS "column", n AS cardinality, CASE WHEN n <= 10 THEN 'low' WHEN n <= 50 THEN 'medium' WHEN n <= 1000 THEN 'high' ELSE 'very_high' END AS bucket FROM (
SELECT 'p_brand' AS c, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey) FROM part)""")
def cardinality_bucket(spark, sf_dir):
    return profile.cardinality(t(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size", "p_partkey"])


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {i} AS place, round(corr({a}, {b}), 4) AS r FROM lineitem" for i, (a, b) in enumerate(_PAIRS)))
def correlation_pairs(spark, sf_dir):
    return rounded(profile.correlations(t(spark, sf_dir, "lineitem"), NUMBERS))


_MULTI = "(SELECT l_quantity AS a, l_quantity * 2 + l_tax AS b, l_extendedprice AS c, l_quantity * 3 AS y FROM lineitem)"


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT '{p}' AS f, '{q}' AS g, corr({p}, {q}) AS r FROM {_MULTI}" for i, p in enumerate("abcy") for q in "abcy"[i + 1 :]) + """),
e AS (SELECT f AS c, abs(r) AS t FROM r WHERE g = 'y' UNION ALL SELECT 'y', 1.0)
SELECT f AS feature_1, g AS feature_2, round(r, 4) AS pearson_r, CASE WHEN e1.t < e2.t THEN f ELSE g END AS suggest_drop FROM r JOIN e e1 ON e1.c = f JOIN e e2 ON e2.c = g WHERE abs(r) >= 0.8""")
def multicollinear_pairs(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("b"), F.col("l_extendedprice").alias("c"), (F.col("l_quantity") * 3).alias("y"))
    return profile.multicollinear(df, "y")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey, o_totalprice AS value, round(a - 0.5 * (b - a), 4) AS lower_fence, round(b + 0.5 * (b - a), 4) AS upper_fence FROM orders, q WHERE o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)""")
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(t(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", k=0.5).withColumns({c: F.round(c, 4) for c in ("lower_fence", "upper_fence")})


@query("""WITH m AS (SELECT median(value) AS m FROM events), s AS (SELECT median(abs(value - m)) AS mad FROM events, m)
SELECT event_id, value FROM events, m, s WHERE abs(0.6745 * (value - m) / mad) > 3.5""")
def mad_outliers(spark, sf_dir):
    return profile.mad_outliers(t(spark, sf_dir, "events"), "event_id", "value")


@query("""WITH d AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
b AS (SELECT lo, hi, least(100, greatest(1, ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1.0::DOUBLE / 3))))) AS k FROM d)
SELECT CAST(least(k, floor((o_totalprice - lo) / ((hi - lo) / k)) + 1) AS INT) AS bin, round(lo + (bin - 1) * ((hi - lo) / k), 4) AS low, round(lo + bin * ((hi - lo) / k), 4) AS high, count(*) AS n FROM orders, b GROUP BY 1, lo, hi, k""")
def histogram(spark, sf_dir):
    return profile.histogram(t(spark, sf_dir, "orders"), "o_totalprice")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", round((m1 - m2) / sqrt(a + b), 4) AS t, round(pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 4) AS df FROM (SELECT avg({c}) FILTER (WHERE g) AS m1, avg({c}) FILTER (WHERE NOT g) AS m2,
 count({c}) FILTER (WHERE g) AS n1, count({c}) FILTER (WHERE NOT g) AS n2, var_samp({c}) FILTER (WHERE g) / n1 AS a, var_samp({c}) FILTER (WHERE NOT g) / n2 AS b FROM (SELECT *, l_quantity IS NULL AS g FROM {HOLED}))""" for c in ("l_extendedprice", "l_tax")))
def missing_mechanism(spark, sf_dir):
    return rounded(profile.missing_mechanism(holed(spark, sf_dir), "l_quantity", ["l_extendedprice", "l_tax"]).select("column", "t", "df"))


@query("""SELECT 'c_name' AS "column", 'id_unique' AS "check", 'warning' AS severity, count(DISTINCT c_name)::DOUBLE AS value FROM customer HAVING count(DISTINCT c_name) = count(*)""")
def validator_findings(spark, sf_dir):
    return profile.validate(t(spark, sf_dir, "customer"), "c_mktsegment")


_KINDS = [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"), ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "other"), ("o_orderpriority", "string", "categorical")]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{d}' AS dtype, '{k}' AS kind, {str(c == 'o_orderstatus').lower()} AS is_target, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM orders" for c, d, k in _KINDS))
def table_profile(spark, sf_dir):
    return profile.table_profile(t(spark, sf_dir, "orders"), "o_orderstatus")


_ROW = " || '|' || ".join(f"length(CAST({c} AS VARCHAR)) || ':' || {c}" for c in ("l_orderkey", "l_linenumber", "l_returnflag"))
FINGERPRINT = f"""(SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5({_ROW}), 1, 15) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(md5({_ROW}), 16, 15) AS BIGINT)) AS VARCHAR) AS d FROM lineitem)"""


@query(f"SELECT n AS row_count, d AS digest, substr(sha256(n || ':' || d), 1, 16) AS dataset_id FROM {FINGERPRINT}")
def fingerprint(spark, sf_dir):
    return tables.fingerprint(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


# --- cleaning and encoding


@query("""WITH u AS (SELECT c_custkey, c_name, c_acctbal, 1 AS v FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END, NULL, 2 FROM customer)
SELECT c_custkey, c_name, c_acctbal, v FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY (c_name IS NOT NULL)::INT + (c_acctbal IS NOT NULL)::INT DESC, v) AS r FROM u) WHERE r = 1""")
def dedupe_complete(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    worse = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(2).alias("v"))
    return clean.drop_duplicates(c.withColumn("v", F.lit(1)).unionByName(worse), ["c_custkey"], ["v"])


@query(f"""WITH h AS {HOLED}, m AS (SELECT median(l_quantity) AS q, median(l_tax) AS x FROM h), f AS (SELECT l_returnflag AS v FROM h WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT l_orderkey, coalesce(l_quantity, q) AS l_quantity, coalesce(l_tax, x) AS l_tax, coalesce(l_returnflag, v) AS l_returnflag, l_extendedprice FROM h, m, f""")
def impute(spark, sf_dir):
    df = holed(spark, sf_dir)
    return clean.impute(df, clean.fit_imputer(df.drop("l_orderkey")))


_TRAIN, _TEST = f"{fraction('l_orderkey')} >= 0.2", f"{fraction('l_orderkey')} < 0.2"


@query(f"""WITH h AS {HOLED}, s AS (SELECT median(l_quantity) AS mq, quantile_cont(l_quantity, 0.25) AS aq, quantile_cont(l_quantity, 0.75) AS bq, median(l_extendedprice) AS mp, quantile_cont(l_extendedprice, 0.25) AS ap, quantile_cont(l_extendedprice, 0.75) AS bp FROM h WHERE {_TRAIN}),
c AS (SELECT l_orderkey, l_returnflag, least(greatest(coalesce(l_quantity, mq), aq - 1.5 * (bq - aq)), bq + 1.5 * (bq - aq)) AS q, least(greatest(coalesce(l_extendedprice, mp), ap - 1.5 * (bp - ap)), bp + 1.5 * (bp - ap)) AS p FROM h, s),
z AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(p) AS mp, stddev_pop(p) AS sp FROM c WHERE {_TRAIN})
SELECT l_orderkey, l_returnflag, round((q - mq) / sq, 4) + 0 AS l_quantity, round((p - mp) / sp, 4) + 0 AS l_extendedprice FROM c, z WHERE {_TEST}""")
def preprocess_train_test(spark, sf_dir):
    """Split by key, fit fill, fences and scale on train rows, transform test rows."""
    train, test = models.train_test_split(holed(spark, sf_dir).drop("l_tax"), "l_orderkey")
    columns = ["l_quantity", "l_extendedprice"]
    out = clean.Preprocessor(clip=True).fit(train, columns).transform(test)
    return out.select("l_orderkey", "l_returnflag", *[(F.round(c, 4) + 0).alias(c) for c in columns])


@query("""SELECT l_orderkey, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 4) AS l_quantity FROM lineitem""")
def minmax_scale(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return rounded(clean.Scaler("minmax").fit(df, ["l_quantity"]).transform(df))


@query("""WITH s AS (SELECT median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS d FROM orders) SELECT o_orderkey, round((o_totalprice - m) / d, 4) + 0 AS o_totalprice FROM orders, s""")
def robust_scale(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return clean.Scaler("robust").fit(df, ["o_totalprice"]).transform(df).select("o_orderkey", (F.round("o_totalprice", 4) + 0).alias("o_totalprice"))


def priced(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("cat"), (F.col("o_totalprice") > 150000).cast("double").alias("y"))


_PRICED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS cat, CAST(o_totalprice > 150000 AS DOUBLE) AS y FROM orders)"


@query(f"""WITH r AS (SELECT *, {bucket('o_orderkey', 5)} AS fold FROM {_PRICED}), g AS (SELECT avg(y) AS g FROM r), p AS (SELECT cat, fold, sum(y) AS s, count(y) AS n FROM r WHERE cat IS NOT NULL GROUP BY 1, 2),
o AS (SELECT cat, fold, sum(s) OVER (PARTITION BY cat) - s AS s, sum(n) OVER (PARTITION BY cat) - n AS n FROM p)
SELECT r.o_orderkey, r.cat, r.y, r.fold, round(CASE WHEN coalesce(o.n, 0) > 0 THEN (o.s + 10 * g) / (o.n + 10) ELSE g END, 4) AS encoded FROM r CROSS JOIN g LEFT JOIN o ON o.cat = r.cat AND o.fold = r.fold""")
def target_encode_oof(spark, sf_dir):
    return encode.target_encode_oof(priced(spark, sf_dir), "o_orderkey", "cat", "y").withColumn("encoded", F.round("encoded", 4))


@query(f"""WITH r AS {_PRICED}, g AS (SELECT avg(y) AS g FROM r), m AS (SELECT cat, avg(y) AS m, count(y) AS n FROM r WHERE cat IS NOT NULL GROUP BY 1)
SELECT o_orderkey, r.cat, y, round(coalesce((n * m + 10 * g) / (n + 10), g), 4) AS encoded FROM r CROSS JOIN g LEFT JOIN m ON m.cat = r.cat""")
def target_encode_final(spark, sf_dir):
    df = priced(spark, sf_dir)
    table, overall = encode.target_map(df, "cat", "y")
    return encode.target_encode_apply(df, "cat", table, overall).withColumn("encoded", F.round("encoded", 4))


@query(f"""WITH r AS {_PRICED}, f AS (SELECT cat, count(*) / sum(count(*)) OVER ()::DOUBLE AS f FROM r WHERE cat IS NOT NULL GROUP BY 1) SELECT o_orderkey, r.cat, y, round(coalesce(f, 0), 4) AS frequency FROM r LEFT JOIN f ON f.cat = r.cat""")
def frequency_encode(spark, sf_dir):
    df = priced(spark, sf_dir)
    return encode.frequency_encode_apply(df, "cat", encode.frequency_map(df, "cat")).withColumn("frequency", F.round("frequency", 4))


@query(f"""SELECT o_orderkey, y, {", ".join(f'CAST(coalesce(cat = {v!r}, false) AS INT) AS "cat_{v}"' for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))} FROM {_PRICED}""")
def one_hot(spark, sf_dir):
    df = priced(spark, sf_dir)
    return encode.one_hot_apply(df, encode.one_hot_categories(df, ["cat"]))


# --- features


@query("""SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, round(pow(o_totalprice / 100000, 6), 4) AS skewed, round(ln(1 + pow(o_totalprice / 100000, 6)), 4) AS skewed_log FROM orders""")
def log_features(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.pow(F.col("o_totalprice") / 100000, 6).alias("skewed"))
    return rounded(features.log_features(df, columns=["o_totalprice", "skewed"]))


@query("""SELECT l_orderkey, l_quantity, l_discount, l_tax, round(l_quantity * l_discount, 6) AS "l_quantity l_discount", round(l_quantity * l_tax, 6) AS "l_quantity l_tax", round(l_discount * l_tax, 6) AS "l_discount l_tax" FROM lineitem""")
def interactions(spark, sf_dir):
    return rounded(features.interactions(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax"), columns=["l_quantity", "l_discount", "l_tax"]), 6)


@query("""SELECT l_orderkey, l_extendedprice, l_quantity, round(l_extendedprice / (l_quantity + 1e-6), 4) AS ratio_l_extendedprice_per_l_quantity FROM lineitem""")
def ratio_features(spark, sf_dir):
    return rounded(features.ratio(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS feature, {i} AS place, round((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(n * s) / (sum(n) - count(*))), 4) AS f FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS s FROM lineitem GROUP BY l_returnflag)""" for i, c in enumerate(NUMBERS)))
def anova_f(spark, sf_dir):
    return rounded(features.anova_f(t(spark, sf_dir, "lineitem"), NUMBERS, "l_returnflag").drop("p_value"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS place, round(pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 2) AS f FROM lineitem" for i, c in enumerate(["l_quantity", "l_tax"])))
def f_regression(spark, sf_dir):
    return rounded(features.f_regression(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice"), 2)


_BINNED = ", ".join("CAST(" + " + ".join(f"({c} > {c}_q[{i}] AND ({i} = 1 OR {c}_q[{i}] > {c}_q[{max(1, i - 1)}]))::INT" for i in range(1, 10)) + f" AS INT) AS {c}_b" for c in NUMBERS)
_QUANTILES = ", ".join(f"quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS {c}_q" for c in NUMBERS)


@query(f"""WITH q AS (SELECT {_QUANTILES} FROM lineitem), b AS (SELECT l_returnflag AS y, {_BINNED} FROM lineitem, q), n AS (SELECT count(*)::DOUBLE AS n FROM b) """
       + " UNION ALL ".join(f"""SELECT '{c}' AS feature, {i} AS place, round(sum(j.n / n.n * ln(j.n * n.n / (x.n * y.n))), 4) AS mi FROM (SELECT {c}_b AS x, y, count(*) AS n FROM b GROUP BY 1, 2) j
 JOIN (SELECT {c}_b AS x, count(*) AS n FROM b GROUP BY 1) x ON x.x = j.x JOIN (SELECT y, count(*) AS n FROM b GROUP BY 1) y ON y.y = j.y, n""" for i, c in enumerate(NUMBERS)))  # fmt: skip
def mutual_information(spark, sf_dir):
    return rounded(features.mutual_information(t(spark, sf_dir, "lineitem"), NUMBERS, "l_returnflag"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS place, round(var_pop({c}), 4) AS variance, var_pop({c}) > 0.01 AS keep FROM lineitem" for i, c in enumerate(NUMBERS)))
def variance_filter(spark, sf_dir):
    return rounded(features.variance_filter(t(spark, sf_dir, "lineitem"), NUMBERS, 0.01))


# --- splits, metrics, monitoring


@query(f"SELECT o_orderkey, {fraction('o_orderkey')} < 0.2 AS test, {bucket('o_orderkey', 5)} AS fold FROM orders")
def split_and_folds(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey")
    train, test = models.train_test_split(df, "o_orderkey")
    both = train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))
    return models.folds(both, "o_orderkey").select("o_orderkey", "test", "fold")


def scored(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("y"), F.round(F.col("l_extendedprice") / 1000, 0).alias("s"), (F.col("l_extendedprice") > 40000).cast("int").alias("p"))


_SCORED = "(SELECT CAST(l_quantity > 25 AS INT) AS y, round(l_extendedprice / 1000, 0) AS s, CAST(l_extendedprice > 40000 AS INT) AS p FROM lineitem)"


@query(f"""WITH c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM {_SCORED}),
m AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / (tp + fn)::DOUBLE AS re FROM c)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 4) AS accuracy, round(pr, 4) AS precision, round(re, 4) AS recall, round(2 * pr * re / (pr + re), 4) AS f1, round(tn / (tn + fp)::DOUBLE, 4) AS specificity, round(5 * pr * re / (4 * pr + re), 4) AS f_beta FROM m""")
def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(scored(spark, sf_dir), "y", "p"))


@query(f"""WITH k AS (SELECT v AS c, count(*) FILTER (WHERE y = v) AS n, count(*) FILTER (WHERE p = v) AS q, count(*) FILTER (WHERE y = v AND p = v) AS h FROM {_SCORED}, (SELECT unnest([0, 1]) AS v) GROUP BY v),
m AS (SELECT *, h / q::DOUBLE AS pr, h / n::DOUBLE AS re FROM k)
SELECT round(sum(h) / sum(n)::DOUBLE, 4) AS accuracy, round(sum(pr * n) / sum(n), 4) AS precision, round(sum(re * n) / sum(n), 4) AS recall, round(sum(2 * pr * re / (pr + re) * n) / sum(n), 4) AS f1 FROM m""")
def weighted_metrics(spark, sf_dir):
    return rounded(metrics.weighted_metrics(scored(spark, sf_dir), "y", "p"))


@query(f"""WITH g AS (SELECT s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM {_SCORED} GROUP BY s), w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT round(sum(p * (b + n / 2.0::DOUBLE)) / (sum(p) * sum(n))::DOUBLE, 4) AS roc_auc FROM w""")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored(spark, sf_dir), "y", "s"))


@query(f"""WITH g AS (SELECT s, count(*) FILTER (WHERE y = 1) AS p, count(*) AS a FROM {_SCORED} GROUP BY s), w AS (SELECT p, sum(p) OVER o AS cp, sum(a) OVER o AS ca FROM g WINDOW o AS (ORDER BY s DESC))
SELECT round(sum(p * cp / ca::DOUBLE) / sum(p)::DOUBLE, 4) AS pr_auc FROM w""")
def pr_auc(spark, sf_dir):
    return rounded(metrics.pr_auc(scored(spark, sf_dir), "y", "s"))


@query("""WITH r AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem), a AS (SELECT avg(pow(y - p, 2)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v, count(*) AS n FROM r)
SELECT round(mse, 2) AS mse, round(sqrt(mse), 2) AS rmse, round(mae, 2) AS mae, round(1 - mse / v, 2) AS r2, round(1 - (mse / v) * (n - 1) / (n - 2), 2) AS adjusted_r2 FROM a""")
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(t(spark, sf_dir, "lineitem").withColumn("p", 1500 * F.col("l_quantity")), "l_extendedprice", "p", 1), 2)


_VECTORS = "(SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)"


@query(f"""WITH e AS {_VECTORS}, m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2), d AS (SELECT e.label, e.vec_id, sum(pow(x - m, 2)) AS d FROM e JOIN m ON m.label = e.label AND m.i = e.i GROUP BY 1, 2),
s AS (SELECT label, avg(sqrt(d)) AS s, count(*) AS n FROM d GROUP BY 1), p AS (SELECT a.label AS a, b.label AS b, sqrt(sum(pow(a.m - b.m, 2))) AS g FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
r AS (SELECT a, max((x.s + y.s) / g) AS r FROM p JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY 1), g AS (SELECT i, avg(x) AS g FROM e GROUP BY 1), bt AS (SELECT sum(n * q) AS b FROM (SELECT m.label, sum(pow(m - g, 2)) AS q FROM m JOIN g USING (i) GROUP BY 1) JOIN s USING (label))
SELECT (SELECT count(*) FROM s) AS n_clusters, round((SELECT avg(r) FROM r), 4) AS davies_bouldin, round((SELECT sum(d) FROM d), 4) AS inertia,
 round(((SELECT b FROM bt) / ((SELECT count(*) FROM s) - 1)) / ((SELECT sum(d) FROM d) / ((SELECT count(*) FROM d) - (SELECT count(*) FROM s))), 4) AS calinski_harabasz""")
def cluster_metrics(spark, sf_dir):
    return rounded(metrics.cluster_metrics(t(spark, sf_dir, "embeddings"), "embedding", "label"))


@query(f"""WITH e AS {_VECTORS}, k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(pow(a.x - b.x, 2)) AS d FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
c AS (SELECT vec_id, la, min(CASE WHEN la = lb THEN d / greatest(k.n - 1, 1) END) AS a, min(CASE WHEN la <> lb THEN d / k.n END) AS b FROM d JOIN k ON k.label = lb GROUP BY 1, 2)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 4) AS silhouette FROM c""")
def silhouette_squared(spark, sf_dir):
    return rounded(metrics.silhouette_squared(t(spark, sf_dir, "embeddings"), "embedding", "label"))


@query(f"""WITH d AS (SELECT *, CAST(l_quantity > 25 AS DOUBLE) AS y, CAST(l_quantity > 25 AS DOUBLE) * 2 + 1 AS copy FROM lineitem), tr AS (SELECT * FROM d WHERE {_TRAIN}), te AS (SELECT * FROM d WHERE NOT {_TRAIN}),
f AS (SELECT 'fit_before_split' AS "check", 'CRITICAL' AS severity, NULL AS "column", 1.0::DOUBLE AS value
 UNION ALL SELECT 'row_overlap', 'WARNING', NULL, count(*) FROM (SELECT l_quantity, l_discount, copy FROM tr INTERSECT SELECT l_quantity, l_discount, copy FROM te) HAVING count(*) > 0
 UNION ALL SELECT 'target_copy', 'HIGH RISK', 'copy', round(corr(copy, y), 4) FROM tr)
SELECT *, 'HIGH' AS report_severity, false AS passed FROM f""")
def leakage_report(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_quantity") > 25).cast("int")).withColumn("copy", F.col("y") * 2.0 + 1)
    train, test = models.train_test_split(df, "l_orderkey")
    return monitor.leakage_report(train, test, ["l_quantity", "l_discount", "copy"], "y", fit_before_split=True)


@query(f"""SELECT count(*) AS overlap FROM (SELECT l_quantity, l_discount FROM lineitem WHERE {_TRAIN} INTERSECT SELECT l_quantity, l_discount FROM lineitem WHERE {_TEST})""")
def row_overlap(spark, sf_dir):
    return monitor.row_overlap(*models.train_test_split(t(spark, sf_dir, "lineitem"), "l_orderkey"), ["l_quantity", "l_discount"])


@query("""SELECT 'copy' AS feature, round(corr(CAST(l_quantity > 25 AS DOUBLE) * 2 + 1, CAST(l_quantity > 25 AS DOUBLE)), 4) AS r FROM lineitem""")
def target_copies(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_quantity") > 25).cast("int")).withColumn("copy", F.col("y") * 2.0 + 1)
    return monitor.target_copies(df, ["l_quantity", "l_tax", "copy"], "y")


def halves(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "event_type", "value", (F.col("value") + F.when(F.col("event_id") % 2 == 0, 0).otherwise(5)).alias("shifted"))
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


@query("WITH e AS (SELECT event_id, value, value + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 5 END AS shifted FROM events), " + ", ".join(f"""{c}_k AS (SELECT {c} AS v, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM e GROUP BY 1), {c}_g AS (SELECT a, b, sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM {c}_k)""" for c in ("value", "shifted"))
       + " " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, round(max(abs(ca / (SELECT sum(a) FROM {c}_k)::DOUBLE - cb / (SELECT sum(b) FROM {c}_k)::DOUBLE)), 4) AS statistic FROM {c}_g""" for c in ("value", "shifted")))
def drift_ks(spark, sf_dir):
    return rounded(monitor.ks_statistics(*halves(spark, sf_dir), ["value", "shifted"]))


@query("""WITH k AS (SELECT event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY 1), s AS (SELECT sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2 FROM k)
SELECT 'event_type' AS "column", CAST(any_value(n1) AS BIGINT) AS n1, CAST(any_value(n2) AS BIGINT) AS n2, count(*) - 1 AS df, round(sum(n2 * pow(b / n2 - a / n1, 2) / (a / n1)), 4) AS statistic FROM k, s""")
def drift_chi2(spark, sf_dir):
    return rounded(monitor.chi2_statistics(*halves(spark, sf_dir), ["event_type"]))


def _ks(c: str) -> str:
    return f"""(WITH k AS (SELECT {c} AS v, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM e GROUP BY 1), n AS (SELECT sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2 FROM k),
 g AS (SELECT max(abs(ca / n1 - cb / n2)) AS d FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM k), n)
 SELECT '{c}' AS feature, 'KS' AS test, d AS statistic, (SELECT CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE least(1, greatest(0, 2 * (SELECT sum((CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * pow(i * x, 2))) FROM range(1, 101) r(i)))) END
  FROM (SELECT sqrt(n1 * n2 / (n1 + n2)) * d AS x FROM n)) AS p FROM g)"""


@query(f"""WITH e AS (SELECT event_id, event_type, value, value + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 5 END AS shifted FROM events), k AS (SELECT count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM e GROUP BY event_type),
s AS (SELECT sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2 FROM k), c AS (SELECT sum(n2 * pow(b / n2 - a / n1, 2) / (a / n1)) AS x FROM k, s),
r AS (SELECT * FROM {_ks("value")} UNION ALL SELECT * FROM {_ks("shifted")} UNION ALL SELECT 'event_type', 'chi2', x, exp(-x / 2) * (1 + x / 2) FROM c),
f AS (SELECT count(*) FILTER (WHERE p < 0.05) / 3.0::DOUBLE AS f FROM r)
SELECT feature, test, round(statistic, 4) AS statistic, round(p, 6) AS p_value, p < 0.05 AS drifted, round(f, 4) AS drift_fraction, CASE WHEN f = 0 THEN 'NONE' WHEN f < 0.15 THEN 'LOW' WHEN f < 0.3 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, f >= 0.3 AS drift_detected FROM r, f""")
def drift_report(spark, sf_dir):
    """Five event types have four degrees of freedom, for which the chi-squared tail is closed."""
    return monitor.drift_report(*halves(spark, sf_dir), ["event_type", "value", "shifted"]).withColumn("drift_fraction", F.round("drift_fraction", 4))


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(l, '{w}') AS INT)" for w in words) + ")"


@query(f"""WITH d AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS l FROM conversations), h AS (SELECT conv_id, turn, {_hits(monitor.CLASSIFICATION_WORDS)} AS c, {_hits(monitor.REGRESSION_WORDS)} AS r, {_hits(monitor.CLUSTERING_WORDS)} AS g FROM d)
SELECT conv_id, turn, CASE WHEN g > 0 THEN 'clustering' WHEN r > c THEN 'regression' ELSE 'classification' END AS task_type,
 round(least(1.0::DOUBLE, CASE WHEN g > 0 THEN 0.6 + g * 0.15 WHEN r > c THEN 0.6 + r * 0.1 WHEN c > 0 THEN 0.6 + c * 0.1 ELSE 0.5 END)::DOUBLE, 4) AS confidence, CASE WHEN g > 0 OR r > c OR c > 0 THEN 'keyword_match' ELSE 'default_fallback' END AS method FROM h""")
def task_from_text(spark, sf_dir):
    return monitor.task_from_text(t(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "task_type", "confidence", "method")


def runs(spark, sf_dir):
    """Leaderboard-like rows from parts."""
    k = F.col("p_partkey")
    return t(spark, sf_dir, "part").select(
        k, (k % 101 / 100.0).alias("value"), F.when(k % 4 == 0, "minimize").otherwise("maximize").alias("direction"), (k % 700).alias("row_count"), F.when(k % 3 != 0, (k % 89) / 88.0).alias("train_score"),
        F.when(k % 5 != 0, (k % 17) / 100.0).alias("cv_std"), F.when(k % 7 != 0, (k % 45).cast("double")).alias("minority_pct"), F.when(k % 2 == 0, "classification").otherwise("regression").alias("task"))


_RUNS = """(SELECT p_partkey, p_partkey % 101 / 100.0::DOUBLE AS value, CASE WHEN p_partkey % 4 = 0 THEN 'minimize' ELSE 'maximize' END AS direction, p_partkey % 700 AS row_count, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 89) / 88.0::DOUBLE END AS train_score,
 CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 17) / 100.0::DOUBLE END AS cv_std, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 45)::DOUBLE END AS minority_pct, CASE WHEN p_partkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS task FROM part)"""


@query(f"""WITH s AS (SELECT p_partkey, least(100, CASE WHEN direction = 'maximize' THEN CASE WHEN value < 0.55::DOUBLE THEN 35 WHEN value < 0.7::DOUBLE THEN 20 WHEN value < 0.85::DOUBLE THEN 8 ELSE 0 END WHEN value > 1.5 THEN 35 WHEN value > 0.8::DOUBLE THEN 20 ELSE 0 END
 + CASE WHEN row_count > 0 AND row_count < 100 THEN 30 WHEN row_count >= 100 AND row_count < 500 THEN 15 ELSE 0 END
 + CASE WHEN direction = 'maximize' AND train_score IS NOT NULL THEN CASE WHEN greatest(0, train_score - value) > 0.2::DOUBLE THEN 20 WHEN greatest(0, train_score - value) > 0.1::DOUBLE THEN 10 ELSE 0 END ELSE 0 END
 + CASE WHEN cv_std > 0.12::DOUBLE THEN 15 WHEN cv_std > 0.06::DOUBLE THEN 8 ELSE 0 END + CASE WHEN task = 'classification' AND minority_pct < 10 THEN 20 WHEN task = 'classification' AND minority_pct < 20 THEN 10 ELSE 0 END) AS r FROM {_RUNS})
SELECT p_partkey, CAST(r AS INT) AS risk_score, CASE WHEN r <= 39 THEN 'LOW' WHEN r <= 69 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, CASE WHEN r <= 39 THEN 'AUTO_APPROVE' ELSE 'HUMAN_REQUIRED' END AS decision, r > 39 AS needs_review FROM s""")
def risk_score(spark, sf_dir):
    return monitor.risk_score(runs(spark, sf_dir)).select("p_partkey", "risk_score", "risk_level", "decision", "needs_review")


@query(f"""WITH f AS (SELECT p_partkey, value AS b, cv_std, train_score, minority_pct / 100 AS m, p_partkey % 50 = 0 AS leaked, task, value - 0.1 * (p_partkey % 2) AS lo FROM {_RUNS}),
c AS (SELECT p_partkey, list_filter([CASE WHEN leaked THEN 'data_leakage' END, CASE WHEN b < 0.55::DOUBLE AND m < 0.2::DOUBLE THEN 'class_imbalance' END, CASE WHEN b < 0.55::DOUBLE AND b - lo < 0.05::DOUBLE THEN 'low_sample' END, CASE WHEN cv_std > 0.08::DOUBLE THEN 'high_variance' END,
 CASE WHEN train_score - b > 0.15::DOUBLE THEN 'overfitting' END, CASE WHEN task = 'classification' AND m < 0.3::DOUBLE AND b < 0.6::DOUBLE THEN 'poor_recall' END], lambda x: x IS NOT NULL) AS l FROM f), k AS (SELECT p_partkey, CASE WHEN len(l) = 0 THEN ['low_performance'] ELSE l END AS l FROM c)
SELECT p_partkey, array_to_string(l, ',') AS categories, CASE WHEN list_contains(l, 'data_leakage') THEN 'flag_and_stop' WHEN list_contains(l, 'class_imbalance') OR list_contains(l, 'poor_recall') THEN 'retry_with_resampling'
 WHEN list_contains(l, 'overfitting') OR list_contains(l, 'high_variance') THEN 'retry_with_different_model' WHEN list_contains(l, 'low_sample') THEN 'retry_preprocessing' ELSE 'retry_with_different_model' END AS action, NOT list_contains(l, 'data_leakage') AS retry FROM k""")
def failure_categories(spark, sf_dir):
    df = runs(spark, sf_dir).withColumns({"best_score": F.col("value"), "minority": F.col("minority_pct") / 100, "leaked": F.col("p_partkey") % 50 == 0, "high_score": F.col("value"), "low_score": F.col("value") - 0.1 * (F.col("p_partkey") % 2)})
    return monitor.failure_categories(df).select("p_partkey", F.array_join("categories", ",").alias("categories"), "action", "retry")


@query("SELECT event_id, count(*) - 1 AS copies_gone FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def event_dedupe(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    twice = e.unionByName(e.filter("event_id % 3 = 0"))
    n = twice.groupBy(F.col("event_id").alias("_e")).agg((F.count(F.lit(1)) - 1).alias("copies_gone"))
    once = streams.dedupe(twice)
    return once.join(n, F.col("event_id") == F.col("_e")).select("event_id", "copies_gone")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS number FROM events), l AS (SELECT user_id, number, coalesce(lag(number) OVER (PARTITION BY user_id ORDER BY number), 0) AS previous FROM s)
SELECT user_id, number, previous, CASE WHEN number = previous THEN 'repeat' ELSE 'gap' END AS fault FROM l WHERE number = previous OR number > previous + 1""")
def sequence_gaps(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    e = t(spark, sf_dir, "events").withColumn("n", F.row_number().over(order) + (F.col("event_id") % 29 == 0).cast("int"))
    return streams.sequence_faults(e, "user_id", "n")


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS start, CAST((value > 10)::INT + (value > 20)::INT + (value > 40)::INT AS INT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def windowed_counts(spark, sf_dir):
    return streams.windowed_counts(t(spark, sf_dir, "events"), "value", [10.0, 20.0, 40.0], "1 day")


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id, p.vec_id AS near_key, sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS d FROM q JOIN embeddings p ON p.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, near_key) AS INT) AS rank FROM d) SELECT vec_id, rank, near_key, round(d, 4) AS distance FROM r WHERE rank <= 5""")
def nearest_neighbours(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return neighbours.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding").withColumn("distance", F.round("distance", 4))


@query("""WITH p AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, s_nationkey / 5.0::DOUBLE AS y FROM supplier) SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k < b.k AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.25""")
def epsilon_pairs(spark, sf_dir):
    p = t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 5.0).alias("y"))
    return neighbours.epsilon_pairs(p, "s_suppkey", ["x", "y"], 0.5)


@query()
def logistic_cross_validation(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_extendedprice") > 40000).cast("int"))
    rows = models.folds(models.assemble(df, ["l_quantity", "l_discount", "l_tax"], "y"), "l_orderkey", 3).select("features", "label", "fold").persist()
    return models.cross_validate(rows, zoo={"LogisticRegression": models.classifiers(rows.count())["LogisticRegression"]}, k=3)


@query()
def linear_leaderboard(spark, sf_dir):
    df = models.assemble(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").select("l_orderkey", "features", "label")
    train, test = models.train_test_split(df, "l_orderkey")
    zoo = models.regressors(train.count())
    return models.leaderboard(train, test, "regression", {k: zoo[k] for k in ("LinearRegression", "Ridge", "DecisionTree")}).drop("train_seconds", "infer_seconds")
