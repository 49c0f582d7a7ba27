"""Reading and writing tables, fingerprints, integrity audits, lineage, generated tables and resumable collection."""

from __future__ import annotations

import hashlib
import math
import os
import tempfile
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X


def load(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """A table by its suffix: .parquet, .json (one document, or lines) and anything else as CSV with a header."""
    kind = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "json":
        return reader.option("multiLine", not lines).json(path)
    return reader.option("header", True).option("inferSchema", schema is None).csv(path)


def save_parquet(df: DataFrame, root: str, run: str, stage: str, name: str, mode: str = "error") -> str:
    """Snappy Parquet under root/run/stage/name."""
    path = "/".join([root.rstrip("/"), run, stage, name])
    df.write.mode(mode).option("compression", "snappy").parquet(path)
    return path


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one where it is unset and the session is local."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found if ":/" in found else "file://" + found


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def report_json(report: DataFrame) -> DataFrame:
    """One JSON text a row, null fields left out."""
    return report.select(F.to_json(F.struct("*")).alias("json"))


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON column beside the other columns; text that isn't such a document gives nulls."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.from_json(F.col(column), schema).alias("_parsed")).select(*[F.col(f"`{c}`") for c in df.columns], "_parsed.*")


def save_report(report: DataFrame, path: str, mode: str = "error") -> None:
    report.write.mode(mode).json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """row_count, digest and dataset_id of a table; the order of rows and the partitioning don't matter.

    A row is its cells, each with its length in front (null apart from any text); two 60-bit numbers from the row's md5
    are summed up exactly.
    """
    cells = [F.coalesce(F.concat(F.char_length(F.col(f"`{c}`").cast("string")), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in df.columns]
    digest = F.md5(F.concat_ws("|", *cells))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    sums = [F.coalesce(F.sum(h), F.lit(0)).cast("string") for h in halves]
    out = df.agg(F.count(F.lit(1)).alias("row_count"), F.concat_ws("-", *sums).alias("digest"))
    return out.withColumn("dataset_id", F.substring(F.sha2(F.concat_ws(":", "row_count", "digest"), 256), 1, 16))


def lineage(spark: SparkSession, stage: str, operation: str, inputs: dict[str, str], outputs: dict[str, str]) -> DataFrame:
    """One row to append to a lineage table."""
    schema = "stage string, operation string, inputs map<string,string>, outputs map<string,string>"
    return spark.createDataFrame([(stage, operation, inputs, outputs)], schema).withColumn("at", F.current_timestamp())


def file_digests(spark: SparkSession, folder: str, chunk: int = 1 << 20) -> DataFrame:
    """path, n_bytes and sha256 of the files under a folder, of any size, empty ones too.

    The driver lists names and sizes; tasks read each file through in chunks, so no file is ever in memory.
    """
    parts = urlsplit(folder)
    scheme = f"{parts.scheme or 'file'}://{parts.netloc}" if parts.netloc else f"{parts.scheme or 'file'}:"
    files, place = pafs.FileSystem.from_uri(folder if parts.scheme and not folder.startswith("file:/") else "file://" + parts.path)
    found = [f for f in files.get_file_info(pafs.FileSelector(place, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
    listed = spark.createDataFrame([(scheme + f.path, f.size) for f in found], "path string, n_bytes long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for path in batch.column(0).to_pylist():
                here, place = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                digest = hashlib.sha256()
                with here.open_input_stream(place, compression=None) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, type=pa.string())], names=["path", "n_bytes", "sha256"])

    tasks = max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(tasks).mapInArrow(hashed, "path string, n_bytes long, sha256 string")


def audit_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files of a folder against (path, sha256): ok, mismatch, missing or unlisted."""
    found = file_digests(spark, folder).select("path", F.col("sha256").alias("actual"))
    both = manifest.select("path", "sha256").join(found, "path", "full_outer")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("actual") == F.col("sha256"), "ok").otherwise("mismatch")
    return both.select("path", "sha256", "actual", status.alias("status"))


def _uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key; the same in every engine and for every partitioning."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def _normal(key: Column, seed: int) -> Column:
    return F.sqrt(-2.0 * F.log(_uniform(key, 2 * seed))) * F.cos(2.0 * F.lit(math.pi) * _uniform(key, 2 * seed + 1))


def generate_for(rows: DataFrame, key: str, task: str, features: int = 6, seed: int = 42, centres: int = 3) -> DataFrame:
    """The rows with feature_0.. and target: informative features, linear mixes of two of them, and a target by task.

    classification: sign of a linear form; regression: the form plus 0.1 noise; clustering: spheres around centres. All
    numbers come from hashes of the key, so that reruns and other partitionings give the same table.
    """
    k, made = F.col(key), {}
    if task == "clustering":
        rows = rows.withColumn("target", X.hash_bucket(k, centres, seed))
        return rows.withColumns({f"feature_{i}": _normal(k, seed + i) + 20.0 * _uniform(F.col("target"), seed + 5000 + i) - 10.0 for i in range(features)})
    informative = max(2, features - 2)
    for i in range(informative):
        made[f"feature_{i}"] = _normal(k, seed + i)
    for i in range(informative, min(features, informative + 2)):
        made[f"feature_{i}"] = 0.6 * made["feature_0"] - 0.4 * made[f"feature_{(i - informative) % informative}"]
    form = sum((made[f"feature_{i}"] * ((i % 3) + 1.0) for i in range(1, informative)), made["feature_0"])
    made["target"] = (form > 0).cast("int") if task == "classification" else form + 0.1 * _normal(k, seed + 1000)
    return rows.withColumns(made)


def generate(spark: SparkSession, task: str, rows: int = 200, features: int = 6, seed: int = 42, centres: int = 3) -> DataFrame:
    """row_id, feature_0.., target of ``generate_for`` for row ids from 0."""
    return generate_for(spark.range(rows).withColumnRenamed("id", "row_id"), "row_id", task, features, seed, centres)


def skip_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items whose key isn't done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def collect_new(items: DataFrame, done: DataFrame, fetch: Callable[[dict], dict], key: str, schema: str, retries: int = 0, pause: float = 1.0, per_second: float | None = None) -> DataFrame:
    """Fetch the items whose key isn't done yet; a failing item becomes a row with its error in ``_error``.

    An item is tried ``retries`` times more before that, after pauses that double. A task makes ``per_second`` calls a
    second at most, tries included; the whole rate is that times the tasks that run at once. Append the result to the table
    that ``done`` is read from to make a run resumable.
    """
    todo = skip_done(items, done, key)
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_at = 0.0
        for batch in batches:
            out = []
            for item in batch.to_dict("records"):
                for attempt in range(retries + 1):
                    if per_second:
                        time.sleep(max(0.0, free_at - time.monotonic()))
                        free_at = max(free_at, time.monotonic()) + 1.0 / per_second
                    try:
                        out.append({**dict.fromkeys(names), **fetch(item), key: item[key], "_error": None})
                        break
                    except Exception as e:  # noqa: BLE001 an item's failure is data
                        if attempt == retries:
                            out.append({**dict.fromkeys(names), key: item[key], "_error": f"{type(e).__name__}: {e}"})
                        else:
                            time.sleep(pause * 2**attempt)
            yield pd.DataFrame(out, columns=[*names, "_error"])

    return todo.mapInPandas(run, f"{schema}, _error string")
