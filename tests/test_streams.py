"""Streams that restart, late numbers, bounded look-ups, sketches; and hashes of files that are read in chunks."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.sources import tables
from millrace.streaming import events as streams

START = dt.datetime(2024, 1, 1)


def _files(spark, folder, schema, parts):
    """One Parquet file a part, read one a batch in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/p{k}")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    return live


def test_late_numbers_close_gaps_and_old_runs_are_forgotten(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    parts = [
        [("a", 1, at(0)), ("a", 4, at(1)), ("b", 1, at(0)), ("b", 3, at(1))],
        [("a", 2, at(5)), ("a", 5, at(6)), ("b", 3, at(6)), ("b", 2, at(7))],
        [("z", 1, at(200))], [("z", 2, at(400))], [("z", 3, at(401))],
    ]
    live = _files(spark, tmp_path / "in", "run string, n long, ts timestamp", parts)

    def go():
        found = streams.sequence_watch(live, "run", "n", "ts", "30 minutes")
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted((r["run"], r["number"], r["previous"], r["fault"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    # a: 3 never comes; b: 2 comes late and closes its gap, 3 comes twice.
    expected = [("a", 4, 2, "gap"), ("b", 3, 3, "repeat")]
    assert go() == expected
    spark.createDataFrame([("z", 4, at(402))], "run string, n long, ts timestamp").write.parquet(str(tmp_path / "in" / "p9"))
    assert go() == expected  # a restart goes on with the state


def test_items_are_collected_once_without_reading_the_output(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    schema = "k long, v string, ts timestamp"
    live = _files(spark, tmp_path / "in", schema, [[(1, "x", at(0)), (1, "x", at(0)), (2, "y", at(1))], [(2, "again", at(2)), (3, "z", at(2))]])

    def go():
        assert streams.collect_once(live, str(tmp_path / "out"), str(tmp_path / "c"), "k", "ts", "2 days").awaitTermination(120)
        return sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert go() == [(1, "x"), (2, "y"), (3, "z")]
    spark.createDataFrame([(3, "again", at(3)), (4, "w", at(3))], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "p9"))
    assert go() == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]


def test_sketches_merge_and_stay_within_their_error(spark, tmp_path):
    values = [((i * 7919) % 20_011) / 20_011 * 4 - 2 + (0.3 if i % 240 >= 120 else 0.0) for i in range(20_000)]
    rows = spark.createDataFrame([(START + dt.timedelta(minutes=i % 240), v) for i, v in enumerate(values)], "ts timestamp, x double")
    reference = [k / 50 * 4 - 2 for k in range(51)]
    hours = streams.window_sketches(rows, "x")
    found = {r["start"]: r for r in streams.sketch_drift(streams.merged_sketches(hours, "2 hours"), reference).collect()}
    assert len(found) == 2 and sum(r["n"] for r in found.values()) == 20_000
    for k, r in enumerate(sorted(found.values(), key=lambda r: r["start"])):
        own = [v for i, v in enumerate(values) if (i % 240 >= 120) == bool(k)]
        exact = max(abs(sum(v <= x for v in own) / len(own) - sum(y <= x for y in reference) / 51) for x in reference)
        assert r["statistic"] == pytest.approx(exact, abs=0.004)
    rows.write.parquet(str(tmp_path / "in"))
    live = streams.window_sketches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "x", late="0 seconds")
    query = live.writeStream.format("memory").queryName("sketches").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("sketches").agg(F.sum("n")).first()[0] == 20_000


def test_files_are_hashed_in_chunks(spark, tmp_path):
    data = {"a.bin": b"x" * 5_000_000, "b.bin": b"", "c.gz": b"not really gzip"}
    (tmp_path / "f").mkdir()
    for name, content in data.items():
        (tmp_path / "f" / name).write_bytes(content)
    found = {r["path"].rpartition("/")[2]: r for r in tables.file_digests(spark, str(tmp_path / "f"), chunk=1 << 16).collect()}
    assert {k: (r["n_bytes"], r["sha256"]) for k, r in found.items()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items()}
    rows = [(found["a.bin"]["path"], found["a.bin"]["sha256"]), (found["b.bin"]["path"], "0"), ("file:/gone", "1")]
    audit = {r["path"].rpartition("/")[2]: r["status"] for r in tables.audit_files(spark, str(tmp_path / "f"), spark.createDataFrame(rows, "path string, sha256 string")).collect()}
    assert audit == {"a.bin": "ok", "b.bin": "mismatch", "c.gz": "unlisted", "gone": "missing"}


def test_failing_items_are_tried_again_at_a_bounded_rate(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(item):
        import os

        tries = f"{folder}/{item['k']}"
        with open(tries, "a") as f:
            f.write("x")
        if os.path.getsize(tries) <= item["k"]:
            raise OSError("not yet")
        return {"v": os.path.getsize(tries)}

    items = spark.createDataFrame([(0,), (1,), (2,), (5,)], "k long").coalesce(1)
    began = dt.datetime.now()
    rows = tables.collect_new(items, items.limit(0), fetch, "k", "k long, v long", retries=2, pause=0.01, per_second=20).collect()
    assert {(r["k"], r["v"], r["_error"]) for r in rows} == {(0, 1, None), (1, 2, None), (2, 3, None), (5, None, "OSError: not yet")}
    assert (dt.datetime.now() - began).total_seconds() > 8 / 20  # nine calls
