"""Event streams: de-duplication, sequence checks and drift by window; each has a batch twin that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Size of a quantile sketch.
SKETCH = 2000


def dedupe(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row a key; on a stream, keys are forgotten once the watermark has passed them."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def sequence_faults(events: DataFrame, run: str, number: str) -> DataFrame:
    """run, number, previous, fault (repeat, gap) where numbers of a run don't go up by one from 1. Batch."""
    order = Window.partitionBy(run).orderBy("number")
    rows = events.select(run, F.col(number).cast("long").alias("number")).withColumn("previous", F.coalesce(F.lag("number").over(order), F.lit(0)))
    fault = F.when(F.col("number") == F.col("previous"), "repeat").when(F.col("number") > F.col("previous") + 1, "gap")
    return rows.withColumn("fault", fault).filter(F.col("fault").isNotNull())


def sequence_faults_stream(events: DataFrame, run: str, number: str) -> DataFrame:
    """The same on a stream, in order of arrival within a batch sorted by number; the last number of each run is the state."""

    def check(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        out = []
        for n in sorted(int(x) for b in batches for x in b["number"]):
            if n == last or n > last + 1:
                out.append((key[0], n, last, "repeat" if n == last else "gap"))
            last = max(last, n)
        state.update((last,))
        yield pd.DataFrame(out, columns=[run, "number", "previous", "fault"])

    rows = events.select(run, F.col(number).cast("long").alias("number"))
    kind = dict(rows.dtypes)[run]
    return rows.groupBy(run).applyInPandasWithState(check, f"{run} {kind}, number long, previous long, fault string", "last long", "append", "NoTimeout")


def sequence_watch(events: DataFrame, run: str, number: str, time: str, wait: str = "1 hour") -> DataFrame:
    """The faults of a stream of runs whose numbers may come late: run, number, previous, fault.

    A run's state is its greatest number and the ranges that are missing below it, each with the event time at which it was
    seen. A late number closes its part of a range and is no fault; a number that isn't missing is a repeat. A range that
    is still missing when the watermark is ``wait`` past is a gap (with the numbers around it), and a run without events
    for that long is forgotten. Numbers that come later than the watermark allows are dropped before.
    """
    seconds = pd.Timedelta(wait).total_seconds()
    most = int(seconds * 1000)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, latest, missing = (0, 0, []) if not state.exists else (state.get[0], state.get[1], json.loads(state.get[2]))
        out, now = [], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            rows = pd.concat([b[["number", "_ms"]] for b in batches], ignore_index=True).sort_values(["_ms", "number"], kind="stable")
            for n, at in zip(rows["number"].tolist(), rows["_ms"].tolist(), strict=True):
                latest = max(latest, at)
                hit = next((k for k, (low, high, _) in enumerate(missing) if low <= n <= high), None)
                if n > last:
                    if n > last + 1:
                        missing.append([last + 1, n - 1, at])
                    last = n
                elif hit is not None:
                    low, high, since = missing.pop(hit)
                    missing += [[a, b, since] for a, b in ((low, n - 1), (n + 1, high)) if a <= b]
                else:
                    out.append((key[0], n, n, "repeat"))
        due = [m for m in missing if m[2] + most <= now]
        out += [(key[0], high + 1, low - 1, "gap") for low, high, _ in sorted(due)]
        missing = [m for m in missing if m[2] + most > now]
        if latest + most <= now:
            state.remove()
        else:
            state.update((last, latest, json.dumps(missing)))
            state.setTimeoutTimestamp(max(now + 1, min([latest, *[m[2] for m in missing]]) + most))
        yield pd.DataFrame(out, columns=[run, "number", "previous", "fault"])

    rows = events.withWatermark(time, wait).select(run, time, F.col(number).cast("long").alias("number"), (F.col(time).cast("double") * 1000).cast("long").alias("_ms"))
    kind = dict(rows.dtypes)[run]
    return rows.groupBy(run).applyInPandasWithState(watch, f"{run} {kind}, number long, previous long, fault string", "last long, latest long, missing string", "append", "EventTimeTimeout")


def decile_edges(reference: DataFrame, column: str, bins: int = 10) -> list[float]:
    return sorted(set(reference.agg(F.percentile_approx(F.col(column).cast("double"), [i / bins for i in range(1, bins)], 10_000)).collect()[0][0] or []))


def windowed_counts(events: DataFrame, column: str, edges: list[float], window: str = "1 hour", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """start, bin, n by tumbling window over fixed reference bins; on a stream, later rows than ``late`` are dropped."""
    at = sum((F.when(F.col(column) > x, 1).otherwise(0) for x in edges), F.lit(0)).alias("bin")
    rows = events.filter(F.col(column).isNotNull())
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    return rows.groupBy(F.window(time, window).alias("_w"), at).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), "bin", "n")


def window_drift(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """start, n, statistic: the largest gap between a window's shares and the reference's (bin, share), over bins in order."""
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
    below = reference.select(F.col("bin").alias("_bin"), F.sum("share").over(order).alias("_ref"))
    totals = counts.groupBy(F.col("start").alias("_s")).agg(F.sum("n").alias("_all"))
    cells = totals.join(F.broadcast(below)).join(counts, (F.col("_s") == F.col("start")) & (F.col("_bin") == F.col("bin")), "left")
    run = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    gaps = cells.withColumn("_cum", F.sum(F.coalesce("n", F.lit(0))).over(run) / F.col("_all"))
    return gaps.groupBy(F.col("_s").alias("start"), F.col("_all").alias("n")).agg(F.max(F.abs(F.col("_cum") - F.col("_ref"))).alias("statistic"))


def monitor_drift(events: DataFrame, reference: DataFrame, column: str, sink: Callable[[DataFrame], None], checkpoint: str, window: str = "1 hour", time: str = "ts") -> StreamingQuery:
    """Start a stream that hands ``sink`` the drift of each window that has closed, against fixed reference bins."""
    edges = decile_edges(reference, column)
    at = sum((F.when(F.col(column) > x, 1).otherwise(0) for x in edges), F.lit(0)).alias("bin")
    known = reference.filter(F.col(column).isNotNull())
    total = known.agg(F.count(F.lit(1)).alias("_all"))  # one row
    shares = known.groupBy(at).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total)).select("bin", (F.col("_n") / F.col("_all")).alias("share"))
    counts = windowed_counts(events, column, edges, window, time)
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: sink(window_drift(batch, shares))).start()


def window_sketches(events: DataFrame, column: str, window: str = "1 hour", time: str = "ts", late: str = "10 minutes", size: int = SKETCH) -> DataFrame:
    """start, n and a mergeable quantile sketch (KLL) of the values of each tumbling window, in batch or as a stream's state."""
    value = F.col(column).cast("double")
    rows = events.filter(value.isNotNull() & ~F.isnan(value))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    found = rows.groupBy(F.window(time, window).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"))
    return found.select(F.col("_w.start").alias("start"), "n", "sketch")


def merged_sketches(sketches: DataFrame, window: str) -> DataFrame:
    """Sketches of longer windows from those of shorter ones, without the values."""
    wide = sketches.groupBy(F.window("start", window).alias("_w")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return wide.select(F.col("_w.start").alias("start"), "n", "sketch")


def sketch_drift(sketches: DataFrame, reference: list[float]) -> DataFrame:
    """start, n, statistic: the largest gap between a window's distribution and the sorted reference values, at these values.

    The exact gap at these points is within the sketch's rank error: about 0.2 % of the rows at the default size of 2,000.
    """
    n = len(reference)
    points = sorted(set(reference))
    below = {x: sum(1 for y in reference if y <= x) / n for x in points}
    gap = lambda x: F.abs(F.kll_sketch_get_rank_double("sketch", F.lit(float(x))) - F.lit(below[x]))
    return sketches.select("start", "n", F.greatest(*map(gap, points), F.lit(0.0)).alias("statistic"))


def collect_once(stream: DataFrame, path: str, checkpoint: str, key: str, time: str, forget: str = "7 days") -> StreamingQuery:
    """Append a stream of items to Parquet, each key once within ``forget`` of its first event time, also over restarts.

    What is remembered are the keys of that time, as keyed state; the output is never read. Each batch overwrites a folder
    of its own number, so a batch that is run again after a failure leaves no second copy.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    once = stream.withWatermark(time, forget).dropDuplicatesWithinWatermark([key])
    return once.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def collect_stream(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append a stream of items to Parquet, each key once for ever, also over restarts; every batch reads the keys written so far.

    ``collect_once`` has a bounded memory instead.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            done = spark.read.parquet(path).select(key)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # else nothing is written yet
                raise
            done = None
        (new if done is None else new.join(done, key, "left_anti")).write.mode("append").parquet(path)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).start()
