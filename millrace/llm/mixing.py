"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis 2006).

A source's target is its share of all words, at most ``MAX_EPOCHS`` times its own. Complete epochs take every document of
the source; what is left of the target is filled by the documents with the smallest exponential keys -ln(U) / weight, U
coming from a hash of the document, up to the word budget. All of it is DataFrame functions.

No task sees a whole source. Sums of words by source and ordered cell of keys find the cell in which the budget ends; it
is cut into cells again until it has few rows, and only those are sorted. What comes out is a last key for each source, so
that taking a document is a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import symbol_count
from .shared import bounded, gapless, materialize, word_count

#: Weights by place in source order, repeating; most times that a source may be taken.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3

#: Cells into which the logarithms of keys, from LOWEST on, and then a cell, are cut; rows of a cell that are sorted; most cuts.
CELLS, LOWEST, SPAN, END_ROWS, LEVELS = 1024, -48.0, 64.0, 100_000, 5


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from a document's id and text; the same in every run and engine."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("#"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1, falling with the share of symbols in the text."""
    chars = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(chars == 0, F.lit(0.05)).otherwise(F.greatest(F.lit(0.05), 1.0 - 4.0 * symbol_count(text) / chars))


def water_fill(sizes: list[int], weights: list[float], cap: float = MAX_EPOCHS) -> list[float]:
    """Share the sum of all sizes by weight; a share above ``cap`` times its size stops there and the excess is reshared.

    ``targets`` does the same over a table.
    """
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if total * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = total * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            open_.remove(i)
        total -= sum(out[i] for i in over)
    return out


def targets(sizes: DataFrame, cap: float = MAX_EPOCHS) -> DataFrame:
    """Rows (_source, source_size) with target: all sizes shared by weight, a share above ``cap`` times its size stopped there.

    Sources are taken by ascending size over weight: those before the first whose share of what is left fits are stopped.
    The windows run over one row a source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight)
    order = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("_source").asc_nulls_last())
    stopped = F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumns({"_n": F.row_number().over(order), "_left": F.sum("source_size").over(Window.partitionBy()).cast("double") - stopped,
                             "_weights": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))})
    fits = rows.filter(F.col("_left") * F.col("_w") / F.col("_weights") <= cap * F.col("source_size"))
    first = fits.agg(F.min(F.struct("_n", "_left", "_weights")).alias("_f"))  # one row
    share = F.when(F.col("_n") < F.col("_f._n"), cap * F.col("source_size")).otherwise(F.col("_f._left") * F.col("_w") / F.col("_f._weights"))
    return rows.crossJoin(F.broadcast(first)).select("_source", "source_size", share.cast("double").alias("target"))


def keyed(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weight: Column | None = None) -> DataFrame:
    """Add ``_source``, ``_id``, ``_size`` and ``_key`` to the rows."""
    weight = quality_weight(F.col(text)) if weight is None else weight
    return docs.withColumns({"_size": word_count(F.col(text)), "_key": -F.log(uniform(F.col(key), F.col(text))) / weight, "_source": F.col(source), "_id": F.col(key)})


def mix_plan(rows: DataFrame) -> DataFrame:
    """Per source (_name): source_size, target, epochs and the last document of the fractional part.

    That document is given by ``cut_key`` and ``cut_id`` (all before it are taken), by ``cut_in`` (whether it is) and, as
    rows may be repeated, by ``ties``: how many of the ``tied`` rows with its key and id are. ``rows`` are a materialized
    result of ``keyed``.
    """
    sizes = materialize(rows.groupBy("_source").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("source_size")))
    n, t = F.col("source_size"), F.col("target")
    epochs = F.when(n == 0, 0).otherwise(F.least(F.lit(MAX_EPOCHS), F.floor(t / n + 1e-12).cast("int")))
    plan = targets(sizes).withColumn("epochs", epochs).withColumn("budget", F.greatest(F.lit(0.0), t - F.col("epochs") * n))
    plan = materialize(plan.withColumnRenamed("_source", "_name"))

    z = F.least(F.greatest(F.log("_key"), F.lit(LOWEST)), F.lit(LOWEST + SPAN * (1 - 1e-9)))
    inside = rows.select("_source", "_size", "_key", "_id", z.alias("_z"))
    ends = materialize(plan.filter("budget > 0").select(F.col("_name").alias("_end"), F.lit(0.0).alias("_before"), F.col("budget").alias("_rest"), F.lit(LOWEST).alias("_low"), F.lit(SPAN / CELLS).alias("_wide")))
    for level in range(LEVELS):
        met = inside.join(bounded(ends.drop("_before"), 80), F.col("_source").eqNullSafe(F.col("_end")))
        cells = met.withColumn("_cell", F.floor((F.col("_z") - F.col("_low")) / F.col("_wide")))
        sums = cells.groupBy("_source", "_cell", "_rest", "_low", "_wide").agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_words").over(Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a cell
        found = sums.withColumn("_before", before).filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words")))
        chosen = materialize(found.select(F.col("_source").alias("_end"), F.col("_cell").alias("_chosen"), (F.col("_rest") - F.col("_before")).alias("_rest"), "_low", "_wide", "_n"))
        inside = inside.join(bounded(chosen, 80), F.col("_source").eqNullSafe(F.col("_end"))).filter(F.floor((F.col("_z") - F.col("_low")) / F.col("_wide")) == F.col("_chosen"))
        inside = inside.select("_source", "_size", "_key", "_id", "_z")
        ends = chosen.select("_end", F.lit(0.0).alias("_before"), "_rest", (F.col("_low") + F.col("_chosen") * F.col("_wide")).alias("_low"), (F.col("_wide") / CELLS).alias("_wide"))
        if chosen.filter(F.col("_n") > END_ROWS).isEmpty():
            break
    # Equal rows are counted before any is ordered; how many of them the rest of the budget takes is a division.
    order = Window.partitionBy("_source").orderBy("_key", "_id")
    last = inside.join(bounded(ends, 80), F.col("_source").eqNullSafe(F.col("_end"))).groupBy("_source", "_key", "_id", "_rest").agg(F.max("_size").alias("_size"), F.count(F.lit(1)).alias("tied"))
    before = F.coalesce(F.sum(F.col("_size") * F.col("tied")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = F.when(F.col("_size") > 0, F.floor((F.col("_rest") - before - F.col("_size") / 2.0) / F.col("_size")) + 1).otherwise(F.when(before <= F.col("_rest"), F.col("tied")).otherwise(0))
    # Nulls come first, as in the order above.
    place = F.struct("_key", F.col("_id").isNotNull().alias("_known"), "_id")
    tied = last.select("_source", place.alias("_at"), F.least(F.greatest(fit, F.lit(0)), F.col("tied")).cast("long").alias("ties"), "tied")
    cut = tied.groupBy(F.col("_source").alias("_cut")).agg(F.max(F.when(F.col("ties") > 0, F.struct("_at", "ties", "tied"))).alias("_some"), F.min("_at").alias("_none"))
    at = F.coalesce("_some._at", "_none")
    cut = cut.select("_cut", at["_key"].alias("cut_key"), at["_id"].alias("cut_id"), F.col("_some").isNotNull().alias("cut_in"), F.coalesce("_some.ties", F.lit(0)).alias("ties"), F.coalesce("_some.tied", F.lit(0)).alias("tied"), F.lit(True).alias("_found"))
    both = plan.join(cut, F.col("_name").eqNullSafe(F.col("_cut")), "left")
    whole = F.when(F.col("budget") > 0, float("inf")).otherwise(-1.0)  # a budget beyond the last key takes everything
    return materialize(both.withColumn("cut_key", F.when(F.col("_found"), F.col("cut_key")).otherwise(whole)).drop("_cut", "_found", "budget"))


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``keyed`` with ``copies``, the times that the mix takes the document, and their source's figures.

    Documents are taken in key order until the budget is met; the one that crosses it is taken if that comes nearer to the
    target. Identical rows count one by one.
    """
    joined = rows.join(bounded(plan, 120), F.col("_source").eqNullSafe(F.col("_name")), "left").drop("_name")
    same = (F.col("_key") == F.col("cut_key")) & F.col("_id").eqNullSafe(F.col("cut_id"))
    earlier = (F.col("_key") < F.col("cut_key")) | ((F.col("_key") == F.col("cut_key")) & F.coalesce(F.col("_id") < F.col("cut_id"), F.col("_id").isNull() & F.col("cut_id").isNotNull()))
    taken = F.coalesce(earlier | (same & F.col("cut_in")), F.lit(False))
    out = joined.withColumn("copies", F.col("epochs") + taken.cast("int"))
    if plan.filter("ties > 0 AND ties < tied").isEmpty():
        return out
    # Some of several equal rows are taken: these rows alone are numbered, a part of them in a task.
    some = same & (F.col("ties") > 0) & (F.col("ties") < F.col("tied"))
    equal = materialize(joined.filter(some).withColumn("_part", F.spark_partition_id()))
    ranked = gapless(equal.withColumn("_group", F.xxhash64("_source")), ["_group"], F.col("_part"), [F.col("_key")], "_rank")
    ranked = ranked.withColumn("copies", F.col("epochs") + (F.col("_rank") < F.col("ties")).cast("int"))
    return out.filter(~F.coalesce(some, F.lit(False))).unionByName(ranked.select(*out.columns))


def mix_report(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes of it.

    Null and empty texts have size 0. A null source is a source of its own, the last. Repeated rows are separate
    documents. A null ``doc_id`` is sampled by its text. An empty table gives an empty result; further columns, whatever
    their names, are left out.
    A very long text is only counted, where it is read. Ties of keys go by the smaller id.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    narrow = materialize(keyed(rows).select("doc_id", "_source", "_size", "_key", "_id"))
    out = mixed(narrow, mix_plan(narrow))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns it came with.

    The rules for nulls, empty texts, ties and repeated rows are those of ``mix_report``.
    """
    rows = keyed(docs.select(F.struct("*").alias("_doc")), "_doc.source", "_doc.text", "_doc.doc_id")
    plan = mix_plan(materialize(rows.select("_source", "_size", "_key", "_id")))
    out = mixed(rows, plan).filter(F.col("copies") > 0)
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")
