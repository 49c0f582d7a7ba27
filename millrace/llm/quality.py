"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a named boolean expression over a document's text that is true where the document is rejected. ``plan_cascade``
runs each rule alone over a small sample, notes its seconds and the share that it rejects, and orders the rules by
rejection per second. ``cascade`` chains them with CASE WHEN, so that a row stops at the first rule that rejects it. The
order changes the time taken, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import word_array

#: Fixed values of the base rule.
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = "#*$%&|<>"

#: Limits of the further rules, far from what running prose shows.
SYMBOL_PERCENT, DUPLICATE_LINE_PERCENT, MAX_WORD_CHARS, MIN_LINES = 20, 60, 30, 4

#: Rows on which a rule's cost and selectivity are estimated, and how often they are taken over for its cost.
SAMPLE_ROWS, TIMES = 500, 8


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def symbol_count(text: Column) -> Column:
    """Characters of ``SYMBOLS``."""
    text = text_or_empty(text)
    rest = text
    for symbol in SYMBOLS:
        rest = F.replace(rest, F.lit(symbol), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def lines_with_words(text: Column) -> Column:
    lines = F.split(text_or_empty(text), "\n")
    return F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(lines_with_words(text), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def word_chars(words: Column) -> Column:
    """Code points in the words."""
    return F.char_length(F.array_join(words, "")).cast("long")


def repeated_words(words: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text (the first one included).

    Windows are compared by a 64-bit hash. Texts without a repeated window, the most, stop at the distinct count; for
    others, equal windows meet in one sort, and the sorted places of repeated windows are summed up without overlap.
    """

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - width)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def covered(hashes: Column) -> Column:
        paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(p: Column) -> Column:
            last = F.size(p) - 1
            twice = F.filter(p, lambda x, j: ((j > 0) & (p[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
                             | ((j < last) & (p[F.least(j + 1, last)]["h"] == x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("end"))
        places = let(paired, twins)
        total = F.aggregate(
            places, start,
            lambda s, i: F.struct((s["n"] + i + width - F.greatest(i, s["end"])).cast("int").alias("n"), (i + width).cast("int").alias("end")),
        )
        return total["n"]

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return let(hashed, lambda w: F.when(F.size(w) <= width, F.lit(0)).otherwise(let(windows(w), of_hashes))).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects(text)`` is true where the document is rejected; it is never null."""

    name: str
    rejects: object


def base_rules() -> list[Rule]:
    """Too few words; too many words in repeated windows."""
    return [
        Rule("few_words", lambda t: F.size(word_array(t)) < MIN_WORDS),
        Rule("repeated_words", lambda t: let(word_array(t), lambda w: 100 * repeated_words(w) > REPEAT_PERCENT * F.size(w))),
    ]


def further_rules() -> list[Rule]:
    """Symbols, duplicate lines and overlong words; with wide margins, so that clean prose passes in any language."""
    return [
        Rule("symbols", lambda t: 100 * symbol_count(t) > SYMBOL_PERCENT * F.char_length(text_or_empty(t))),
        Rule("duplicate_lines", lambda t: let(lines_with_words(t), lambda a: (F.size(a) >= MIN_LINES)
             & (100 * (F.size(a) - F.size(F.array_distinct(a))) > DUPLICATE_LINE_PERCENT * F.size(a)))),
        Rule("long_words", lambda t: let(word_array(t), lambda w: (F.size(w) > 0)
             & (F.char_length(F.array_join(w, "")) > MAX_WORD_CHARS * F.size(w)))),
    ]


def default_rules() -> list[Rule]:
    return [*base_rules(), *further_rules()]


def plan_cascade(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, times: int = TIMES) -> list[Rule]:
    """The rules in order of rejected share per second on ``sample_rows`` rows drawn over all files (an empty table: as given).

    A rule's seconds are those of the sample taken ``times`` over, less those of counting its letters: the job's own time,
    which all rules share, would hide what they cost. Ties go by the given order.
    """
    sample = docs.select(F.col(text).alias("text")).orderBy(F.rand(11)).limit(sample_rows).persist()
    try:
        rows = sample.count()
        if not rows:
            return list(rules)
        many = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_again"))

        def measured(value: Column) -> tuple[int, float]:
            query, took = many.agg(F.sum(value.cast("long")).alias("n")), []
            for _ in range(3):  # the first one compiles the expression
                began = time.perf_counter()
                n = query.collect()[0]["n"] or 0
                took.append(time.perf_counter() - began)
            return n, min(took[1:])

        job = measured(F.char_length(text_or_empty(F.col("text"))))[1]
        scored = []
        for place, rule in enumerate(rules):
            rejected, seconds = measured(rule.rejects(F.col("text")))
            scored.append((-(rejected / times + 1) / (rows + 2) / max(seconds - job, 1e-4), place, rule))
        return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def cascade(text: Column, rules: list[Rule]) -> Column:
    """True where no rule rejects; rules after the first that rejects aren't evaluated."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(text), F.lit(False)).otherwise(verdict)
    return verdict


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The documents that pass all rules, with the columns they came with. Null and empty texts are rejected."""
    ordered = plan_cascade(docs, rules or default_rules(), text)
    return docs.filter(cascade(F.col(text), ordered))


def quality_report(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document the base counts, the base verdict and whether the cascade keeps it.

    A null or empty text has no words and fails the base rule; repeated rows are judged one by one; other columns, such
    as one named n_words, don't matter; an empty table gives an empty result.
    A very long text is judged whole, where it is read. Rules that tie keep the given order.
    """
    extra = plan_cascade(docs, rules or further_rules(), text)
    counts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), F.struct(
        let(word_array(F.col(text)), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        symbol_count(F.col(text)).alias("n_symbols"), duplicate_lines(F.col(text)).alias("n_dup_lines")).alias("_c"))
    flat = counts.select(
        "doc_id", "_c.w.n_words", "_c.w.word_chars", "_c.n_symbols", "_c.n_dup_lines", "_c.w.n_repeat_words", "_text"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    kept = F.when(failed, F.lit(False)).otherwise(cascade(F.col("_text"), extra))
    return flat.select("*", failed.alias("base_failed"), kept.alias("kept")).drop("_text")
