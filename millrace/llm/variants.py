"""Spelling variants by search schemes on FM-indexes in both directions (Kucherov, Salikhov and Tsur 2016, for one error).

Two words are near if one insertion, deletion or replacement turns one into the other. Then the halves of the one can't
both be touched: either its first half begins the other word, or its second half ends it. So each word is searched twice,
once matching its first half exactly and extending to the right, once matching its second half and extending to the left,
and one error is allowed in the extension. With one error no search turns round, so an index of the words serves one
direction and an index of the reversed words the other.

Words are dealt to tasks by the halves that they may be asked for (two lengths on each side), and each word is asked in
the task of its own half. A half with very many words is split over several tasks, each of which is asked. A task builds
the FM-index of its delimited words: the suffix array, its Burrows-Wheeler transform, and symbol ranks that take an
interval of suffixes to that of the suffixes with one more letter in front. All words of a block are extended together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, store

#: Code points and occurrences that a word has at least, how many times more frequent its form is, and the divisor of the
#: hash of a document's word that loses a letter.
LEAST_CHARS, LEAST, RATIO, DROP = 6, 5, 5, 199

#: Words of a task's index, and words that are searched together.
SHARD_WORDS, BLOCK = 100_000, 4096

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST, drop: int | None = DROP) -> DataFrame:
    """word and n of the frequent words. A run of letters loses one, if ``drop`` divides the crc32 of its id and itself.

    A null id counts as an empty one. Only runs that are long enough are taken from a text.
    """
    low = F.translate(F.col(text), _CAPITALS, _SMALL)
    runs = F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{least_chars},}}+"), F.lit(0))
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("word"))
    if drop is not None:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        place = (h % F.length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.length("word")))
        each = each.select(F.when(h % drop == 0, short).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_chars)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


class FmIndex:
    """Words (bytes, distinct), each with a delimiter of its own before and after it; delimiters sort first, by word."""

    def __init__(self, words: list[bytes]):
        n_words = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n_words) + 1
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"\0".join([*words, b""]), dtype=np.uint8)
        self.n, self.n_words = text.size, n_words
        ends = starts + lengths - 1
        alphabet = np.unique(text)
        self.code = np.zeros(256, np.int64)
        self.code[alphabet] = np.arange(alphabet.size)  # the delimiter is 0, as are letters that no word has
        self.symbols = np.arange(1, alphabet.size)
        coded = self.code[text]

        # Suffixes are sorted by their first 1, 2, 4, ... letters; a delimiter is unlike any other and ends the comparison.
        rank = coded + n_words
        rank[ends] = np.arange(n_words)
        step = 1
        while True:
            key = rank * (self.n + n_words + 256)
            key[: self.n - step] += rank[step:] if step < self.n else 0
            order = np.argsort(key, kind="stable")
            new = np.empty(self.n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank, step = new, 2 * step
            if new[order[-1]] == self.n - 1 or step >= self.n:
                break
        suffixes = np.empty(self.n, np.int64)
        suffixes[rank] = np.arange(self.n)

        self.before = coded[suffixes - 1]  # the letter before each suffix; 0 at a word's start
        self.word_at = np.searchsorted(ends, suffixes)
        by_symbol = np.argsort(self.before, kind="stable")
        #: Row numbers by the letter before the row's suffix: a place in here is the rank of the suffix with that letter.
        self.ranks = self.before[by_symbol] * (self.n + 1) + by_symbol

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-rank intervals with one more letter in front (empty for symbol 0)."""
        at = symbol * (self.n + 1)
        low, high = np.searchsorted(self.ranks, at + low), np.searchsorted(self.ranks, at + high)
        return low, np.where(symbol > 0, high, low)

    def letters_before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) for each letter that stands before some suffix of an interval."""
        size = high - low
        few = size <= self.symbols.size
        at = np.flatnonzero(few)
        counts = size[at]
        ends = np.cumsum(counts)
        rows = np.repeat(low[at] - ends + counts, counts) + np.arange(int(ends[-1]) if ends.size else 0)
        pairs = np.unique(np.repeat(at, counts) * 256 + self.before[rows])
        pairs = pairs[pairs % 256 > 0]
        wide = np.flatnonzero(~few)
        owner = np.concatenate((pairs // 256, np.repeat(wide, self.symbols.size)))
        return owner, np.concatenate((pairs % 256, np.tile(self.symbols, wide.size)))

    def near(self, queries: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of the words that end in a query's last ``exact`` letters and are one error away, each once."""
        lengths = np.fromiter(map(len, queries), np.int64, len(queries))
        codes = self.code[np.frombuffer(b"".join(queries), dtype=np.uint8)]
        first = np.cumsum(lengths) - lengths
        low, high = np.zeros(lengths.size, np.int64), np.full(lengths.size, self.n_words, np.int64)
        for k in range(int(exact.max(initial=0))):
            on = np.flatnonzero((exact > k) & (low < high))
            low[on], high[on] = self.extend(codes[first[on] + lengths[on] - 1 - k], low[on], high[on])
        # Without an error so far: query, letters left to match, interval. And likewise those with their error behind them.
        sound = (np.arange(lengths.size), lengths - exact, low, high)
        spent = tuple(np.empty(0, np.int64) for _ in range(4))
        found: list[np.ndarray] = []
        while sound[0].size or spent[0].size:
            query, left, low, high = spent
            done = left == 0
            if done.any():
                size = (high - low)[done]
                ends = np.cumsum(size)
                rows = np.repeat(low[done] - ends + size, size) + np.arange(int(ends[-1]))
                whole = self.before[rows] == 0
                found.append(np.unique(np.repeat(query[done], size)[whole] * self.n_words + self.word_at[rows[whole]]))
            on = ~done
            query, left = query[on], left[on] - 1
            spent = self._kept(query, left, *self.extend(codes[first[query] + left], low[on], high[on]))

            query, left, low, high = sound = self._kept(*sound)
            owner, symbol = self.letters_before(low, high)
            far_low, far_high = self.extend(symbol, low[owner], high[owner])
            one, more = query[owner], left[owner]
            some = left > 0
            ahead = np.zeros(left.size, np.int64)
            ahead[some] = codes[first[query[some]] + left[some] - 1]
            other = (more > 0) & (symbol != ahead[owner])
            spent = tuple(np.concatenate(x) for x in zip(
                spent,
                self._kept(one, more, far_low, far_high),  # a letter that the query lacks
                self._kept(one[other], more[other] - 1, far_low[other], far_high[other]),  # another letter
                (query[some], left[some] - 1, low[some], high[some]),  # a letter that the word lacks
                strict=True,
            ))
            sound = self._kept(query[some], left[some] - 1, *self.extend(ahead[some], low[some], high[some]))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // self.n_words, pairs % self.n_words

    @staticmethod
    def _kept(query: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        on = low < high
        return query[on], left[on], low[on], high[on]


_FOUND = "word string, n_near long, best struct<less:long,word:string>"


def _search(key: tuple, words: pa.Table, queries: pa.Table) -> pa.Table:
    """Near words of a task's queries among its words: how many, and the most frequent one (n negative, ties to the smaller word)."""
    out: tuple[list, list, list] = ([], [], [])
    if words.num_rows and queries.num_rows:
        forward = bool(key[1].as_py())  # the first half is exact: words are read backwards
        names, ns = words.column("word").to_pylist(), words.column("n").to_pylist()
        count = dict(zip(names, ns, strict=True))
        names = sorted(count)
        ns = np.array([count[w] for w in names], dtype=np.int64)

        def coded(w: str) -> bytes:
            return w.encode("latin-1")[:: -1 if forward else 1]

        index = FmIndex([coded(w) for w in names])
        asked = queries.column("asked").to_pylist()
        for at in range(0, len(asked), BLOCK):
            part = asked[at : at + BLOCK]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            half = sizes // 2
            query, word = index.near([coded(w) for w in part], half if forward else sizes - half)
            if not forward:  # words with the same first half are found by the other search
                new = np.array([names[w][: half[q]] != part[q][: half[q]] for q, w in zip(query.tolist(), word.tolist(), strict=True)], dtype=bool)
                query, word = query[new], word[new]
            order = np.lexsort((word, -ns[word], query))
            query, word = query[order], word[order]
            firsts = np.flatnonzero(np.diff(query, prepend=-1))
            counts = np.diff(firsts, append=query.size)
            out[0].extend(part[q] for q in query[firsts].tolist())
            out[1].extend(counts.tolist())
            out[2].extend({"less": -int(ns[w]), "word": names[w]} for w in word[firsts].tolist())
    kinds = [pa.string(), pa.int64(), pa.struct([("less", pa.int64()), ("word", pa.string())])]
    return pa.table([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=["word", "n_near", "best"])


def near_words(words: DataFrame, n_words: int, least_chars: int = LEAST_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n_near and best (less: its count negative, word) of the stored words (word, n) that have near words."""
    size = F.length("word")
    back = F.reverse("word")
    # A query of length m asks for its first m / 2 letters or its last m - m / 2; near words are one longer or shorter at most.
    first = F.array_distinct(F.array(*[((size + d) / 2).cast("int") for d in (-1, 0, 1)]))
    last = F.array_distinct(F.array(*[((size + d + 1) / 2).cast("int") for d in (-1, 0, 1)]))
    ahead = words.select("word", "n", F.lit(True).alias("forward"), F.explode(first).alias("_size")).withColumn("part", F.col("word").substr(F.lit(1), F.col("_size")))
    behind = words.select("word", "n", F.lit(False).alias("forward"), F.explode(last).alias("_size")).withColumn("part", back.substr(F.lit(1), F.col("_size")))
    entries = ahead.unionByName(behind).filter(F.col("_size") >= least_chars // 2)
    both = F.array(F.struct(F.lit(True).alias("forward"), F.col("word").substr(F.lit(1), (size / 2).cast("int")).alias("part")),
                   F.struct(F.lit(False).alias("forward"), back.substr(F.lit(1), ((size + 1) / 2).cast("int")).alias("part")))
    asked = words.select("word", F.inline(both))

    # Halves with very many words: so many tasks each, at most four halves in ``shard_words`` words.
    hot = entries.groupBy(F.col("forward").alias("_f"), F.col("part").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > shard_words)
    hot = store(hot.select("_f", "_p", F.ceil(F.col("_n") / shard_words).cast("int").alias("_tasks")))
    shards = max(1, -(-4 * n_words // shard_words))
    common = F.concat(F.lit("#"), F.pmod(F.xxhash64("forward", "part"), F.lit(shards)).cast("string"))

    def dealt(rows: DataFrame, task: F.Column) -> DataFrame:
        met = rows.join(bounded(hot, 64), (F.col("forward") == F.col("_f")) & (F.col("part") == F.col("_p")), "left")
        own = F.concat("part", F.lit(":"), task.cast("string"))
        return met.withColumn("shard", F.when(F.col("_tasks").isNull(), common).otherwise(own))

    every = F.explode(F.when(F.col("_tasks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_tasks") - 1)))
    entries = dealt(entries, F.pmod(F.xxhash64("word"), F.col("_tasks"))).select("shard", "forward", "word", "n")
    met = asked.join(bounded(hot, 64), (F.col("forward") == F.col("_f")) & (F.col("part") == F.col("_p")), "left").withColumn("_task", every)
    asked = met.withColumn("shard", F.when(F.col("_tasks").isNull(), common).otherwise(F.concat("part", F.lit(":"), F.col("_task").cast("string")))).select("shard", "forward", F.col("word").alias("asked"))
    found = entries.groupBy("shard", "forward").cogroup(asked.groupBy("shard", "forward")).applyInArrow(_search, _FOUND)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form (word, form), following forms to the last.

    In a round each word takes the form of what it has; as a form is several times more frequent, a chain is as long as the
    logarithm of a count, and rounds are as many as that number has binary digits.
    """
    ways = store(forms.select("word", F.col("form").alias("root")))
    while True:
        up = bounded(ways.select(F.col("word").alias("_w"), F.col("root").alias("_r")), 64)
        ahead = store(ways.join(up, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        ways = ahead.select("word", "root")
        if ahead.filter("moved").isEmpty():
            return ways


def spelling_forms(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST, ratio: int = RATIO, drop: int | None = DROP) -> DataFrame:
    """The frequent words of all texts, each with the form that it is a variant of.

    Returns word, form (its near word of largest n, ties to the smallest, if that n is ``ratio`` times its own; else null),
    root (the last form that its forms lead to, or itself), n, n_near, form_n. Null texts have no words and a null id
    counts as an empty one. Repeated rows count as often as they occur. A very long text is cut into words where it is read;
    a very long word is a word like others. An empty table gives an empty result; further columns are left out.
    """
    words = store(vocabulary(docs, key, text, least_chars, least, drop))
    near = near_words(words, words.count(), least_chars).withColumnRenamed("word", "_word")
    met = words.join(near, F.col("word") == F.col("_word"), "left")
    named = -F.col("best.less") >= ratio * F.col("n")
    met = store(met.select("word", F.when(named, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(named, -F.col("best.less")).alias("form_n")))
    last = roots(met.filter(F.col("form").isNotNull())).withColumnsRenamed({"word": "_word", "root": "_root"})
    out = met.join(bounded(last, 64), F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
