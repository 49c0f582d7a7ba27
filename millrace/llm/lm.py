"""Causal self-attention language model on subword ids, trained and run in numpy inside Spark tasks.

Words are lower-cased and cut into subword ids. Documents fall into ``TOPICS`` groups of like words (k-means on hashed word
shares), and words are counted by topic over the whole corpus. One layer of causal attention over the ids before, in windows
of ``CONTEXT`` ids, gives the probabilities of the topics at each word and, among ``CLASSES`` classes of ids with like
neighbours, corrects those of the next id. A word's probability is

    sum over topics of P(topic | ids before) P(word | topic)  +  new P(its ids | ids before),

the counts less an absolute discount, which is the weight of the second part: the spelling, from tables of the distinct
words' ids and the attention's corrections, which are learned on every id of all texts. So attention decides both parts;
counts alone decide none. All words have both, however often they were seen (those seen ``COMMON`` times or more would have
no second part).

The attention weights are trained on windows that hold every id of every training text once as a target, by several
trainers whose weights are averaged. A text is scored in windows that overlap; each place is scored in the one window that
gives it the longest context on a grid of ``STRIDE``, and many windows share one masked attention.

The ``HEAD_WORDS`` most frequent words' counts, a bounded table, are read by every worker; other words of a document are joined to
the word counts by a 64-bit hash, with what the attention says at each of their places, so that base and score have the
counts of all words. Two words with one hash share their counts: one pair is expected among six billion distinct words.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, give_back, kept, make_room, open_fs, shared_dir, store
from .subwords import _OTHER, _last_bytes, _tails, in_pieces

#: Fixed rule of the split: a document is held out if crc32 of its id as text leaves this remainder.
FOLDS, HELD_OUT = 7, 2

CLASSES, TOPICS, WIDTH, HASHED, SIGNS = 48, 8, 8, 1024, 16
CONTEXT, STRIDE = 32, 16
HEAD_WORDS, LEXICON_WORDS, PIECE_BYTES, SCORED_BYTES, TOGETHER = 1 << 20, 300_000, 4 << 20, 1 << 20, 256
PAIR_ROWS = 400_000
TRAINER_WINDOWS, MAX_TRAINERS, TRAIN_BATCH, RATE = 20_000, 1024, 128, 0.01

#: Words seen this often have no spelled part: none, so attention predicts the ids of every word; most of them whose letters
#: training would leave out; share of the overall counts in a topic's; cells of the topics' vectors, main directions that they start from, most rounds of their fit.
COMMON, COMMON_WORDS, LEAK, CELLS, DIRECTIONS, TOPIC_ROUNDS = math.inf, 1 << 20, 0.05, 256, 3, 25

#: What ends a text is counted as a word, which no text can hold.
END = b"\n"

#: Bits of a window's ids: the id begins a word, its word isn't common.
FIRST, RARE = 1 << 28, 1 << 29

_HASH_SEED = 42  # that of Spark's xxhash64
LOG10 = math.log(10)


def word_hash(word: bytes) -> int:
    """The signed 64-bit hash that Spark's xxhash64 gives a binary column."""
    import xxhash

    value = xxhash.xxh64_intdigest(word, seed=_HASH_SEED)
    return value - (1 << 64) if value >> 63 else value


#: Symbols that are a piece of their own after a letter.
_TRAILING = ".,;:!?"

_subwords: dict[str, object] = {}
_leads: dict[str, np.ndarray] = {}


def subword_encoder(ranks_path: str):
    """A byte-pair encoder from a file of ranks; one per worker."""
    if ranks_path not in _subwords:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _subwords[ranks_path] = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _subwords[ranks_path]


def spell_words(ranks_path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each after a space, and how many of each.

    Symbols after a letter at a word's end are a piece of their own, so each word before them is encoded once, and so are they.
    """
    column = pa.array(words, type=pa.binary()).cast(pa.string())
    cores = pc.utf8_rtrim(column, characters=_TRAILING)
    last = _last_bytes(cores)
    cut = (last >= ord("a")) & (last <= ord("z")) & (np.asarray(pc.binary_length(cores)) < np.asarray(pc.binary_length(column)))
    coded = pc.if_else(pa.array(cut), cores, column).dictionary_encode()
    ends = _tails(column.filter(pa.array(cut)), cores.filter(pa.array(cut))).dictionary_encode()
    ids, width = _spell(ranks_path, coded.dictionary)
    alone = [subword_encoder(ranks_path).encode_ordinary(end) for end in ends.dictionary.to_pylist()]
    ids = np.concatenate([ids, np.fromiter(chain.from_iterable(alone), dtype=np.int64)])
    width = np.concatenate([width, np.fromiter(map(len, alone), dtype=np.int64)])
    # Each word's core, then its end, if it was cut.
    parts = np.stack([np.asarray(coded.indices, dtype=np.int64), np.full(len(words), -1)], axis=1)
    parts[cut, 1] = len(coded.dictionary) + np.asarray(ends.indices, dtype=np.int64)
    kept = parts.ravel()
    kept = kept[kept >= 0]
    size = width[kept]
    ids = ids[np.repeat((np.cumsum(width) - width)[kept] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return ids, width[parts[:, 0]] + np.where(cut, width[parts[:, 1]] if width.size else 0, 0)


def _spell(ranks_path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``spell_words``, of distinct words (strings).

    Many are encoded together, since an id that begins with a space begins a word; words that hold white space outside
    ASCII are encoded one by one.
    """
    encoding = subword_encoder(ranks_path)
    if ranks_path not in _leads:
        _leads[ranks_path] = np.array([t[:1] == b" " for t in map(encoding.decode_single_token_bytes, range(encoding.n_vocab))])
    leads, ids, widths = _leads[ranks_path], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    starts = np.append(np.arange(0, len(words), TOGETHER), len(words)).astype(np.int32)
    odd = np.add.reduceat(np.asarray(pc.match_substring_regex(words, _OTHER)), starts[:-1], dtype=np.int64) if len(words) else ()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), words), " ")
    for at, text, apart in zip(starts.tolist(), joined.to_pylist(), odd, strict=False):
        n = min(TOGETHER, len(words) - at)
        found = np.array([] if apart else encoding.encode_ordinary(" " + text), dtype=np.int64)
        begin = np.flatnonzero(leads[found])
        width = np.diff(begin, append=found.size)
        if begin.size != n or begin[0]:
            each = [encoding.encode_ordinary(" " + w) for w in words.slice(at, n).to_pylist()]
            found, width = np.fromiter(chain.from_iterable(each), dtype=np.int64), np.fromiter(map(len, each), dtype=np.int64)
        ids.append(found)
        widths.append(width)
    return np.concatenate(ids), np.concatenate(widths)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (binary) of all texts, one after the other, and how many of each; as ``words_of`` has them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, sizes = lists.flatten().cast(pa.binary()), np.asarray(pc.list_value_length(lists), dtype=np.int64)
    empty = np.asarray(pc.binary_length(words)) == 0  # beside white space at a text's ends
    if not empty.any():
        return words, sizes
    return words.filter(pa.array(~empty)), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~empty], minlength=len(sizes))


class _WordCells(dict):
    """Cell of a word in topic vectors; kept for some words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= LEXICON_WORDS:
            self.clear()
        self[word] = cell = zlib.crc32(word) % CELLS
        return cell


def topic_vector(words: list[bytes], cells: _WordCells) -> np.ndarray:
    """Square roots of the shares of cells among a text's words."""
    counts = np.bincount(np.fromiter(map(cells.__getitem__, words), dtype=np.int64, count=len(words)), minlength=CELLS)
    return np.sqrt(counts / max(1, len(words))).astype(np.float32)


def topic_vectors(cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``topic_vector`` of texts of so many words each, from the cells of all words."""
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * CELLS + cells, minlength=len(sizes) * CELLS).reshape(-1, CELLS)
    return np.sqrt(counts / np.maximum(1, sizes)[:, None]).astype(np.float32)


def cells_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words of all texts, one after the other, and how many words of each."""
    words, sizes = split_words(texts)
    coded = words.dictionary_encode()
    cells = np.fromiter(map(zlib.crc32, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), dtype=np.int64, count=len(coded.dictionary)) % CELLS
    return cells.take(np.asarray(coded.indices)), sizes


class _Words:
    """Words that a worker has met, a row each, with their cells.

    Only the distinct words of a piece are looked up, and new ones are learned together. Beyond ``LEXICON_WORDS`` those
    that only one piece had are forgotten first.
    """

    fields = ("cell",)

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.used = np.zeros(0, dtype=np.int32)
        for name in self.fields:
            setattr(self, name, np.zeros(0, dtype=np.int64))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words of all texts, one after the other, and how many words of each."""
        words, sizes = split_words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.rows) > LEXICON_WORDS:
            self.forget()
        rows = np.fromiter(map(self.rows.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(rows < 0)
        if missing.size:
            new, at = [distinct[k] for k in missing.tolist()], len(self.rows)
            rows[missing] = np.arange(at, at + len(new))
            learned = self.learn(new)
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
            self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int32)])
            for name, x in learned.items():
                setattr(self, name, np.concatenate([getattr(self, name), x]))
        self.used[rows] += 1
        return (rows[np.asarray(coded.indices)] if len(distinct) else np.zeros(0, dtype=np.int64)), sizes

    def learn(self, words: list[bytes]) -> dict[str, np.ndarray]:
        return {"cell": np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % CELLS}

    def forget(self) -> None:
        kept = np.flatnonzero(self.used > 1)
        if kept.size > LEXICON_WORDS // 2:
            kept = kept[:0]
        words = list(self.rows)
        self.rows = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.used = np.ones(kept.size, dtype=np.int32)
        for name in self.fields:
            setattr(self, name, getattr(self, name)[kept])


def nearest_topic(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)


def nearest_of(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row of levels (unsigned bytes), in double precision."""
    return nearest_topic(vectors.astype(float), centres)


def fit_topics(docs: DataFrame) -> np.ndarray:
    """Centres of topics, by k-means over all documents.

    Vectors are kept as levels of 0 to 255, whose sums are whole numbers, so that the order of rows changes nothing. The
    first centres are the means of the sign patterns along the three main directions of all vectors.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in in_pieces(batch, 0, PIECE_BYTES)):
            found = np.rint(topic_vectors(*cells_of(part.column(0))) * 255).astype("u1")
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CELLS), len(found), [None, pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([data.cast(pa.binary())], names=["v"])
        give_back()

    kept = store(docs.select("text").mapInArrow(vectors, "v binary"))

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="u1").reshape(-1, CELLS)
            for at in range(0, len(rows), 4096):
                yield rows[at : at + 4096]

    def summed(label) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sums of vectors by label; each task passes on its own sums, of ``TOPICS`` rows."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(TOPICS, dtype=np.int64), np.zeros((TOPICS, CELLS), dtype=np.int64)
            for rows in levels(batches):
                of = label(rows)
                n += np.bincount(of, minlength=TOPICS)
                total += ((of == np.arange(TOPICS)[:, None]).astype(float) @ rows.astype(float)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()]), pa.array([total.tobytes()])], names=["n", "v"])

        got = kept.mapInArrow(add, "n binary, v binary").collect()
        n = sum((np.frombuffer(r["n"], dtype=np.int64) for r in got), np.zeros(TOPICS, dtype=np.int64))
        return n, sum((np.frombuffer(r["v"], dtype=np.int64) for r in got), np.zeros(TOPICS * CELLS, dtype=np.int64)).reshape(TOPICS, CELLS)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(CELLS), np.zeros((CELLS, CELLS))  # whole numbers below 2^53
        for rows in levels(batches):
            x = rows.astype(float)
            n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.append(total, gram).tobytes()])], names=["n", "v"])

    got = kept.mapInArrow(products, "n long, v binary").toLocalIterator()  # a task's half megabyte at a time
    n, flat = 0, np.zeros(CELLS + CELLS * CELLS)
    for r in got:
        n, flat = n + r["n"], flat + np.frombuffer(r["v"])
    if not n:
        return np.zeros((TOPICS, CELLS), dtype=np.float32)
    mean = flat[:CELLS] / n
    main = np.linalg.eigh(flat[CELLS:].reshape(CELLS, CELLS) / n - np.outer(mean, mean))[1][:, : -1 - DIRECTIONS : -1]
    main = np.rint(main * np.sign(main[np.abs(main).argmax(0), np.arange(DIRECTIONS)]) * 4096)  # rounded, so that reruns agree
    limit = mean @ main
    counts, sums = summed(lambda rows: ((rows.astype(float) @ main > limit) * (1 << np.arange(DIRECTIONS))).sum(1))
    for _ in range(TOPIC_ROUNDS):
        centres = sums / np.maximum(1, counts)[:, None]
        before = sums
        counts, sums = summed(lambda rows, c=centres: nearest_of(rows, c))
        if (before == sums).all():
            break
    return (sums / np.maximum(1, counts)[:, None] / 255).astype(np.float32)


class Model:
    """Count tables and attention weights over ``ids`` subword ids."""

    def __init__(self, class_of: np.ndarray, starts: np.ndarray, table: np.ndarray, ends: np.ndarray, odds: np.ndarray | None = None, prior: np.ndarray | None = None, seed: int = 0):
        """starts[id], ends[id]: words that start, end with an id; table[class before, id]: neighbours inside words;
        odds[id, topic]: log odds of topics at an id; prior[topic]: shares of topics."""
        ids, self.class_of = len(class_of), class_of
        self.context = np.append(class_of, CLASSES).astype(np.int64)  # the last one is a start's
        self.odds = np.concatenate([np.zeros((ids, TOPICS)) if odds is None else odds, np.zeros((1, TOPICS))]).astype(np.float32)  # the last row is a start
        prior = np.full(TOPICS, 1.0) if prior is None else prior + 1e-6
        total = starts + table.sum(0)
        share = (total + 0.05) / (total + 0.05).sum()
        # Rows are the class before, inside a word, and CLASSES at a word's first id.
        table = np.concatenate([table, (starts + 0.05 * share)[None]])
        stop = np.bincount(class_of, weights=ends, minlength=CLASSES)
        go = table[:CLASSES].sum(1)
        self.log_stop, self.log_go = np.log((stop + 0.5) / (stop + go + 1)), np.log((go + 0.5) / (stop + go + 1))
        mass = np.bincount(class_of, weights=share, minlength=CLASSES)
        within = share / mass[class_of]
        sums = np.stack([np.bincount(class_of, weights=row, minlength=CLASSES) for row in table])
        self.log_within = np.log((table + 2.0 * within) / (sums[:, class_of] + 2.0)).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.log_class = np.log((sums + 5.0 * mass) / (sums.sum(1, keepdims=True) + 5.0)).astype(np.float32)
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (rng.normal(size=shape) * 0.05).astype(np.float32)

        # At first each place weighs the odds of the ids before it alike.
        passed = np.eye(TOPICS, WIDTH, dtype=np.float32)
        values = np.concatenate([normal(WIDTH, 2 * WIDTH), np.eye(WIDTH, dtype=np.float32)], axis=1)
        self.weights = {"class": normal(CLASSES + 1, WIDTH), "id": normal(HASHED, WIDTH), "place": normal(CONTEXT, WIDTH), "odds": passed.copy(), "qkv": values, "mix": np.eye(WIDTH, dtype=np.float32),
                        "out": np.zeros((WIDTH, CLASSES), dtype=np.float32), "topic": 2 * passed.T.copy(), "prior": np.log(prior / prior.sum()).astype(np.float32)}
        self.causal = np.where(np.tril(np.ones((CONTEXT, CONTEXT), dtype=bool)), 0, -1e9).astype(np.float32)
        self.scale = np.repeat(np.float32([WIDTH**-0.5, 1, 1]), WIDTH)  # of queries, keys and values

    def context_class(self, ids: np.ndarray) -> np.ndarray:
        """Classes of ids; -1, the start of a text, has its own."""
        return self.context.take(ids)

    def forward(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """States of windows of ids (n x CONTEXT), each from the ids up to its place."""
        w, classes = self.weights, self.context_class(ids)
        odds = self.odds.take(ids, axis=0)
        x = (odds.reshape(-1, TOPICS) @ w["odds"]).reshape(*ids.shape, WIDTH)
        x += w["class"].take(classes, axis=0)
        x += w["id"].take(ids & (HASHED - 1), axis=0)
        x += w["place"]
        # Queries are scaled along with their weights; a column of ones after the values brings the sums along.
        qkv = (x.reshape(-1, WIDTH) @ np.append(w["qkv"] * self.scale, np.zeros((WIDTH, 1), dtype=np.float32), axis=1)).reshape(len(ids), CONTEXT, 3 * WIDTH + 1)
        qkv[:, :, 3 * WIDTH] = 1
        q, k, v = qkv[:, :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
        a = q @ k.transpose(0, 2, 1)
        a += self.causal
        if a.size and a.max() > 60:  # else exponentials stay in range as they are
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        seen = a @ v
        total = seen[:, :, WIDTH:]
        seen = seen[:, :, :WIDTH] / total
        return {"classes": classes, "odds": odds, "x": x, "q": q, "k": k, "v": v, "a": a, "total": total, "seen": seen, "h": x + (seen.reshape(-1, WIDTH) @ w["mix"]).reshape(x.shape)}

    def _class_logits(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        logits = h @ self.weights["out"]
        apart = logits.size and max(logits.max(), -logits.min()) > 60
        logits += self.log_class.take(row, axis=0)
        if apart:  # else exponentials and their sums stay in range as they are
            logits -= logits.max(1, keepdims=True)
        return logits

    def class_probs(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Probabilities of the classes of the next id from states and table rows."""
        logits = self._class_logits(h, row)
        np.exp(logits, out=logits)
        logits /= (logits @ np.ones(CLASSES, dtype=logits.dtype))[:, None]
        return logits

    def log_probs(self, h: np.ndarray, row: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target id from states and table rows."""
        logits = self._class_logits(h, row)
        hit = logits[np.arange(len(target)), self.class_of[target]]
        np.exp(logits, out=logits)
        return hit - np.log(logits @ np.ones(CLASSES, dtype=logits.dtype)) + self.log_within[row, target]

    def topics(self, h: np.ndarray) -> np.ndarray:
        """Probabilities of the topics from states."""
        logits = self.weights["topic"].T @ h.T  # a row a topic: sums over rows are fast
        logits += self.weights["prior"][:, None]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits.T

    def inputs(self) -> tuple[np.ndarray, ...]:
        """Parts of [key, value, 1] and of [state, query], by id (the last row is a start) and by place; values are mixed already."""
        w, ids = self.weights, np.append(np.arange(len(self.class_of)), -1)
        x = self.odds @ w["odds"] + w["class"][self.context_class(ids)] + w["id"][ids & (HASHED - 1)]
        parts = []
        for x, one in ((x, 1), (w["place"], 0)):
            q, k, v = np.split(x @ w["qkv"] * self.scale, 3, axis=1)
            parts += [np.concatenate([k, v @ w["mix"], np.full((len(x), 1), one)], axis=1, dtype=np.float32), np.concatenate([x, q], axis=1, dtype=np.float32)]
        return tuple(parts)

    def score(self, docs: list[np.ndarray], first: list[np.ndarray], asked: list[np.ndarray], batch: int = 512, inputs: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of sequences of ids: natural log probability of each id that is asked for (0 for others), one after the other, and
        the topics' probabilities at each word (``first`` marks the ids that begin one) and at each sequence's end.

        ``inputs`` are the model's own, for callers that score many times."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        spots = sizes + 1  # places: after a -1 and after each id
        starts = np.cumsum(spots) - spots
        stream = np.full(int(spots.sum()), -1, dtype=np.int64)
        inner = np.ones(stream.size, dtype=bool)
        inner[starts] = False
        if sizes.sum():
            stream[inner] = np.concatenate(docs)
        last = np.zeros(stream.size, dtype=bool)
        last[starts + sizes] = True
        word, want = last.copy(), np.zeros(stream.size, dtype=bool)
        if sizes.sum():
            word[~last], want[~last] = np.concatenate(first), np.concatenate(asked)
        target = np.append(stream[1:], -1)
        log_p, post = np.zeros(stream.size), np.zeros((int(word.sum()), TOPICS), dtype=np.float32)
        number = np.cumsum(word) - 1
        # What an id and a place each add to keys, values and a column of ones, whose sums come along, and to states and queries.
        keys_of, states_of, keys_at, states_at = inputs or self.inputs()
        need = word | want
        windows = 1 + -(-np.maximum(0, spots - CONTEXT) // STRIDE)
        doc = np.repeat(np.arange(len(docs)), windows)
        nth = np.arange(doc.size) - np.repeat(np.cumsum(windows) - windows, windows)
        # A text's first window is asked for all its places, others for those that no window before them holds.
        for some, low in ((np.flatnonzero(nth == 0), 0), (np.flatnonzero(nth), CONTEXT - STRIDE)):
            for at in range(0, some.size, batch):
                of = some[at : at + batch]
                begin, end = starts[doc[of]] + nth[of] * STRIDE, starts[doc[of]] + spots[doc[of]]
                where = begin[:, None] + np.arange(CONTEXT)
                held = stream.take(where, mode="clip")
                x = keys_of.take(held, axis=0)
                x += keys_at
                h = states_of.take(held[:, low:], axis=0)
                h += states_at[low:]
                a = h[:, :, WIDTH:] @ x[:, :, :WIDTH].transpose(0, 2, 1)
                a += self.causal[low:]
                if a.size and a.max() > 60:  # else exponentials stay in range as they are
                    a -= a.max(2, keepdims=True)
                np.exp(a, out=a)
                seen = a @ x[:, :, WIDTH:]
                # The places that are a window's own and asked for something.
                where = where[:, low:]
                of = np.flatnonzero((where < end[:, None]) & need.take(where, mode="clip"))
                to, h, seen = where.ravel().take(of), h.reshape(-1, 2 * WIDTH).take(of, axis=0)[:, :WIDTH], seen.reshape(-1, WIDTH + 1).take(of, axis=0)
                h = h + seen[:, :WIDTH] / seen[:, WIDTH:]
                of = np.flatnonzero(word.take(to))
                post[number[to.take(of)]] = self.topics(h.take(of, axis=0))
                of = np.flatnonzero(want.take(to))
                to = to.take(of)
                log_p[to] = self.log_probs(h.take(of, axis=0), np.where(word.take(to), CLASSES, self.context_class(stream.take(to))), target.take(to))
        return log_p[~last], post

    def train(self, batches: Iterator[np.ndarray], rate: float = RATE) -> None:
        """One pass of Adam over batches of windows (see ``training_windows``)."""
        names = sorted(self.weights)
        flat = np.concatenate([self.weights[k].ravel() for k in names])
        self._set_flat(flat)
        m, s = np.zeros_like(flat), np.zeros_like(flat)
        for t, rows in enumerate(batches, 1):
            found = self.gradients(rows)
            g = np.concatenate([found[k].ravel() for k in names])
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            flat -= np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-6))

    def _set_flat(self, flat: np.ndarray) -> None:
        """Take the weights, one after the other by name, as views."""
        at = 0
        for name in sorted(self.weights):
            size = self.weights[name].size
            self.weights[name] = flat[at : at + size].reshape(self.weights[name].shape)
            at += size

    def loss(self, rows: np.ndarray) -> float:
        """Mean negative log probability of the topics at all targets and of the ids of words that aren't common."""
        ids, topic, known, first, spelled, target = self._targets(rows)
        s = self.forward(ids)
        own = self.topics(s["h"][known])[np.arange(int(known.sum())), np.repeat(topic, known.sum(1))]
        row = np.where(first, CLASSES, s["classes"])
        return float(-np.log(own).mean() - self.log_probs(s["h"][spelled], row[spelled], target[spelled]).sum() / max(1, known.sum()))

    def _targets(self, rows: np.ndarray):
        """Ids before, topics, and of the targets: which there are, which begin a word, which are spelled, ids."""
        marked = rows[:, :-1]
        ids, target = np.where(marked < 0, -1, marked & (FIRST - 1)), np.ascontiguousarray(marked[:, 1:])
        known = target >= 0
        return ids[:, :-1], rows[:, -1], known, target & FIRST > 0, known & (target & RARE > 0), ids[:, 1:]

    def gradients(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of ``loss``."""
        w = self.weights
        ids, topic, known, first, spelled, target = self._targets(rows)
        share = np.float32(1 / max(1, int(known.sum())))
        s = self.forward(ids)
        h, grads = s["h"].reshape(-1, WIDTH), {}
        p = self.topics(h).T  # a row a topic
        p.reshape(TOPICS, -1, CONTEXT)[topic, np.arange(len(ids))] -= 1
        p *= known.ravel() * share
        grads["topic"], grads["prior"] = (p @ h).T, p.sum(1)
        flat = p.T @ w["topic"].T
        of = np.flatnonzero(spelled)
        h, to = h.take(of, axis=0), self.class_of.take(target.take(of))
        p = self.class_probs(h, np.where(first.take(of), CLASSES, s["classes"].take(of)))
        p.reshape(-1)[np.arange(len(p)) * CLASSES + to] -= 1
        h *= share
        grads["out"] = h.T @ p
        flat[of] += p @ (w["out"].T * share)
        dh = flat.reshape(s["h"].shape)
        grads["mix"] = s["seen"].reshape(-1, WIDTH).T @ flat
        # Sums divide the rows of dseen rather than the attention itself. The softmax's weighted mean of da is that of v, which
        # seen is; it is taken off along the column of ones.
        dseen, back = np.empty(s["v"].shape, dtype=flat.dtype), flat @ w["mix"].T
        np.divide(back.reshape(dh.shape), s["total"], out=dseen[:, :, :WIDTH])
        back *= s["seen"].reshape(-1, WIDTH)
        np.divide((back @ np.full(WIDTH, -1, dtype=back.dtype)).reshape(ids.shape), s["total"][:, :, 0], out=dseen[:, :, WIDTH])
        da = dseen @ s["v"].transpose(0, 2, 1)
        da *= s["a"]
        dqkv = np.empty((*ids.shape, 3 * WIDTH), dtype=flat.dtype)
        np.matmul(da, s["k"], out=dqkv[:, :, :WIDTH])
        np.matmul(da.transpose(0, 2, 1), s["q"], out=dqkv[:, :, WIDTH : 2 * WIDTH])
        np.matmul(s["a"].transpose(0, 2, 1), dseen[:, :, :WIDTH], out=dqkv[:, :, 2 * WIDTH :])
        dqkv = dqkv.reshape(-1, 3 * WIDTH)
        grads["qkv"] = (s["x"].reshape(-1, WIDTH).T @ dqkv) * self.scale
        dx = dqkv @ (w["qkv"] * self.scale).T
        dx += flat
        grads["place"] = dx.reshape(-1, CONTEXT * WIDTH).sum(0).reshape(CONTEXT, WIDTH)
        grads["odds"] = s["odds"].reshape(-1, TOPICS).T @ dx
        for name, index in (("class", s["classes"]), ("id", ids & (HASHED - 1))):
            at = index.ravel() + (np.arange(WIDTH) * len(w[name]))[:, None]
            grads[name] = np.bincount(at.ravel(), weights=dx.T.ravel(), minlength=w[name].size).reshape(WIDTH, -1).T.astype(dx.dtype)
        return grads


def count_words(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """word, c and t0.. (c by topic) over (text) of all rows, ``END`` once a text; tasks count first and pass on their counts
    before they grow large."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ends = _Words(), np.zeros(TOPICS, dtype=np.int64)
        counts = np.zeros((0, TOPICS), dtype=np.int64)

        def flush() -> pa.RecordBatch:
            words = pa.array([*known.rows, END], type=pa.binary())
            row, z = np.nonzero(np.concatenate([counts, ends[None]]))
            n = np.concatenate([counts, ends[None]])[row, z]
            return pa.RecordBatch.from_arrays([words.take(pa.array(row)), pa.array(z.astype(np.int32)), pa.array(n)], names=["word", "z", "c"])

        for part in (p for batch in batches for p in in_pieces(batch, 0, PIECE_BYTES)):
            if len(known.rows) > LEXICON_WORDS:
                yield flush()
                known, counts, ends = _Words(), counts[:0], np.zeros_like(ends)
            rows, sizes = known.find(part.column(0))
            topics = nearest_topic(topic_vectors(known.cell[rows], sizes), centres)
            ends += np.bincount(topics, minlength=TOPICS)
            counts = np.concatenate([counts, np.zeros((len(known.rows) - len(counts), TOPICS), dtype=np.int64)])
            counts += np.bincount(rows * TOPICS + np.repeat(topics, sizes), minlength=counts.size).reshape(counts.shape)
        yield flush()
        del known, counts
        give_back()

    rows = docs.select("text").mapInArrow(count, "word binary, z int, c long").groupBy("word")
    return rows.agg(F.sum("c").alias("c"), *[F.coalesce(F.sum(F.when(F.col("z") == k, F.col("c"))), F.lit(0)).alias(f"t{k}") for k in range(TOPICS)])


def count_pairs(words: DataFrame, ranks_path: str) -> DataFrame:
    """(before, id, n, t0..) of the ids within words; before is -1 at a word's start, id is -1 at its end. n counts distinct
    words, t all words by topic."""
    names = [f"t{k}" for k in range(TOPICS)]

    def merged(held: list[np.ndarray]) -> np.ndarray:
        """One row a pair: its key, n, t0.."""
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows[:, 0])]
        begin = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        out = np.add.reduceat(rows, begin, axis=0) if begin.size else rows
        out[:, 0] = rows[begin, 0]
        return out

    def columns(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in ((rows[:, 0] >> 32) - 1, (rows[:, 0] & 0xFFFFFFFF) - 1, *rows[:, 1:].T)], names=["before", "id", "n", *names])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, 2 + TOPICS), dtype=np.int64)]
        for batch in batches:
            words, by_topic = batch.column(0).to_pylist(), np.stack([batch.column(1 + k).to_numpy() for k in range(TOPICS)])
            for at in range(0, len(words), 20_000):
                ids, size = spell_words(ranks_path, words[at : at + 20_000])
                size = size + 1
                flat = np.insert(ids, np.cumsum(size - 1), -1)
                before = np.concatenate(([-1], flat[:-1]))
                keys, place = np.unique((before + 1) << 32 | (flat + 1), return_inverse=True)
                sums = [np.bincount(place, weights=np.repeat(t[at : at + 20_000], size), minlength=len(keys)).astype(np.int64) for t in by_topic]
                held.append(np.stack([keys, np.bincount(place, minlength=len(keys)), *sums], axis=1))
            if sum(map(len, held)) > PAIR_ROWS:
                held = [merged(held)]
                if 2 * len(held[0]) > PAIR_ROWS:
                    yield columns(held.pop())
        if held:
            yield columns(merged(held))
        del held
        give_back()

    kind = "before long, id long, n long, " + ", ".join(f"{t} long" for t in names)
    found = words.filter(F.col("word") != F.lit(END)).select("word", *names).mapInArrow(pairs, kind)
    return found.groupBy("before", "id").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def clusters(near, size: int, seed: int) -> np.ndarray:
    """A class for each id: ids with like neighbours on both sides share one (k-means on signed sums); unseen ids the last."""
    features, mass = np.zeros((size, 2 * SIGNS)), np.zeros(size)
    of, side, n = near["_of"].to_numpy(), near["side"].to_numpy(), near["n"].to_numpy(dtype=float)
    sums = near[[f"s{k}" for k in range(SIGNS)]].to_numpy(dtype=float)
    for k in (0, 1):
        at = of[side == k]
        features[at, k * SIGNS : (k + 1) * SIGNS] = sums[side == k] / np.sqrt(n[side == k, None] * n[side == k, None].clip(min=20))
        np.maximum.at(mass, at, n[side == k])
    seen = np.flatnonzero(mass)
    out = np.full(size, CLASSES - 1, dtype=np.int32)
    if seen.size:
        x, w = features[seen], np.sqrt(mass[seen])
        centres = x[np.argsort(-w, kind="stable")[: CLASSES - 1]].copy()
        for _ in range(12):  # Lloyd's rounds
            label = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            total = np.bincount(label, weights=w, minlength=len(centres))
            for k in np.flatnonzero(total):
                centres[k] = (x[label == k] * w[label == k, None]).sum(0) / total[k]
        out[seen] = label
    return out


def fit(docs: DataFrame, words: DataFrame, by_topic: list[int], centres: np.ndarray, common, ranks_path: str, seed: int = 0) -> Model:
    """Count tables from all training words, then weights from all windows of all training texts (doc_id, text).

    ``by_topic`` are the tokens of each topic, ``common`` is a broadcast of the sorted hashes of common words.
    """
    spark = docs.sparkSession
    size = subword_encoder(ranks_path).n_vocab
    pairs = store(count_pairs(words, ranks_path))
    # Bounded by the vocabulary: counts at words' ends, topics at ids, and a sum of random signs over each id's neighbours.
    starts, ends = np.zeros(size), np.zeros(size)
    for side, key, other in ((starts, "id", "before"), (ends, "before", "id")):
        found = pairs.filter(f"{other} < 0 AND {key} >= 0").select(key, "n").toArrow()
        side[found[key].to_numpy()] = found["n"].to_numpy()
    topics = pairs.filter("id >= 0").groupBy("id").agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(TOPICS)]).toArrow()
    seen = np.zeros((size, TOPICS))
    seen[topics["id"].to_numpy()] = np.stack([topics[f"t{k}"].to_numpy() for k in range(TOPICS)], axis=1)
    prior = (np.array(by_topic, dtype=float) + 1e-3) / (sum(by_topic) + 1e-3 * TOPICS)
    odds = np.clip(np.log((seen + 20 * prior) / (seen.sum(1, keepdims=True) + 20) / prior), -4, 4)
    signs = [F.when(F.xxhash64(F.lit(k), F.col("_to")) % 2 == 0, F.col("n")).otherwise(-F.col("n")) for k in range(SIGNS)]
    near = pairs.selectExpr("id AS _of", "before AS _to", "0 AS side", "n").unionByName(pairs.selectExpr("before AS _of", "id AS _to", "1 AS side", "n")).filter("_of >= 0")
    near = near.groupBy("_of", "side").agg(F.sum("n").alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(signs)]).orderBy("_of", "side").toArrow().to_pandas()
    class_of = clusters(near, size, seed)
    of = spark.sparkContext.broadcast(class_of)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(of.value[batch.column(0).to_numpy()].astype(np.int64)), batch.column(1), batch.column(2)], names=["before", "id", "n"])

    rows = pairs.filter("before >= 0 AND id >= 0").select("before", "id", "n").mapInArrow(by_class, "before long, id long, n long").groupBy("before", "id").agg(F.sum("n").alias("n"))
    counted = rows.toArrow()  # at most CLASSES rows an id
    table = np.zeros((CLASSES, size))
    table[counted["before"].to_numpy(), counted["id"].to_numpy()] = counted["n"].to_numpy()
    return train(docs, Model(class_of, starts, table, ends, odds, prior, seed), centres, common, ranks_path, sum(by_topic))


class _Lexicon(_Words):
    """Words with their ids, hashes, places in a table of sorted hashes (-1: not there) and cells."""

    fields = ("start", "width", "place", "hash", "cell")

    def __init__(self, ranks_path: str, hashes: np.ndarray):
        super().__init__()
        self.ranks_path, self.hashes, self.ids = ranks_path, hashes, np.zeros(0, dtype=np.int64)

    def learn(self, words: list[bytes]) -> dict[str, np.ndarray]:
        import xxhash

        found, width = spell_words(self.ranks_path, words)
        start = self.ids.size + np.cumsum(width) - width
        self.ids = np.concatenate([self.ids, found])
        h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(_HASH_SEED)), dtype=np.uint64, count=len(words)).view(np.int64)
        return {**super().learn(words), "start": start, "width": width, "place": self.look_up(h), "hash": h}

    def forget(self) -> None:
        super().forget()
        self.ids, _, offset = self.spell(np.arange(len(self.rows)))
        self.start = offset

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes in the table, -1 for those that aren't there."""
        at = np.searchsorted(self.hashes, hashes)
        known = at < self.hashes.size
        known[known] = self.hashes[at[known]] == hashes[known]
        return np.where(known, at, -1)

    def find_pieces(self, batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of ``SCORED_BYTES`` of a batch's texts with what ``find`` says of them; words are looked up in larger pieces."""
        for piece in in_pieces(batch, column, PIECE_BYTES):
            rows, sizes = self.find(piece.column(column))
            text, word = 0, 0
            for part in in_pieces(piece, column, SCORED_BYTES):
                own = sizes[text : text + part.num_rows]
                yield part, rows[word : word + int(own.sum())], own
                text, word = text + part.num_rows, word + int(own.sum())

    def spell(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, one after the other; how many of each, and where each one's start."""
        width = self.width[rows]
        offset = np.cumsum(width) - width
        return self.ids[np.repeat(self.start[rows] - offset, width) + np.arange(int(width.sum()))], width, offset


_lexicons: dict[str, _Lexicon] = kept({})


def worker_lexicon(ranks_path: str, hashes: np.ndarray) -> _Lexicon:
    """The words that this worker knows from its tasks before, with their places in a table of sorted hashes."""
    if ranks_path not in _lexicons:
        _lexicons.clear()
        _lexicons[ranks_path] = _Lexicon(ranks_path, hashes)
    lexicon = _lexicons[ranks_path]
    if lexicon.hashes is not hashes:
        lexicon.hashes = hashes
        lexicon.place = lexicon.look_up(lexicon.hash)
    return lexicon


def training_windows(ids: np.ndarray, topic: int) -> np.ndarray:
    """Windows (n x CONTEXT + 2: ids with marks, the first one being context alone, and the topic) that hold every id of a
    text once as a target; -1 is the start, -2 fills the last one."""
    n = -(-len(ids) // CONTEXT)
    flat = np.full(n * CONTEXT + 1, -2, dtype=np.int64)
    flat[0], flat[1 : 1 + len(ids)] = -1, ids
    rows = flat[np.arange(n)[:, None] * CONTEXT + np.arange(CONTEXT + 1)]
    return np.concatenate([rows, np.full((n, 1), topic)], axis=1)


def train(docs: DataFrame, model: Model, centres: np.ndarray, common, ranks_path: str, tokens: int) -> Model:
    """One pass over all windows in parallel; the trainers' weights are averaged. Reruns give the same weights."""
    sc = docs.sparkSession.sparkContext

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(_lexicons)
        lexicon = worker_lexicon(ranks_path, common.value)
        for batch in batches:
            for part in in_pieces(batch, 1, PIECE_BYTES):
                doc_ids = part.column(0).to_pylist()
                rows, sizes = lexicon.find(part.column(1))
                topics = nearest_topic(topic_vectors(lexicon.cell[rows], sizes), centres)
                ids, width, offset = lexicon.spell(rows)
                ids |= np.repeat(np.where(lexicon.place[rows] < 0, RARE, 0), width)
                ids[offset] |= FIRST
                cuts = np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=width, minlength=len(sizes)).astype(np.int64))[:-1]
                found = [training_windows(x, z) for x, z in zip(np.split(ids, cuts), topics.tolist(), strict=True)]
                rows = np.concatenate(found).astype("<i4")
                # Copies of a window are dealt apart by their document and place.
                keys = [hash((doc_id or 0, at)) for doc_id, x in zip(doc_ids, found, strict=True) for at in range(len(x))]
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * 4), len(rows), [None, pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), data.cast(pa.binary())], names=["k", "w"])
        give_back()

    trainers = max(1, min(MAX_TRAINERS, 2 * tokens // CONTEXT // TRAINER_WINDOWS))
    dealt = docs.select("doc_id", "text").mapInArrow(windows, "k long, w binary").repartition(trainers, F.xxhash64("k")).sortWithinPartitions("k", "w").select("w")
    held = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        own, seen = copy.copy(held.value), [0]
        own.weights = {name: w.copy() for name, w in own.weights.items()}

        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i4").reshape(-1, CONTEXT + 2).astype(np.int64)
                seen[0] += len(rows)
                for at in range(0, len(rows), TRAIN_BATCH):
                    yield rows[at : at + TRAIN_BATCH]

        own.train(parts())
        if seen[0]:
            flat = np.concatenate([own.weights[name].ravel() for name in sorted(own.weights)]).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([seen[0]]), pa.array([flat.tobytes()])], names=["n", "w"])

    got = dealt.mapInArrow(run, "n long, w binary").collect()  # one row a trainer, 80 KB each
    if not got:
        return model
    total = sum(r["n"] for r in got)
    flat = sum(np.frombuffer(r["w"], dtype="<f4") * np.float32(r["n"] / total) for r in sorted(got, key=lambda r: (r["n"], r["w"])))
    model._set_flat(flat)
    return model


_heads: dict[str, tuple[np.ndarray, np.ndarray]] = kept({})


def head_counts(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the head's words and their counts, overall and by topic; a worker reads them once."""
    if folder not in _heads:
        import pyarrow.dataset as ds

        fs, root = open_fs(folder)
        data = ds.dataset(root, filesystem=fs, format="parquet")
        hashes = data.to_table(["h"]).column(0).to_numpy()
        order = np.argsort(hashes)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        counts = np.empty((len(order), 1 + TOPICS), dtype=np.uint32 if data.schema.field("c").type == pa.int32() else np.int64)
        # A column at a time: the whole table would take as much again as what is kept.
        for k, name in enumerate(data.schema.names[1:]):
            counts[place, k] = data.to_table([name]).column(0).to_numpy()
        _heads.clear()
        _heads[folder] = hashes[order], counts
        del hashes, order, place
        give_back()
    return _heads[folder]


def score_texts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: the held-out mark, counts, the add-one unigram base and the model's log10 probability.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and empty texts are one end token.
    Documents without an id are training documents; rows with one id are scored one by one. Without training documents
    the base is 0 and the model has no counts. An empty table gives an empty result; other columns are left out. Reruns on
    the same rows give the same scores up to rounding.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    base = base.withColumn("held_out", held)
    training = base.filter(~F.col("held_out"))
    centres = fit_topics(training)
    words = store(count_words(training, centres))
    topics = [f"t{k}" for k in range(TOPICS)]
    found = words.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(t), F.lit(0)) for t in topics]).collect()[0]
    kinds, by_topic = int(found[0]), [int(x) for x in found[1:]]
    tokens = sum(by_topic)
    ended = words.filter(F.col("word") == F.lit(END)).select("c", *topics).collect()
    end_counts = np.array(ended[0], dtype=float) if ended else np.zeros(1 + TOPICS)

    # Counts of counts, a small table: the least counts such that the words with them and above are at most so many.
    once, room, least, full = {1: 0, 2: 0}, [HEAD_WORDS, COMMON_WORDS], [1 << 62, 1 << 62], [False, False]
    for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toLocalIterator():
        for k in (0, 1):
            full[k] = full[k] or r["n"] > room[k]
            room[k], least[k] = (room[k], least[k]) if full[k] else (room[k] - r["n"], r["c"])
        if r["c"] in once:
            once[r["c"]] = r["n"]
    discount = (once[1] + 0.1) / (once[1] + 2 * once[2] + 0.2)
    new = math.log(min(1.0, discount * kinds / tokens) if tokens else 1.0)
    by_hash = store(words.select(F.xxhash64("word").alias("h"), "c", *topics).groupBy("h").agg(*[F.sum(x).alias(x) for x in ("c", *topics)]))
    folder = f"{shared_dir(spark)}/head-{uuid.uuid4().hex}"
    kind = "int" if tokens < 1 << 31 else "long"
    by_hash.filter(F.col("c") >= least[0]).select("h", *[F.col(x).cast(kind) for x in ("c", *topics)]).write.parquet(folder)
    often = by_hash.filter(F.col("c") >= max(COMMON, least[1])).select("h").orderBy("h").toArrow()
    common = spark.sparkContext.broadcast(often["h"].to_numpy())
    model = spark.sparkContext.broadcast(fit(training, words, by_topic, centres, common, ranks_path))
    per_topic = (1 - LEAK) / np.maximum(1, by_topic)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make_room(_heads, _lexicons)
        lm, (hashes, counted) = model.value, head_counts(folder)
        inputs = lm.inputs()
        lexicon, row = worker_lexicon(ranks_path, hashes), TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "score", "tail", "spelled", "post"]
        for batch in batches:
            for part, rows, sizes in lexicon.find_pieces(batch, 1):
                flat, width, offset = lexicon.spell(rows)
                begins = np.zeros(flat.size, dtype=bool)
                begins[offset] = True
                # What going on and ending add to a word's letters.
                joints = lm.log_go[lm.class_of[flat]]
                joints[offset + width - 1] = lm.log_stop[lm.class_of[flat[offset + width - 1]]]
                # Words with each text's end as its last one.
                last = np.cumsum(sizes + 1) - 1
                word = np.ones(int((sizes + 1).sum()), dtype=bool)
                word[last] = False
                at = np.full(word.size, 0 if tokens else -1, dtype=np.int64)
                at[word] = lexicon.place[rows]
                c = counted.take(at, axis=0, mode="clip") if len(counted) else np.zeros((at.size, 1 + TOPICS))
                c[at < 0] = 0
                c[last] = end_counts
                c, n_of = c[:, 1:].astype(np.float32), c[:, 0].astype(float)
                rare = n_of < COMMON
                rare[last] = False
                cuts = np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=width, minlength=len(sizes)).astype(np.int64))[:-1]
                by_id, post = lm.score(np.split(flat, cuts), np.split(begins, cuts), np.split(np.repeat(rare[word], width), cuts), inputs=inputs)
                spelled = np.full(word.size, -np.inf)
                if flat.size:
                    spelled[word] = np.add.reduceat(by_id + joints, offset) + new
                spelled[~rare] = -np.inf
                spelled[last[at[last] < 0]] = 0.0  # without training texts an end is certain
                kept = 1 - discount / np.maximum(n_of, 1)
                c *= post
                mixed = (c @ per_topic.astype(np.float32)) * kept + LEAK * np.maximum(n_of - discount, 0) / max(1, tokens)
                with np.errstate(divide="ignore"):
                    by_word = np.logaddexp(spelled, np.log(mixed))
                scores = np.add.reduceat(by_word, last - sizes) / LOG10
                in_head, doc = at >= 0, np.repeat(np.arange(len(sizes)), sizes + 1)
                known = np.bincount(doc, weights=in_head, minlength=len(sizes)).astype(np.int64)
                logs = np.bincount(doc, weights=np.log10(n_of + 1), minlength=len(sizes))
                out = ~in_head & word
                offsets = pa.array(np.searchsorted(np.flatnonzero(out), np.concatenate((last - sizes, [word.size]))), type=pa.int32())
                h = lexicon.hash[rows][out[word]]
                every = pa.ListArray.from_arrays(pa.array(np.arange(int(out.sum()) + 1) * TOPICS, type=pa.int32()), pa.array(post[out].ravel()))
                lists_of = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(h), pa.array(spelled[out]), every)]
                columns = [pa.array(row + np.arange(len(sizes))), part.column(0), part.column(2), pa.array(sizes + 1), pa.array(known), pa.array(logs), pa.array(scores), *lists_of]
                row += len(sizes)
                yield pa.RecordBatch.from_arrays(columns, names=names)
                del columns, lists_of, every, c, post, mixed, by_id
                give_back()

    kind = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, score double, tail array<long>, spelled array<double>, post array<array<float>>"
    scored = store(base.select("doc_id", "text", "held_out").mapInArrow(score, kind))
    asked = scored.select(F.col("row").alias("_row"), F.explode(F.arrays_zip("tail", "spelled", "post")).alias("w")).select("_row", F.col("w.tail").alias("_h"), F.col("w.spelled").alias("_s"), F.col("w.post").alias("_p"))
    met = asked.join(by_hash.filter(F.col("c") < least[0]), F.col("_h") == F.col("h"))
    c = F.col("c")
    mix = sum((F.col("_p")[k] * float(per_topic[k]) * F.col(t) for k, t in enumerate(topics)), F.lit(0.0)) * (1 - discount / c) + LEAK * (c - discount) / max(1, tokens)
    # What the counts add to the log probability of the spelled word; beyond 30 the exponential alone counts.
    over = F.log(mix) - F.col("_s")
    gain = F.when((c >= COMMON) | (over > 30), over).otherwise(F.log1p(F.exp(F.least(over, F.lit(30.0)))))
    sums = met.groupBy("_row").agg(F.sum(F.log10(c + 1)).alias("tail_log"), F.count(F.lit(1)).alias("tail_known"), F.sum(gain).alias("tail_gain"))
    joined = scored.drop("tail", "spelled", "post").join(bounded(store(sums), 40), F.col("row") == F.col("_row"), "left")
    per_token = math.log10(tokens + kinds + 1)
    log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * per_token
    n_known = F.col("head_known") + F.coalesce("tail_known", F.lit(0))
    return joined.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), log.alias("base_score"), (F.col("score") + F.coalesce("tail_gain", F.lit(0.0)) / LOG10).alias("score"))
