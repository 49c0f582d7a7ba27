"""Exact token counts of every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

In a BPE encoding the tokens before the last one are the encoding of the bytes before it, and two tokens may stand side by
side if and only if no merge across their border would have come before the merges that made them. So the last token of a
prefix is the one token that ends there and may follow the last token of the prefix before it, and a prefix has one token
more than that. One pass over a piece of a text gives the counts of all its prefixes; no prefix is encoded.

Texts are cut at the texts of added tokens, then into units (a white-space run and the word after it), over whose start no
piece reaches. The counts of a unit's prefixes are the same wherever it stands: a worker keeps them for the units it has
met, up to a bound in bytes. A text's counts are those of its units, each raised by the tokens before it.

They are stored as one difference a code point, and a mark (the count itself) every 1,024 code points. Questions about
lengths and budgets are answered from these alone.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back, store

#: Tokens that a document may have, and code points between marks.
LIMIT, MARK = 1024, 1024

#: Bytes of units and of pieces, each, that a worker keeps, bytes that one takes beside its text and counts, pairs whose
#: standing it remembers, code points from which a unit is long and not kept, and units of a text that are joined at once.
KEEP_BYTES, UNIT_BYTES, KEEP_PAIRS, SMALL, AT_ONCE = 64 << 20, 200, 1 << 18, 64, 1 << 16

#: Counts by code points: bytes where the text has fewer than 256 bytes, else numbers.
Counts = bytes | np.ndarray

_SPACE = r"\p{White_Space}"
_UNITS = regex.compile(rf"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
_GAP = regex.compile(rf"{_SPACE}*")
#: Pieces of a word: contractions first, then runs of one kind, a space before them included.
_PIECES = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+")
#: A contraction that isn't complete yet is two pieces: its apostrophe and a letter.
_BEGUN = ("'r", "'v", "'l")

#: Which bytes begin a code point, and small counts that are raised by some number.
_LEADS = bytes(b & 0xC0 != 0x80 for b in range(256))
_RAISED = [bytes((b + more) & 255 for b in range(256)) for more in range(256)]

_counters: dict[str, "Counter"] = {}


def _wide(counts: Counts, more: int) -> np.ndarray:
    return (np.frombuffer(counts, dtype=np.uint8) if isinstance(counts, bytes) else counts).astype(np.int32) + np.int32(more)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable bytes as they are, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Counter:
    """Counts of all prefixes of texts under one tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model, before = found["model"], found["pre_tokenizer"] or {}
        known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        plain = not (found["normalizer"] or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
        if model["type"] != "BPE" or not plain or any(before.get(k) != v for k, v in known.items()):
            raise ValueError("a byte-level BPE file with the usual pieces is needed")
        added = found["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must stand for their own text alone")
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None

        # Tokens by the order in which they are made: bytes first, then merges.
        letters = _byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = sorted(letters) + [a + b for a, b in merges]
        number = {name: k for k, name in reversed(list(enumerate(names)))}
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(256)] + [(number[a], number[b]) for a, b in merges]
        if len(number) != len(names) or any(max(p) >= k for k, p in enumerate(self.parts) if k >= 256) or any(c not in model["vocab"] for c in letters):
            raise ValueError("merges must build on earlier ones and each make one token")
        self.merged = {p: k for k, p in enumerate(self.parts) if k >= 256}
        self.ends = ahocorasick.Automaton()
        for name, k in number.items():
            self.ends.add_word("".join(chr(letters[c]) for c in name), (k, len(name)))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.piece_bytes = 0
        self.clear()

    def clear(self) -> None:
        """Forget the kept units."""
        self.slots: dict[str, int] = {}
        self.bytes, self.n, self.size = 0, 0, 0
        self.start, self.pool = np.zeros(1024, np.int64), np.zeros(1 << 14, np.uint8)

    def stands(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: taking the two apart, latest merge first, no merge across comes too early."""
        limit = len(self.parts)
        merged, parts = self.merged.get, self.parts
        while True:
            if merged((a, b), limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            if b >= a:  # of two equal ones the right one is made later, and an equal one across would have come first
                limit, b = b + 1, parts[b][0]
            else:
                limit, a = a, parts[a][1]

    def piece(self, text: str) -> Counts:
        """Tokens of each prefix of a piece, by code points from 1 on."""
        kept = self.pieces.get(text)
        if kept is not None:
            return kept
        data = text.encode()
        n, pairs, stands = len(data), self.pairs, self.stands
        small = n < 256
        last, count = ([0] * (n + 1), bytearray(n + 1)) if small else (array("i", bytes(4 * n + 4)), array("i", bytes(4 * n + 4)))
        done = -1
        for end, (token, length) in self.ends.iter(data.decode("latin-1")):
            if end == done:
                continue
            begin = end + 1 - length
            if begin:
                pair = last[begin] << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) > KEEP_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = stands(last[begin], token)
                if not fits:
                    continue
            last[end + 1], count[end + 1], done = token, count[begin] + 1, end
        counts = bytes(count[1:]) if small else np.frombuffer(count, dtype=np.int32)[1:]
        if n != len(text):
            whole = (data[1:] + b"a").translate(_LEADS)  # a code point ends where the next byte begins another
            counts = bytes(compress(counts, whole)) if small else counts[np.frombuffer(whole, dtype=np.uint8) > 0]
        if small:
            if self.piece_bytes > KEEP_BYTES:
                self.pieces, self.piece_bytes = {}, 0
            self.pieces[text] = counts
            self.piece_bytes += UNIT_BYTES + 2 * n
        return counts

    def unit(self, text: str) -> Counts:
        """Tokens of each prefix of a unit, by code points from 1 on.

        While only white space has come, it is one piece; with a word after it, its last character is a piece of its own,
        or leads the word if it is a space.
        """
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.piece(text)
        small = len(text) < SMALL
        gap = _GAP.match(text)[0]
        word = text[len(gap) :]
        out, total = [], 0
        if gap:
            ahead = self.piece(gap)
            if not word:
                return ahead
            out.append(ahead if small else _wide(ahead, 0))
            total = int(ahead[-2]) if len(gap) > 1 else 0
            if gap[-1] == " ":
                word = " " + word
            else:
                total += int(self.piece(gap[-1])[-1])
        led = word[0] == " "
        for piece in _PIECES.findall(word):
            counts = self.piece(piece)
            if len(piece) == 3 and piece[:2] in _BEGUN:
                counts = bytes([counts[0], counts[0] + self.piece(piece[1])[0], counts[2]])
            own = counts[1:] if led else counts
            out.append((own.translate(_RAISED[total]) if total else own) if small else _wide(own, total))
            led = False
            total += int(counts[-1])
        return b"".join(out) if small else np.concatenate(out)

    def _learn(self, units: list[str]) -> list[Counts]:
        """Keep the units' counts; those of long ones are returned, and not kept."""
        found = [(u, self.unit(u)) for u in units if len(u) < SMALL]
        sizes = np.fromiter((len(c) for _, c in found), np.int64, len(found))
        n, size = self.n + len(found), self.size + int(sizes.sum())
        if n >= self.start.size:
            self.start = np.concatenate([self.start, np.zeros(max(n, self.start.size), np.int64)])
        if size > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros(max(size, self.pool.size), np.uint8)])
        self.pool[self.size : size] = np.frombuffer(b"".join([c for _, c in found]), dtype=np.uint8)
        self.start[self.n + 1 : n + 1] = self.size + np.cumsum(sizes)
        self.slots.update(zip((u for u, _ in found), range(self.n, n), strict=True))
        self.bytes += UNIT_BYTES * len(found) + 2 * (size - self.size)
        self.n, self.size = n, size
        return [self.unit(u) for u in units if len(u) >= SMALL]

    def _section(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of each prefix of texts without added tokens, by code points from 1 on."""
        units, lengths = _split(texts)
        if self.bytes > KEEP_BYTES:
            self.clear()
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slots = np.fromiter(map(self.slots.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(slots < 0).tolist()
        long = self._learn([distinct[k] for k in missing]) if missing else []
        slots[missing] = [self.slots.get(distinct[k], -1) for k in missing]
        slots[slots < 0] = -1 - np.arange(len(long))
        slots = slots[np.asarray(coded.indices)] if distinct else np.empty(0, np.int64)
        first = np.concatenate(([0], np.cumsum(lengths))).tolist()
        return [self._joined(slots[a:b], long) for a, b in zip(first[:-1], first[1:], strict=True)]

    def _joined(self, slots: np.ndarray, long: list[Counts]) -> np.ndarray:
        """The counts of units, each raised by the tokens before it; a negative slot is a long unit's number less one, negated."""
        apart = np.flatnonzero(slots < 0).tolist()
        if not apart:
            return self._gathered(slots)
        parts, at, total = [], 0, 0
        for k in [*apart, slots.size]:
            for more in (self._gathered(slots[at:k]), *([_wide(long[-1 - int(slots[k])], 0)] if k < slots.size else ())):
                if more.size:
                    parts.append(more + np.int32(total))
                    total += int(more[-1])
            at = k + 1
        return np.concatenate(parts)

    def _gathered(self, slots: np.ndarray) -> np.ndarray:
        """The same for kept units, a part of them at a time."""
        start, end = self.start[slots], self.start[slots + 1]
        out, at, total = np.empty(int((end - start).sum()), np.int32), 0, 0
        for k in range(0, slots.size, AT_ONCE):
            begin, stop = start[k : k + AT_ONCE], end[k : k + AT_ONCE]
            sizes, own = stop - begin, self.pool[stop - 1].astype(np.int64)
            ends = np.cumsum(sizes)
            n = int(ends[-1])
            part = self.pool[np.repeat(begin - ends + sizes, sizes) + np.arange(n)].astype(np.int32)
            part += np.repeat((np.cumsum(own) - own + total).astype(np.int32), sizes)
            out[at : at + n] = part
            at, total = at + n, total + int(own.sum())
        return out

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of each prefix of each text, by code points from 0 on (the first is 0)."""
        parts: list[str] = []
        places: list[list[tuple[int, int]]] = []  # (part, code points of the added token after it)
        for text in texts:
            own, at = [], 0
            for found in self.cut.finditer(text) if any(t in text for t in self.added) else ():
                own.append((len(parts), found.end() - found.start()))
                # A token's text that isn't complete yet belongs to the part before it.
                parts.append(text[at : found.end() - 1])
                at = found.end()
            own.append((len(parts), 0))
            parts.append(text[at:])
            places.append(own)
        found = self._section(parts)
        out = []
        for own in places:
            pieces, total = [np.zeros(1, np.int32)], 0
            for k, length in own:
                counts = found[k] + total
                if length:
                    held = counts.size - (length - 1)
                    total = (int(counts[held - 1]) if held else total) + 1
                    counts = np.append(counts, np.int32(total))
                pieces.append(counts)
            out.append(np.concatenate(pieces))
        return out


def _split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts and how many of each.

    Arrow splits texts whose only white space is single spaces and line feeds; others go through a pattern.
    """
    column = pa.array(texts, type=pa.string())
    odd = np.asarray(pc.match_substring_regex(column, "[\\x00\\t\\v\\f\\r]|[ \\n]{2}|[ \\n]\\z|[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"))
    empty = np.asarray(pc.equal(column, ""))
    # A mark before each unit's white space; NUL is in none of these texts.
    marked = pc.replace_substring(pc.replace_substring(pc.if_else(pa.array(odd), "", column), " ", "\0 "), "\n", "\0\n")
    lists = pc.split_pattern(marked, "\0")
    lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64).copy()
    units, at, parts = lists.flatten(), 0, []
    ends = np.cumsum(lengths)
    for k in np.flatnonzero(odd | empty).tolist():
        found = _UNITS.findall(texts[k])
        parts += [units.slice(at, ends[k] - lengths[k] - at), pa.array(found, type=pa.string())]
        at, lengths[k] = int(ends[k]), len(found)
    parts.append(units.slice(at))
    units = pa.concat_arrays(parts)
    # A text that begins with white space has an empty first unit.
    blank = np.asarray(pc.equal(units, ""))
    if blank.any():
        owner = np.repeat(np.arange(len(texts)), lengths)
        lengths = lengths - np.bincount(owner[blank], minlength=len(texts))
        units = units.filter(pa.array(~blank))
    return units, lengths


def counter(path: str) -> Counter:
    """The counter of a tokenizer file, one per worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


_SCHEMA = "doc_id long, n_bytes long, n_chars long, n_tokens long, marks array<int>, width int, steps binary"


def prefix_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored counts of all prefixes, one row a document.

    doc_id, n_bytes (UTF-8), n_chars, n_tokens; ``marks[k]`` is the count of the first 1,024 k code points, and ``steps``
    the differences from one prefix to the next, ``width`` signed bytes each (1, or 4 where one doesn't fit).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .subwords import in_pieces

        counts_of = counter(tokenizer).counts
        names = ["doc_id", "n_bytes", "n_chars", "n_tokens", "marks", "width", "steps"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
        for part in (p for batch in batches for p in in_pieces(batch, 1)):
            texts = pc.fill_null(part.column(1), "")
            sizes = np.asarray(pc.binary_length(texts)).tolist()
            out: list[list] = [[] for _ in names]
            for doc_id, size, found in zip(part.column(0).to_pylist(), sizes, counts_of(texts.to_pylist()), strict=True):
                steps = np.diff(found)
                width = 1 if not steps.size or np.abs(steps).max() < 128 else 4
                kept = steps.astype("i1" if width == 1 else "<i4").tobytes()
                values = (doc_id, size, found.size - 1, int(found[-1]), found[::MARK].astype(np.int32), width, kept)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)
            give_back()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(count, _SCHEMA)


def _steps(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="i1" if width == 1 else "<i4")


def _tokens_at(marks: pd.Series, width: pd.Series, steps: pd.Series, chars: pd.Series) -> pd.Series:
    """The mark at or before, and the steps since."""
    out = []
    for m, w, data, n in zip(marks, width, steps, chars, strict=True):
        known = None
        if n is not None and 0 <= n <= len(data) // w:
            block = int(n) // MARK
            known = int(m[block]) + int(_steps(w, data[block * MARK * w : int(n) * w]).sum(dtype=np.int64))
        out.append(known)
    return pd.Series(out, dtype="Int64")


def _chars_within(marks: pd.Series, width: pd.Series, steps: pd.Series, budget: pd.Series) -> pd.Series:
    """From the end, mark by mark: a longer prefix may have fewer tokens than a shorter one."""
    out = []
    for m, w, data, most in zip(marks, width, steps, budget, strict=True):
        n = len(data) // w
        block = len(m) - 1
        while True:
            counts = int(m[block]) + np.concatenate(([0], np.cumsum(_steps(w, data[block * MARK * w : min(n, (block + 1) * MARK) * w]), dtype=np.int64)))
            fits = np.flatnonzero(counts <= most)
            if fits.size or not block:
                out.append(block * MARK + int(fits[-1]) if fits.size else None)
                break
            block -= 1
    return pd.Series(out, dtype="Int64")


def tokens_at(chars: Column) -> Column:
    """Over the stored counts: tokens of the first ``chars`` code points, null beyond the text."""
    return F.pandas_udf(_tokens_at, "long")("marks", "width", "steps", chars)


def chars_within(budget: Column) -> Column:
    """Over the stored counts: code points of the longest prefix of at most ``budget`` tokens."""
    return F.pandas_udf(_chars_within, "long")("marks", "width", "steps", budget)


def answer(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and the longest prefix within the limit: cut_chars, cut_tokens."""
    within = F.col("n_tokens") <= limit
    # Only texts over the limit are searched.
    long = counts.filter(~within).withColumn("cut_chars", chars_within(F.lit(limit))).withColumn("cut_tokens", tokens_at(F.col("cut_chars")))
    short = counts.filter(within).withColumn("cut_chars", F.col("n_chars")).withColumn("cut_tokens", F.col("n_tokens"))
    columns = ["doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars", "cut_tokens"]
    return short.select(*columns).unionByName(long.select(*columns))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts of whole texts, and where a text over the limit is cut, from the stored counts of its prefixes.

    Returns doc_id, n_bytes, n_tokens, over_limit, cut_chars and cut_tokens (the longest prefix, in code points, that has
    ``limit`` tokens at most). A null or empty text has no bytes and no tokens. Rows with null or repeated ids are counted
    one by one. A very long text is counted in one go where it is read, in memory in proportion to it. An empty table
    gives an empty result; further columns are left out.
    """
    return answer(store(prefix_counts(docs, tokenizer, key, text)), limit)
