"""Subword ids of whole texts by a public tokenizer file, with each distinct word encoded once in a while per worker.

Both vocabularies cut a text into pieces that never reach over the start of a white-space run, so the ids of a text are
the ids of its units (a white-space run and the word after it), one after the other. Arrow splits a piece of a batch into
units and numbers the distinct ones; only those are looked up, and the ids of all units are gathered at once. Unknown
units are encoded many at a time and told apart by the marks that begin or end a word in the vocabulary; symbols at the
end of a word are pieces of their own, so only the word before them is encoded. Known units are kept up to a bound in
bytes; beyond it those that were met in one piece alone are forgotten. A text with a white-space character outside ASCII, a NUL, or an added token's text is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import give_back, kept

#: Bytes of units that a worker keeps, bytes that a unit takes beside its own and its ids', units of a text that are encoded
#: together, and texts of a call.
KEEP_BYTES, UNIT_BYTES, TOGETHER, AT_ONCE = 48 << 20, 200, 256, 32

_OTHER = "[\x00\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]"
_RUNS = r"[ \n]{2}|[\t\r\v\f]|^[ \n]|[ \n]\z"
_UNITS = re.compile(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
#: Symbols that make one piece of their own after a letter.
_TRAILING = ".,;:!?#*$%&|<>()"
#: A unit that begins with this is encoded as it is; others follow a space, if they don't begin with a line feed.
_AS_IS = "\0"
_encoders: dict[tuple[str, int | None], "Encoder"] = kept({})


def _last_bytes(strings: pa.Array) -> np.ndarray:
    """The last byte of each string (0 of an empty one)."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    if data is None or not data.size:
        return np.zeros(len(strings), dtype=np.uint8)
    return np.where(np.diff(offsets) > 0, np.frombuffer(data, dtype=np.uint8)[np.maximum(offsets[1:], 1) - 1], 0)


def _tails(strings: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows in each string after its head, which it begins with."""
    size = np.asarray(pc.binary_length(strings), dtype=np.int64) - np.asarray(pc.binary_length(heads), dtype=np.int64)
    ends = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset + 1 : strings.offset + len(strings) + 1]
    to = np.cumsum(size)
    at = np.repeat(ends - to, size) + np.arange(int(size.sum()))
    data = np.frombuffer(strings.buffers()[2], dtype=np.uint8)[at]
    offsets = np.concatenate(([0], to)).astype(np.int32)
    return pa.StringArray.from_buffers(len(strings), pa.py_buffer(offsets), pa.py_buffer(data))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class _Store:
    """Ids of units: a dictionary to slots, and the ids of all slots in one array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.bytes, self.n, self.size = 0, 0, 0
        self.start, self.count, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = np.zeros(1024, np.int32)

    def forget(self, room: int) -> None:
        """Keep the units that were asked for again after the call that stored them, if they take half the room at most."""
        kept = np.flatnonzero(self.used[: self.n] > 1)
        units, (ids, counts) = list(self.slots), self.gather(kept)
        units = [units[k] for k in kept.tolist()]
        self.clear()
        if sum(map(len, units)) + UNIT_BYTES * len(units) + 4 * ids.size <= room // 2:
            self.add(units, ids, counts)
            self.used[: self.n] = 1

    def add(self, units: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, size = self.n + len(units), self.size + ids.size
        if n > self.start.size:
            self.start, self.count, self.used = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self.start, self.count, self.used))
        if size > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros(size, np.uint32)])
        self.start[self.n : n] = self.size + np.cumsum(counts) - counts
        self.count[self.n : n] = counts
        self.pool[self.size : size] = ids
        self.slots.update(zip(units, range(self.n, n), strict=True))
        self.n, self.size = n, size
        self.bytes += sum(map(len, units)) + UNIT_BYTES * len(units) + 4 * ids.size

    def find(self, units: list[str]) -> np.ndarray:
        """Slot of each unit, -1 if unknown."""
        return np.fromiter(map(self.slots.get, units, repeat(-1)), dtype=np.int64, count=len(units))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots, one after the other, and how many of each."""
        counts = self.count[slots]
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.start[slots] - ends + counts, counts) + np.arange(int(ends[-1]) if ends.size else 0)], counts


class Encoder:
    """Texts to ids, without special tokens."""

    def __init__(self, path: str, keep_bytes: int | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = "|".join([_OTHER, *map(re.escape, self.added)])
        vocabulary = self.tokenizer.get_vocab()
        leads, ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool), np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, k in vocabulary.items():
            leads[k], ends[k] = token[:1] in ("Ġ", "Ċ"), token.endswith("</w>")
        self.by_leads = bool(leads.sum() > ends.sum())  # else white space and case are dropped, and each piece has an end
        self.marks = leads if self.by_leads else ends
        self.fence = self.tokenizer.encode("~", add_special_tokens=False).ids
        self.keep_bytes = KEEP_BYTES if keep_bytes is None else keep_bytes
        self.store = _Store()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(texts), AT_ONCE):  # encodings take far more than their ids
            out += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
        return out

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.whole([u[1:] if u[:1] == _AS_IS else u if u[:1] == "\n" else " " + u for u in units])
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array([x.size for x in found], dtype=np.int64)

    def _together(self, units: list[str], fenced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in turn and how many of each; one by one where marks don't come out even.

        Units each have one mark, or else a fence, which no unit holds, follows each of them.
        """
        parts = [units[at : at + TOGETHER] for at in range(0, len(units), TOGETHER)]
        joined = [" ~ ".join(p) + " ~" if fenced else (" " + " ".join(p)).replace(" \n", "\n") for p in parts]
        out, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for part, ids in zip(parts, self.whole(joined), strict=True):
            mark = ids == self.fence[0] if fenced else self.marks[ids]
            at = np.flatnonzero(mark)
            if at.size != len(part) or (at[0] != 0 if self.by_leads else at[-1] != ids.size - 1):
                ids, n = self._one_by_one(part)
            elif fenced:
                ids, n = ids[~mark], np.diff(at, prepend=-1) - 1
            else:
                n = np.diff(at, append=ids.size) if self.by_leads else np.diff(at, prepend=-1)
            out.append(ids)
            counts.append(n)
        return np.concatenate(out), np.concatenate(counts)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Store distinct unknown units; their slots."""
        cores = pc.utf8_rtrim(words, characters=_TRAILING)
        last = _last_bytes(cores) | 0x20
        cut = ((last >= ord("a")) & (last <= ord("z"))) & (np.asarray(pc.binary_length(cores)) < np.asarray(pc.binary_length(words)))
        # Each unit or stem is looked up once, also where many units have it.
        coded = pc.if_else(pa.array(cut), cores, words).dictionary_encode()
        distinct, place = _strings(coded.dictionary), np.asarray(coded.indices)
        slots = self._find_or_encode(distinct)[place]
        if cut.any():
            built, stems = words.filter(pa.array(cut)), cores.filter(pa.array(cut))
            ends = _tails(built, stems).dictionary_encode()
            found = self._find_or_encode([_AS_IS + t for t in _strings(ends.dictionary)])[np.asarray(ends.indices)]
            ids, counts = self.store.gather(np.stack([slots[cut], found], axis=1).ravel())
            slots[cut] = np.arange(self.store.n, self.store.n + len(built))
            self.store.add(_strings(built), ids, counts.reshape(-1, 2).sum(1))
        return slots

    def _find_or_encode(self, units: list[str]) -> np.ndarray:
        """Slots of distinct units, which are stored if they are unknown."""
        slots = self.store.find(units)
        missing = np.flatnonzero(slots < 0)
        if missing.size:
            slots[missing] = self._encode([units[k] for k in missing.tolist()])
        return slots

    def _encode(self, units: list[str]) -> np.ndarray:
        """Store distinct unknown units; their slots."""
        if self.by_leads:
            kind = np.array([2 if u[:1] == _AS_IS else 0 for u in units])
        else:
            kind = np.array([0 if u.isalpha() else 2 if not u or "~" in u or u[:1] == _AS_IS or len(self.fence) > 1 else 1 for u in units])
        slots = np.empty(len(units), dtype=np.int64)
        for k in (0, 1, 2):  # units with a mark each, fenced ones, and those that are encoded alone
            of = np.flatnonzero(kind == k)
            if of.size:
                some = [units[i] for i in of.tolist()]
                slots[of] = np.arange(self.store.n, self.store.n + of.size)
                self.store.add(some, *(self._one_by_one(some) if k == 2 else self._together(some, k == 1)))
        return slots

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts and how many of each."""
        if not self.by_leads:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            return lists.flatten(), np.asarray(pc.list_value_length(lists), dtype=np.int64)
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_AS_IS), texts, ""), "\n", " \n"), " ")
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _RUNS)))
        if not odd.size:
            return lists.flatten(), np.asarray(pc.list_value_length(lists), dtype=np.int64)
        # Runs of white space keep together: split by a pattern, with the run as a part of the unit.
        parts, counts, at = [], np.asarray(pc.list_value_length(lists), dtype=np.int64).copy(), 0
        for k in odd.tolist():
            found = [u[1:] if u[0] == " " and u[1:2] not in " \t\n\v\f\r" else u if u[0] == "\n" and u[1:2] not in " \t\n\v\f\r" else _AS_IS + u
                     for u in _UNITS.findall(texts[k].as_py())]
            parts += [lists.slice(at, k - at).flatten(), pa.array(found, type=pa.string())]
            counts[k], at = len(found), k + 1
        return pa.concat_arrays([*parts, lists.slice(at).flatten()]), counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (None: empty) as little-endian unsigned 32-bit integers."""
        return [x.astype("<u4").tobytes() for x in self.ids(pa.array(texts, type=pa.string()))]

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text of a string array (null: none)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = np.asarray(pc.match_substring_regex(texts, self.apart))
        units, counts = self._split(pc.if_else(pa.array(apart), "", texts) if apart.any() else texts)
        coded = units.dictionary_encode()
        distinct = _strings(coded.dictionary)
        if self.store.bytes > self.keep_bytes:
            self.store.forget(self.keep_bytes)
        slots = self.store.find(distinct)
        missing = np.flatnonzero(slots < 0).tolist()
        if missing:
            slots[missing] = self._learn(coded.dictionary.take(pa.array(missing)))
        self.store.used[slots] += 1
        ids, lengths = self.store.gather(slots[np.asarray(coded.indices)] if len(distinct) else np.empty(0, np.int64))
        sums = np.concatenate(([0], np.cumsum(lengths)))
        ends = sums[np.cumsum(counts)]
        out = [ids[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)] if len(texts) else []
        for k, found in zip(np.flatnonzero(apart).tolist(), self.whole([texts[int(k)].as_py() for k in np.flatnonzero(apart)]) if apart.any() else [], strict=True):
            out[k] = found
        return out


def encoder(path: str, keep_bytes: int | None = None) -> Encoder:
    """The encoder of a tokenizer file, one per worker; it keeps units up to ``KEEP_BYTES`` or so many bytes."""
    if (path, keep_bytes) not in _encoders:
        _encoders[path, keep_bytes] = Encoder(path, keep_bytes)
        give_back()  # parsing the file takes far more than what stays
    return _encoders[path, keep_bytes]


def in_pieces(batch: pa.RecordBatch, column: int, piece_bytes: int = 2 << 20) -> Iterable[pa.RecordBatch]:
    """A batch in slices with about ``piece_bytes`` of a text column, a longer text in a slice of its own."""
    at, ends = 0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + piece_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
