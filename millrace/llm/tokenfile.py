"""Token ids in binary shards, compressed by a Re-Pair grammar (Larsson and Moffat 1999).

A shard holds the ids of whole documents in ascending order of doc_id. Rounds replace frequent pairs of neighbours by
nonterminals until no pair occurs twice. A round takes all pairs that occur as often as a bound says or more, the more
frequent first where they overlap; rounds of one bound after its first look only where symbols changed, and later rounds may
pair nonterminals. The bound begins at a sixteenth of the count of the most frequent pair and is halved when little is left above it.
The file keeps the symbols, the rules, each rule's expansion length and the expanded length before every ``STEP`` symbols, so that any
range of ids is decoded from the symbols around it alone.

File format, little-endian: the magic ``MRTK0002``; 64-bit counts of documents, symbols, rules, marks, ids and the first
nonterminal; then the arrays doc_ids (int64), has_id (uint8), doc_starts (int64, one more than documents), left and right
of each rule, expansion lengths, marks (uint64), symbols. Symbols, also those in rules, are as many bits wide as the last
nonterminal, expansion lengths as the number of ids; the lowest bit comes first and each array starts at a byte.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, materialize, open_fs, shared_dir

MAGIC = b"MRTK0002"
END_ID = 1

#: Ids after which a writer starts another shard; text bytes meant for one writing task, and the least one where
#: that would leave cores idle.
SHARD_IDS, TASK_BYTES, LEAST_TASK_BYTES = 2_000_000, 256 << 20, 8 << 20

#: Least count of a pair, how far the first bound is below the count of the most frequent pair, how much a bound falls, the
#: share of symbols that a round replaces if its bound stays, most log2 of the counting table, symbols between marks, bytes
#: of units that the encoder keeps, and text bytes that it takes at once.
LEAST, FIRST_SHARE, SHARE, SETTLED, TABLE_BITS, STEP, KEEP_BYTES, PIECE_BYTES = 2, 16, 2, 8, 22, 1024, 160 << 20, 4 << 20


def pair_cells(left: np.ndarray, right: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """A cell of the counting table (of ``bits`` bits) for each pair of neighbours."""
    mixed = (left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))
    return (mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - bits)


def run_seconds(symbols: np.ndarray) -> np.ndarray:
    """Places inside runs of one symbol where no pair starts: pairs start at every second place of a run."""
    twins = np.flatnonzero(symbols[:-1] == symbols[1:])
    begins = np.diff(twins, prepend=-2) != 1
    first = twins[begins][np.cumsum(begins) - 1] if twins.size else twins
    return twins[(twins - first) % 2 == 1]


def frequent_pairs(symbols: np.ndarray, least: int, among: np.ndarray | None = None, bound: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The pairs of neighbours that occur ``bound`` times without overlap, most frequent first, as keys left << 32 | right; their
    places and ranks there; the bound.

    Without a bound it is 1 / ``FIRST_SHARE`` of the count of the most frequent pair, ``least`` at least. Pairs are counted by cell
    first; only those in the fuller cells are counted one by one. ``among`` are the places that have all pairs that occur so often.
    """
    seconds = run_seconds(symbols)
    if among is None:  # all places but these, whose pairs are read in turn
        places, left, right = None, symbols[:-1], symbols[1:]
    else:
        starts = np.zeros(symbols.size, dtype=bool)
        starts[among] = True
        starts[-1:] = False
        starts[seconds] = False
        places, seconds = np.flatnonzero(starts), seconds[:0]
        left, right = symbols[places], symbols[places + 1]
    # So many cells that one is seldom full by rarer pairs alone.
    bits = min(TABLE_BITS, max(8, (left.size // (bound or 64)).bit_length() + 2))
    cells = pair_cells(left, right, bits)
    table = np.bincount(cells, minlength=1 << bits)
    if seconds.size:
        table -= np.bincount(cells[seconds], minlength=1 << bits)
    # A cell holds several pairs at times, so the fullest cell may promise too much; then the floor is lowered.
    floor = bound or max(least, int(table.max(initial=0)) // FIRST_SHARE)
    while True:
        full = (table >= floor)[cells]
        full[seconds] = False
        some = np.flatnonzero(full)
        coded = pa.array(left[some].astype(np.uint64) << np.uint64(32) | right[some]).dictionary_encode()
        found, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        counts = np.bincount(place, minlength=found.size)
        low = bound or max(least, -(-int(counts.max(initial=0)) // FIRST_SHARE))
        if floor <= low or floor == least:
            break
        floor = low
    often = np.flatnonzero(counts >= low)
    order = often[by_count(found[often], counts[often], int(symbols.max(initial=0)).bit_length())]
    rank = np.full(found.size, -1, dtype=np.int64)
    rank[order] = np.arange(order.size)
    rank = rank[place]
    hit = rank >= 0
    some = some[hit]
    return found[order], some if places is None else places[some], rank[hit], low


def by_count(pairs: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Order of pairs of symbols of so many bits: the most frequent first, those that tie by their symbols."""
    room = int(counts.max(initial=0))
    if 2 * bits + room.bit_length() > 64:
        return np.lexsort((pairs, -counts))
    # Count and symbols in one number are sorted at once.
    short = (pairs >> np.uint64(32)) << np.uint64(bits) | pairs & np.uint64(0xFFFFFFFF)
    return np.argsort((room - counts).astype(np.uint64) << np.uint64(2 * bits) | short)


def replace_pairs(symbols: np.ndarray, pairs: np.ndarray, at: np.ndarray, rank: np.ndarray, first: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols with pairs replaced by ``first`` and up, the pairs that are replaced ``least`` times or more, and a mark
    for each symbol that stays.

    Of pairs that overlap, the one of the lower rank is replaced, so that the first pair is replaced wherever it occurs.
    """
    far = np.iinfo(np.int64).max
    beside = np.diff(at) == 1
    left = np.concatenate(([far], np.where(beside, rank[:-1], far)))
    right = np.concatenate((np.where(beside, rank[1:], far), [far]))
    won = (rank < left) & (rank < right)
    at, rank = at[won], rank[won]
    taken = np.bincount(rank, minlength=pairs.size) >= least
    at, rank = at[taken[rank]], rank[taken[rank]]
    number = np.cumsum(taken) - 1
    out = symbols.copy()
    out[at] = (first + number[rank]).astype(np.uint32)
    keep = np.ones(symbols.size, dtype=bool)
    keep[at + 1] = False
    return out[keep], pairs[taken], keep


def compress(ids: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n x 2) and expansion lengths of the rules. ``first`` is above every id.

    In the end no pair of symbols occurs ``least`` times without overlap.
    """
    symbols, rules, n = ids.astype(np.uint32), [np.empty((0, 2), dtype=np.uint32)], 0
    lengths, among, bound = np.empty(0, dtype=np.uint64), None, None
    while symbols.size > 1:
        pairs, at, rank, bound = frequent_pairs(symbols, least, among, bound)
        if not pairs.size:
            if among is None and bound == least:
                break
            among, bound = None, max(least, bound // SHARE)  # the last word is that of all places
            continue
        before, marks = symbols.size, np.zeros(symbols.size, dtype=bool)
        marks[at] = True
        marks[:-1] |= symbols[:-1] == symbols[1:]  # where a run breaks, pairs start at other places of it
        symbols, pairs, keep = replace_pairs(symbols, pairs, at, rank, first + n, least)
        if symbols.size == before:
            break
        if bound > least and (before - symbols.size) * SETTLED < before:
            among, bound = None, max(least, bound // SHARE)
        else:
            # All pairs that occurred so often were taken, so others that do now have a new symbol or are left of them.
            new = np.flatnonzero(symbols >= first + n)
            among = np.concatenate([np.maximum(new - 1, 0), new, np.flatnonzero(marks[keep])])
        new = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rules.append(new)
        n += len(new)
        lengths = np.concatenate([lengths, expansion(new[:, 0], first, lengths) + expansion(new[:, 1], first, lengths)])
    return symbols, np.concatenate(rules), lengths


def expansion(symbols: np.ndarray, first: int, lengths: np.ndarray) -> np.ndarray:
    """Ids that each symbol stands for."""
    out = np.ones(symbols.size, dtype=np.uint64)
    rule = symbols >= first
    out[rule] = lengths[symbols[rule].astype(np.int64) - first]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that the symbols stand for; ``lengths`` are the rules' expansion lengths, if known.

    Each round writes the ids among the symbols to their places and goes on with the two symbols of each rule.
    """
    if lengths is None:
        known = [1] * first
        for left, right in rules.tolist():  # rules name earlier ones only
            known.append(known[left] + known[right])
        lengths = np.array(known[first:], dtype=np.uint64)
    width = expansion(symbols, first, lengths).astype(np.int64)
    out, at = np.empty(int(width.sum()), dtype=np.uint32), np.cumsum(width) - width
    left, right = np.ascontiguousarray(rules[:, 0]), np.ascontiguousarray(rules[:, 1])
    step = expansion(left, first, lengths).astype(np.int64)  # from a rule's left symbol to its right one
    while symbols.size:
        rule = symbols >= first
        plain, rule = np.flatnonzero(~rule), np.flatnonzero(rule)
        out[at.take(plain)] = symbols.take(plain)
        at, rule = at.take(rule), symbols.take(rule).astype(np.int64) - first
        symbols, at = np.concatenate([left.take(rule), right.take(rule)]), np.concatenate([at, at + step.take(rule)])
    return out


def packed(values: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` bits of each value, one value after the other."""
    spread = np.ascontiguousarray(values, dtype="<u4").view("u1").reshape(-1, 4)
    return np.packbits(np.unpackbits(spread, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpacked(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    spread = np.zeros((n, 32), dtype="u1")
    spread[:, :bits] = np.unpackbits(data, count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def widths(first: int, rules: int, ids: int) -> tuple[int, int]:
    """Bits of a symbol and of an expansion length."""
    return max(1, (first + rules - 1).bit_length()), max(1, ids.bit_length())


def shard_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A shard file of documents and their ids (little-endian unsigned 32-bit integers)."""
    stream = np.frombuffer(b"".join(ids), dtype="<u4")
    starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64))).astype("<i8")
    first = int(stream.max()) + 1 if stream.size else 1
    symbols, rules, lengths = compress(stream, first)
    totals = np.concatenate(([0], np.cumsum(expansion(symbols, first, lengths)))).astype("<u8")
    marks = totals[:-1][::STEP] if symbols.size else totals[:1]
    head = struct.pack("<8s6q", MAGIC, len(ids), symbols.size, len(rules), marks.size, stream.size, first)
    arrays = [np.array([x or 0 for x in doc_ids], dtype="<i8"), np.array([x is not None for x in doc_ids], dtype="u1"), starts]
    bits, wide = widths(first, len(rules), stream.size)
    return head + b"".join([*(a.tobytes() for a in arrays), packed(rules[:, 0], bits), packed(rules[:, 1], bits), packed(lengths, wide), marks.tobytes(), packed(symbols, bits)])


class Shard:
    """Random access to the ids of a shard file's bytes."""

    def __init__(self, data: bytes):
        magic, docs, symbols, rules, marks, self.size, self.first = struct.unpack_from("<8s6q", data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<8s6q")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = take("<i8", docs + 1)
        self.bits, wide = widths(self.first, rules, self.size)

        def take_packed(bits: int, n: int) -> np.ndarray:
            return unpacked(take("u1", -(-n * bits // 8)), bits, n)

        self.rules = np.stack([take_packed(self.bits, rules), take_packed(self.bits, rules)], axis=1)
        self.lengths, self.marks, self.n_symbols = take_packed(wide, rules), take("<u8", marks), symbols
        self.packed = take("u1", -(-symbols * self.bits // 8))

    def symbols(self, start: int, stop: int) -> np.ndarray:
        """Symbols from a multiple of ``STEP``, which begins at a byte, to before stop."""
        stop = min(stop, self.n_symbols)
        return unpacked(self.packed[start * self.bits // 8 : -(-stop * self.bits // 8)], self.bits, stop - start)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop; only symbols between the marks around them are expanded."""
        if stop <= start:
            return np.empty(0, dtype=np.uint32)
        low = int(np.searchsorted(self.marks, start, side="right")) - 1
        high = int(np.searchsorted(self.marks, stop, side="left"))
        base = int(self.marks[low])
        return expand(self.symbols(low * STEP, high * STEP), self.rules, self.first, self.lengths)[start - base : stop - base]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents as shards into ``folder`` (a URI that all executors reach) and return the list of shards.

    The list has task, part, path, docs and ids, and is in document order by (task, part). A task writes under a name of
    its own and renames the file when it is whole, so that a lost or repeated attempt leaves no half file.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size // TASK_BYTES), min(8 * cores, -(-size // LEAST_TASK_BYTES)))
    # Equal ids are told apart by text hash and place, so that no id makes a task too large.
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first(), "_h", "_place").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h", "_place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .subwords import encoder, in_pieces

        ids_of, end = encoder(tokenizer, KEEP_BYTES).ids, end_id.to_bytes(4, "little")
        task, part = TaskContext.get().partitionId(), 0
        fs, root = open_fs(folder)
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/shard-{task:06d}-{part:04d}.mrtk"
            own = f"{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as sink:
                sink.write(shard_bytes(doc_ids, ids))
            fs.move(own, name)
            values = ([task], [part], [name], [len(doc_ids)], [total])
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["task", "part", "path", "docs", "ids"])

        for part_of in (p for batch in batches for p in in_pieces(batch, 1, PIECE_BYTES)):
            for doc_id, found in zip(part_of.column(0).to_pylist(), ids_of(part_of.column(1)), strict=True):
                doc_ids.append(doc_id)
                ids.append(found.tobytes() + end)
                total += len(ids[-1]) // 4
                if total >= SHARD_IDS:
                    yield flush()
                    doc_ids, ids, total, part = [], [], 0, part + 1
        if doc_ids:
            yield flush()
        del doc_ids, ids
        give_back()

    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)
    return materialize(rows.select("doc_id", "text").mapInArrow(write, "task long, part long, path string, docs long, ids long"))


def shard_starts(shards: DataFrame) -> DataFrame:
    """The shards with ``first``, the ids in all shards before each; tasks are summed up in groups, then within a group."""
    grouped = shards.withColumn("_group", F.floor(F.col("task") / 1000))
    totals = grouped.groupBy("_group").agg(F.sum("ids").alias("_ids"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_group").alias("_g"), F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_group").orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    grouped = grouped.withColumn("_inside", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return grouped.join(totals, F.col("_group") == F.col("_g")).withColumn("first", F.col("_base") + F.col("_inside")).drop("_group", "_g", "_base", "_inside")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Per document of the listed shards (with ``first``): doc_id, start, n_tokens and ids_crc32, decoded from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        fs, _ = open_fs(folder)
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    shard = Shard(source.read())
                whole = memoryview(shard.ids(0, shard.size).astype("<u4").tobytes())
                crcs = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, type=pa.int64()), pa.array(shard.starts[:-1] + first, type=pa.int64()),
                     pa.array(np.diff(shard.starts), type=pa.int64()), pa.array(crcs, type=pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, min(shards.count(), 4 * shards.sparkSession.sparkContext.defaultParallelism))
    spread = shards.select("path", "first").repartition(n, "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token shards of all documents and read every document back from them.

    Null and empty texts are their end id alone. Null ids come first. Repeated rows and rows with one id stay separate
    documents, next to each other. An empty table writes no shard and gives an empty result; other columns are left out.
    A very long text is encoded in one go where it is read. Pairs of ids that tie are replaced in the order of their ids.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_shards(shard_starts(write_shards(docs, tokenizer, folder, end_id, key, text)), folder)
