"""Near-duplicates by MinHash and a chosen-path set similarity join (Christiani, Pagh and Sivertsen 2018).

Each document's set of 5-word shingles gets a signature of ``SIGNATURE`` minwise values; documents with one set are
collapsed first. Every tree branches documents: a node draws a few of the (place, minwise value) tokens by a hash of its
own, and each document that has a drawn token goes to that token's child. A pair at the threshold shares two drawn tokens
of a node on average, so with ``TREES`` independent trees it is missed with a probability of about one in a million.
Every document is compared with one pivot of each node that it is in; nodes whose documents have been joined by then are
done. Of the others, those of up to ``NODE_ROWS`` documents compare all their signatures, and larger ones branch again.
Nodes still large after ``DEPTH`` levels are compared block by block.

Pairs whose checks, one byte each of ``CHECKED`` minwise values, agree on ``MIN_AGREE`` places or more make candidate groups;
a pair at the threshold falls below that with a probability of about one in ten million. Within a group, links are confirmed on full sets, and pairs that are
connected already are left out. Groups beyond ``GROUP_ROWS`` are linked through pivots, then through those of high degree,
and what is not connected to the largest part by then is compared with the whole group. Nothing is capped.

Only members of groups need their texts again: a bit set of bounded size over their ids, built by the engine, is tested in
the scan, so that other texts aren't shuffled. Tables that are broadcast are counted first; beyond the bound the join is a
shuffle, which the engine splits where a key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .shared import bounded, give_back, in_bits, make_room, store

WIDTH, PERCENT = 5, 75
SIGNATURE, CHECKED, MIN_AGREE = 64, 256, 156
TREES, DRAWN, DEPTH = 7, 2 / 0.75, 5
NODE_ROWS, GROUP_ROWS, PIVOTS, CHUNK = 4096, 1024, 16, 64

_KEEP_WORDS = 150_000
_U = np.uint64
_SEEDS = np.random.default_rng(20180409).integers(1, 1 << 63, size=CHECKED, dtype=np.uint64) * _U(2) + _U(1)
_PLACES = np.arange(SIGNATURE, dtype=np.uint64) << _U(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """64-bit hash of a word; kept for up to ``_KEEP_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= _KEEP_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: lower-cased words in fives, or all of them if fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WIDTH, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - width + k + 1]
    return np.unique(mix(out))


def signature(items: np.ndarray) -> tuple[bytes, bytes]:
    """Of a non-empty set: ``SIGNATURE`` minwise values, and one byte of each of ``CHECKED`` ones."""
    if items.size > 4_000:
        low = np.array([(items * s).min() for s in _SEEDS])
    else:
        low = (items[None, :] * _SEEDS[:, None]).min(1)
    return (low[:SIGNATURE] >> _U(32)).astype("<u4").tobytes(), mix(low).astype(np.uint8).tobytes()


def drawn(sigs: np.ndarray, nodes: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, child nodes and masks of the tokens that each row's node draws; a mask's bits are places drawn above."""
    tokens = mix(sigs.astype(np.uint64) | _PLACES)
    draw = mix(tokens ^ mix(nodes)[:, None])
    free = (masks[:, None] >> np.arange(SIGNATURE, dtype=np.uint64)) & _U(1) == 0
    row, place = np.nonzero((draw < _U(int(DRAWN / SIGNATURE * 2**64))) & free)
    children = mix(draw[row, place] + _U(0x9E3779B97F4A7C15))
    return row, children, masks[row] | (_U(1) << place.astype(np.uint64)), place


class _Groups:
    """Union-find over list positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted distinct arrays have a Jaccard similarity of ``PERCENT`` or more."""
    if 100 * min(a.size, b.size) < PERCENT * max(a.size, b.size):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= PERCENT * (a.size + b.size - same)


def _signatures(column: pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype="<u4").reshape(len(parts), SIGNATURE)


def _checks(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(len(parts), CHECKED)


def _one_by_one(column: pa.Array) -> Iterator[list]:
    """The rows of a column of lists, of which only one at a time is there as Python objects."""
    return (x.as_py() for x in column)


def _agree(checks: np.ndarray, one: np.ndarray) -> np.ndarray:
    """On how many places each row agrees with one row, or with its own row of another table."""
    return np.count_nonzero(checks == one, axis=1)


def _batch(schema: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def set_digest(items: np.ndarray) -> bytes | None:
    """16 bytes that tell sets apart; None of an empty one."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if items.size else None


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room()
    for batch in batches:
        sizes, digests, sigs, checks = [], [], [], []
        for text in batch.column(1):
            items = shingles(text.as_py())
            sizes.append(items.size)
            digests.append(set_digest(items))
            sig, check = signature(items) if items.size else (None, None)
            sigs.append(sig)
            checks.append(check)
        schema = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "digest": pa.binary(), "sig": pa.binary(), "chk": pa.binary()}
        yield _batch(schema, batch.column(0), sizes, digests, sigs, checks)
    _hashes.clear()
    give_back()


_ROW = {"node": pa.int64(), "cls": pa.int64(), "mask": pa.int64()}


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First children of (cls, sig) in every tree."""
    make_room()
    for batch in batches:
        if batch.num_rows:
            classes, sigs = batch.column(0).to_numpy(), _signatures(batch.column(1))
            for tree in range(1, TREES + 1):
                row, child, mask, _ = drawn(sigs, np.full(len(classes), tree, dtype=np.uint64), np.zeros(len(classes), dtype=np.uint64))
                yield _batch(_ROW, _signed(child), classes[row], _signed(mask))


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of (node, cls, mask, sig)."""
    make_room()
    for batch in batches:
        if batch.num_rows:
            node, classes, mask = (batch.column(k).to_numpy() for k in range(3))
            row, child, mask, _ = drawn(_signatures(batch.column(3)), node.view(np.uint64), mask.view(np.uint64))
            yield _batch(_ROW, _signed(child), classes[row], _signed(mask))


_EDGE = {"a": pa.int64(), "b": pa.int64()}
_EDGES = "a long, b long"


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (cls, pivot, and the checks of both) whose checks agree enough."""
    make_room()
    for batch in batches:
        if batch.num_rows:
            agree = _agree(_checks(batch.column(2).to_pylist()), _checks(batch.column(3).to_pylist())) >= MIN_AGREE
            yield _batch(_EDGE, batch.column(0).to_numpy()[agree], batch.column(1).to_numpy()[agree])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs of a node (members: array of cls, label, chk, side) whose checks agree enough.

    Members with one label are connected already. ``side`` is null, or says which of two blocks a member is from; then only
    pairs of different blocks count.
    """
    make_room()
    for batch in batches:
        a, b = [], []
        for members in _one_by_one(batch.column(0)):
            members = sorted({m["cls"]: m for m in members}.values(), key=lambda m: m["cls"])
            checks = _checks([m["chk"] for m in members])
            side = np.array([-1 if m["side"] is None else m["side"] for m in members])
            groups, first = _Groups(len(members)), {}
            for i, m in enumerate(members):
                groups.join(i, first.setdefault(m["label"], i))
            for i in range(len(members) - 1):
                agree = _agree(checks[i + 1 :], checks[i]) >= MIN_AGREE
                if side[i] >= 0:
                    agree &= side[i + 1 :] != side[i]
                for j in np.flatnonzero(agree) + i + 1:
                    if groups.join(i, int(j)):
                        a.append(members[i]["cls"])
                        b.append(members[j]["cls"])
        yield _batch(_EDGE, a, b)


_SET = {"grp": pa.int64(), "n": pa.int64(), "cls": pa.int64(), "chk": pa.binary(), "items": pa.binary()}


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of (grp, n, cls, digest, text), of those texts of a document whose set is that of its class."""
    make_room()
    for batch in batches:
        items = [shingles(t.as_py()) for t in batch.column(4)]
        keep = [k for k, x in enumerate(items) if set_digest(x) == batch.column(3)[k].as_py()]
        kept = batch.take(pa.array(keep, type=pa.int64()))
        yield _batch(_SET, kept.column(0), kept.column(1), kept.column(2), [signature(items[k])[1] for k in keep], [items[k].tobytes() for k in keep])
    _hashes.clear()
    give_back()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (array of cls, chk, items) of whole candidate groups to (a, b), a confirmed link to the least of a component."""
    make_room()
    for batch in batches:
        a, b = [], []
        for members in _one_by_one(batch.column(0)):
            members = sorted({m["cls"]: m for m in members}.values(), key=lambda m: m["cls"])
            checks = _checks([m["chk"] for m in members])
            sets = [np.frombuffer(m["items"], dtype=np.uint64) for m in members]
            groups = _Groups(len(members))
            pairs = []
            for i in range(len(members) - 1):
                agree = _agree(checks[i + 1 :], checks[i])
                pairs += [(-int(agree[j]), i, i + 1 + int(j)) for j in np.flatnonzero(agree >= MIN_AGREE)]
            for _, i, j in sorted(pairs):
                if groups.find(i) != groups.find(j) and similar(sets[i], sets[j]):
                    groups.join(i, j)
            for k, m in enumerate(members):
                if groups.find(k) != k:
                    a.append(m["cls"])
                    b.append(members[groups.find(k)]["cls"])
        yield _batch(_EDGE, a, b)


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk (cls, chk, items), its labels (cls, label; may be null) and asked rows (cls, chk, items, label) to the
    confirmed links between them that join different labels."""
    make_room()
    for batch in batches:
        a, b = [], []
        for members, labels, asked in zip(*map(_one_by_one, batch.columns), strict=True):
            label_of = {x["cls"]: x["label"] for x in labels or []}
            checks = _checks([m["chk"] for m in asked])
            sets = [np.frombuffer(m["items"], dtype=np.uint64) for m in asked]
            for own in members:
                items, seen = np.frombuffer(own["items"], dtype=np.uint64), {label_of.get(own["cls"], own["cls"])}
                for j in np.flatnonzero(_agree(checks, np.frombuffer(own["chk"], dtype=np.uint8)) >= MIN_AGREE):
                    other = asked[j]
                    if other["cls"] != own["cls"] and other["label"] not in seen and similar(items, sets[j]):
                        seen.add(other["label"])
                        a.append(own["cls"])
                        b.append(other["cls"])
        yield _batch(_EDGE, a, b)


def _gathered(*columns: str, name: str = "members") -> Column:
    return F.collect_list(F.struct(*columns)).alias(name)


def _candidate_edges(sigs: DataFrame) -> DataFrame:
    """Candidate pairs of (cls, sig, chk): spanning forests of the agreeing pairs that meet in a node of some tree."""
    checks, signatures = sigs.select(F.col("cls").alias("_c"), "chk"), sigs.select(F.col("cls").alias("_c"), "sig")
    rows = store(sigs.select("cls", "sig").mapInArrow(_roots, "node long, cls long, mask long"))
    edges: DataFrame | None = None

    def add(found: DataFrame) -> None:
        nonlocal edges
        found = store(found.distinct())
        edges = found if edges is None else edges.unionByName(found)

    for level in range(1, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("pivot"), F.max("cls").alias("top"))
        sizes = store(sizes.filter("pivot < top").select(F.col("node").alias("_node"), "n", "pivot"))
        live = store(rows.join(bounded(sizes, 32), F.col("node") == F.col("_node")).select("node", "cls", "mask", "n", "pivot"))
        # Every document meets the pivots of its nodes, each once.
        pairs = store(live.filter("cls <> pivot").select("cls", "pivot").distinct())
        own = checks.join(bounded(pairs, 24), F.col("cls") == F.col("_c"))
        pivots = store(pairs.select(F.col("pivot").alias("_p")).distinct())
        theirs = store(checks.join(bounded(pivots, 16), F.col("_c") == F.col("_p")).select("_p", F.col("chk").alias("pchk")))
        met = own.join(bounded(theirs, 300), F.col("pivot") == F.col("_p")).select("cls", "pivot", "chk", "pchk")
        add(met.mapInArrow(_agreeing, _EDGES))
        # A node whose documents are in one candidate group has nothing left to find.
        labels = bounded(store(_rough_labels(edges)), 24)
        labelled = store(live.join(labels, F.col("cls") == F.col("_l"), "left").select("node", "cls", "mask", "n", F.coalesce("label", "cls").alias("label")))
        open_ = store(labelled.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select(F.col("node").alias("_node")))
        rest = labelled.join(bounded(open_, 16), F.col("node") == F.col("_node"), "left_semi")
        small = rest.filter(F.col("n") <= NODE_ROWS).join(checks, F.col("cls") == F.col("_c")).withColumn("side", F.lit(None).cast("int"))
        add(small.groupBy("node").agg(_gathered("cls", "label", "chk", "side")).select("members").mapInArrow(_forest, _EDGES))
        large = store(rest.filter(F.col("n") > NODE_ROWS))
        if large.isEmpty():
            break
        if level < DEPTH:
            drawn_from = large.join(signatures, F.col("cls") == F.col("_c")).select("node", "cls", "mask", "sig")
            rows = store(drawn_from.mapInArrow(_children, "node long, cls long, mask long"))
        else:
            add(_block_pairs(large.join(checks, F.col("cls") == F.col("_c")).select("node", "cls", "label", "chk")))
    return edges


def _rough_labels(edges: DataFrame) -> DataFrame:
    """_l and label after two steps of smallest neighbours: enough to see that a node is one group, not its groups."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = store(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")))
    near = both.join(bounded(low, 24), F.col("b") == F.col("n")).groupBy(F.col("a").alias("_l")).agg(F.min("m").alias("m"))
    return near.select("_l", F.least("_l", "m").alias("label"))


def _block_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of the nodes that stayed large, a pair of blocks in one task."""
    blocks = store(rows.groupBy(F.col("node").alias("_node")).agg(F.ceil(F.count(F.lit(1)) / (NODE_ROWS // 2)).cast("int").alias("blocks")))
    own = rows.join(bounded(blocks, 24), F.col("node") == F.col("_node")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select("node", low.alias("low"), high.alias("high"), "cls", "label", "chk", F.when(low != high, (F.col("block") == high).cast("int")).alias("side"))
    return dealt.groupBy("node", "low", "high").agg(_gathered("cls", "label", "chk", "side")).select("members").mapInArrow(_forest, _EDGES)


def _link_large(sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) within groups (grp) of any size n; rows are (grp, n, cls, chk, items). The sets are shuffled once."""
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / CHUNK)).cast("int")
    chunks = store(sets.withColumn("part", part).groupBy("grp", "part").agg(_gathered("cls", "chk", "items", name="chunk")))
    alone = store(chunks.select("grp", "part", F.explode("chunk.cls").alias("cls")).distinct().withColumn("h", F.xxhash64("cls")))

    def links(asked: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """Confirmed links between the asked rows (_g, _cls, label) and all members of their group, a chunk of each in one task."""
        asked = store(asked)
        dealt = chunks.select("grp", F.explode("chunk").alias("m")).join(bounded(asked, 48), (F.col("m.cls") == F.col("_cls")) & (F.col("grp") == F.col("_g")))
        dealt = dealt.select("grp", F.col("m.cls").alias("cls"), F.col("m.chk").alias("chk"), F.col("m.items").alias("items"), "label")
        n = store(asked.groupBy(F.col("_g").alias("_ng")).agg(F.ceil(F.count(F.lit(1)) / PIVOTS).alias("_n")))
        dealt = dealt.join(bounded(n, 24), F.col("grp") == F.col("_ng")).withColumn("_part", F.pmod(F.xxhash64("cls"), F.col("_n")))
        dealt = store(dealt.groupBy(F.col("grp").alias("_grp"), "_part").agg(_gathered("cls", "chk", "items", "label", name="asked")))
        size = dealt.agg(F.sum(F.aggregate("asked", F.lit(0).cast("long"), lambda t, m: t + F.octet_length(m["items"]) + 400))).collect()[0][0] or 0
        members = chunks.withColumn("labels", F.lit(None).cast("array<struct<cls:long,label:long>>"))
        if labels is not None:
            known = store(labels.groupBy(F.col("grp").alias("_kg"), F.col("part").alias("_kp")).agg(_gathered("cls", "label", name="known")))
            members = chunks.join(bounded(known, 24 * CHUNK), (F.col("grp") == F.col("_kg")) & (F.col("part") == F.col("_kp")), "left").withColumn("labels", F.col("known"))
        met = members.join(bounded(dealt, 1, size), F.col("grp") == F.col("_grp"))
        return store(met.select("chunk", "labels", "asked").mapInArrow(_against, _EDGES))

    def pivots(pool: DataFrame) -> DataFrame:
        """Up to PIVOTS rows of each group with the greatest d; the best of each part first, so that no task sorts a whole group."""
        parts, whole = (Window.partitionBy("grp", *by).orderBy(F.desc("d"), "h") for by in (["part"], []))
        best = pool.withColumn("r", F.row_number().over(parts)).filter(F.col("r") <= PIVOTS)
        best = best.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= PIVOTS)
        return best.select(F.col("grp").alias("_g"), F.col("cls").alias("_cls"), F.col("cls").alias("label"))

    # First any pivots, then those that the first ones are linked with most: a text that many copies stem from is one.
    found = links(pivots(alone.withColumn("d", F.lit(0))))
    degree = store(found.select(F.explode(F.array("a", "b")).alias("_e")).groupBy("_e").agg(F.count(F.lit(1)).alias("d")))
    found = found.unionByName(links(pivots(alone.join(bounded(degree, 24), F.col("cls") == F.col("_e")))))
    # What is outside the largest label of its group meets the whole group.
    labels = bounded(connected_components(found), 24)
    members = alone.join(labels, F.col("cls") == F.col("node"), "left").select("grp", "part", "cls", F.coalesce("component", "cls").alias("label"))
    members = store(members)
    counts = members.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = store(counts.groupBy(F.col("grp").alias("_mg")).agg(F.max(F.struct("n", "label")).alias("m")).select("_mg", F.col("m.label").alias("_main")))
    outside = members.join(bounded(main, 24), F.col("grp") == F.col("_mg")).filter(F.col("label") != F.col("_main"))
    return found.unionByName(links(outside.select(F.col("grp").alias("_g"), F.col("cls").alias("_cls"), "label"), members))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (doc_id is it).

    Two documents are linked if 100 times their common shingles are ``PERCENT`` times all their shingles or more. A
    document without words has no shingles and is linked with nothing; a null id takes no part (component_id null, kept).
    Rows with one id are one document, linked by any of their texts. Equal texts are linked. An empty table gives an empty
    result; other columns are left out.
    A very long text is made into a set where it is read, in memory in proportion to it. Ties between equal sets go to the
    smallest id, then to the first row.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = base.mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, sig binary, chk binary")
    sketches = store(sketches.withColumn("row", F.monotonically_increasing_id()))
    # A class holds the rows with one set; its number is that of a row with the least id.
    part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = sketches.filter(part).groupBy(F.col("digest").alias("_digest")).agg(F.min(F.struct("doc_id", "row")).alias("m"), F.count(F.lit(1)).alias("n"))
    several = store(classes.filter("n > 1").select("_digest", F.col("m.row").alias("_cls"), F.col("m.doc_id").alias("_first")))
    known = sketches.join(bounded(several, 64), (F.col("digest") == F.col("_digest")) & F.col("doc_id").isNotNull(), "left")
    known = known.withColumns({"cls": F.when(part, F.coalesce("_cls", "row")), "first": F.coalesce("_first", "doc_id")})
    rows = store(known.select("doc_id", "n_shingles", "cls", "first", (F.col("cls") == F.col("row")).alias("own")))
    more = store(known.filter("cls <> row").select(F.col("row").alias("_row")))  # rows that their class doesn't need
    sigs = sketches.filter(part).select(F.col("row").alias("cls"), "doc_id", "digest", "sig", "chk")
    sigs = sigs.join(bounded(more, 16), F.col("cls") == F.col("_row"), "left_anti")

    groups = connected_components(_candidate_edges(sigs))
    sizes = store(groups.groupBy(F.col("component").alias("_k")).agg(F.count(F.lit(1)).alias("n")))
    members = groups.join(bounded(sizes, 24), F.col("component") == F.col("_k")).select("node", F.col("component").alias("grp"), "n")
    classes = sigs.select("cls", F.col("doc_id").alias("_id"), "digest")
    members = store(classes.join(bounded(store(members), 32), F.col("cls") == F.col("node")).select("grp", "n", "cls", "_id", "digest"))
    texts = in_bits(base, "doc_id", members.select(F.col("_id").alias("doc_id"))).join(bounded(members, 64), F.col("doc_id") == F.col("_id"))
    texts = texts.select("grp", "n", "cls", "digest", "text")
    schema = "grp long, n long, cls long, chk binary, items binary"

    small = texts.filter(F.col("n") <= GROUP_ROWS).mapInArrow(_full_sets, schema)
    links = store(small.groupBy("grp").agg(_gathered("cls", "chk", "items")).select("members").mapInArrow(_confirm, _EDGES))
    if not sizes.filter(F.col("n") > GROUP_ROWS).isEmpty():
        links = links.unionByName(_link_large(texts.filter(F.col("n") > GROUP_ROWS).mapInArrow(_full_sets, schema)))
    # Rows that share an id but not a set.
    shared = rows.filter("cls IS NOT NULL").groupBy(F.col("doc_id").alias("_d")).agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b")
    shared = store(shared.select("_d", "a"))
    forced = store(rows.join(bounded(shared, 24), F.col("doc_id") == F.col("_d")).select("a", F.col("cls").alias("b")).filter("a <> b").distinct())
    labels = connected_components(links.unionByName(forced))
    firsts = rows.filter("own").select("cls", "first").join(bounded(labels, 24), F.col("cls") == F.col("node"))
    least = store(firsts.groupBy(F.col("component").alias("_k")).agg(F.min("first").alias("component_id")))
    linked = store(labels.join(bounded(least, 24), F.col("component") == F.col("_k")).select("node", "component_id"))
    out = rows.join(bounded(linked, 24), F.col("cls") == F.col("node"), "left")
    component = F.coalesce("component_id", "first")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, one of each component, with the columns they came with. Of rows with one id, one stays.

    It is the row with the smallest hash of its text, then of all its columns. Rows without an id all stay.
    """
    kept = near_duplicates(docs, key, text)
    lost = store(kept.filter(~F.col("kept")).select(F.col("doc_id").alias("_lost")).distinct())
    whole = docs.select(F.struct("*").alias("_doc"), F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    whole = whole.join(bounded(lost, 16), F.col("_key") == F.col("_lost"), "left_anti")
    ids = docs.select(F.col(key).cast("long").alias("_many")).filter("_many IS NOT NULL")
    several = store(ids.groupBy("_many").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_many"))
    if several.isEmpty():
        return whole.select("_doc.*")
    several = bounded(several, 16)
    # Only ids that occur in several rows are grouped; tasks take the least of their own rows first.
    order = F.struct(F.xxhash64("_text"), F.xxhash64(F.to_json("_doc")))
    one = whole.join(several, F.col("_key") == F.col("_many"), "left_semi").groupBy("_key").agg(F.min_by("_doc", order).alias("_doc"))
    return whole.join(several, F.col("_key") == F.col("_many"), "left_anti").select("_doc.*").unionByName(one.select("_doc.*"))
