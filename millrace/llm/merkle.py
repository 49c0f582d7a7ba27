"""Merkle manifest of a table: a content-addressed DAG of digest-to-children records, with proofs found by descent.

Each row is a leaf. The leaves of a source, by ascending id, are hashed in runs of 16, level by level, up to the source's
subroot; the subroots, ordered by source, likewise up to the root. A node is stored as one record, its digest and the
digests of its children, so equal subtrees share a record.

A proof is read off the records alone. The digits of a leaf's rank, to the base of 16, say which child to take at each
record from the root down; the children that aren't taken are the path's segments, and the proof is the segments in
reverse. Leaves under one record go down together: a level is one join of path prefixes with the records of that level, so
upper records are read once however many leaves ask, and the long paths are shuffled once a run of 16 leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, store

#: Children of a node, and the binary digits of its rank's last digit.
FAN, DIGIT_BITS = 16, 4

#: Rows whose id's crc32 this divides are tampered with in a verification.
TAMPER = 5

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes in front; null is a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows, stored, with ``rank``: their place from 0 in their group (a non-null string) by ``order``, nulls first.

    Rows are dealt by ranges of group and order and sorted within a task's range; a group starts in a range at its counts
    in the ranges before it. So a group may span many tasks, and a task may hold many groups. Rows that are equal in all of
    these are told apart by their place in the input.
    """
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(group, *order, "_at").sortWithinPartitions(group, *order, "_at")
    placed = store(placed.drop("_at").withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    starts = placed.groupBy(F.col(group).alias("_in"), part.alias("_part")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_in").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = store(starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).select("_in", "_part", "_start"))
    joined = placed.withColumn("_p", part).join(bounded(starts, 64), (F.col(group) == F.col("_in")) & (F.col("_p") == F.col("_part")))
    return store(joined.select(*rows.drop("_at").columns, (F.col("_place") + F.col("_start")).alias("rank")))


def _height(n: Column) -> Column:
    """Levels above n leaves until one node is left."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(14)), lambda k: F.expr("1L") * F.pow(F.lit(FAN), k).cast("long") < n))


@dataclass
class Tree:
    """Levels of nodes above ranked leaves; each group of leaves has a tree of its own.

    ``levels[h - 1]`` holds the records of height h: _g, node, height (of the group's tree), digest, children. ``roots``
    has one row a group: _g, height, digest.
    """

    levels: list[DataFrame]
    roots: DataFrame

    def records(self, height: int) -> DataFrame:
        """The digest-to-children records of one height; equal nodes are one record."""
        return self.levels[height - 1].select(F.col("digest").alias("_digest"), "children").dropDuplicates(["_digest"])


def build(leaves: DataFrame) -> Tree:
    """The trees over ranked leaves (_g, rank, digest)."""
    sizes = store(leaves.groupBy(F.col("_g").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).select("_k", _height(F.col("_n")).alias("height")))
    top = sizes.agg(F.max("height")).first()[0] or 0
    nodes = leaves.join(bounded(sizes, 48), F.col("_g") == F.col("_k")).select("_g", F.col("rank").alias("node"), "height", "digest")
    levels, roots = [], nodes.filter("height = 0").select("_g", "height", "digest")
    for h in range(1, top + 1):
        run = nodes.filter(F.col("height") >= h).groupBy("_g", F.shiftright("node", DIGIT_BITS).alias("node"), "height")
        kids = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"])  # at most FAN
        nodes = store(run.agg(kids.alias("children")).select("_g", "node", "height", digest(F.array_join("children", "")).alias("digest"), "children"))
        levels.append(nodes)
        roots = roots.unionByName(nodes.filter(F.col("height") == h).select("_g", "height", "digest"))
    return Tree(levels, store(roots))


def _others(children: Column, at: Column) -> Column:
    """The children that aren't taken, before and after place ``at`` (from 0)."""
    left = F.array_join(F.slice(children, F.lit(1), at), "")
    right = F.array_join(F.slice(children, at + 2, F.lit(FAN)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def descend(tree: Tree, asked: DataFrame, starts: DataFrame) -> DataFrame:
    """The runs of leaves that the asked leaves (_g, rank) lie in, found from the records by the digits of their ranks.

    ``starts`` has _g, height, digest and path for each group's root, further columns come along. Returns _g, run (rank
    without its last digit), children (the run's leaf digests, none if the root is a leaf), path (the segments from the
    root down to the run) and the further columns.
    """
    more = [c for c in starts.columns if c not in ("_g", "height", "digest", "path")]
    columns = ["_g", "height", "node", "digest", "path", *more]
    wanted = {}
    prefixes = asked.select("_g", F.col("rank").alias("prefix"))
    for h in range(1, len(tree.levels) + 1):
        prefixes = wanted[h] = store(prefixes.select("_g", F.shiftright("prefix", DIGIT_BITS).alias("prefix")).distinct())
    begin = starts.withColumn("node", F.lit(0).cast("long"))
    found = begin.filter("height = 0").select("_g", F.col("node").alias("run"), F.array().cast("array<string>").alias("children"), "path", *more)
    below = None
    for h in range(len(tree.levels), 0, -1):
        here = begin.filter(F.col("height") == h).select(*columns)
        here = here if below is None else here.unionByName(below)
        met = here.join(bounded(store(tree.records(h)), 80 * FAN), F.col("digest") == F.col("_digest"))
        if h == 1:
            found = found.unionByName(met.select("_g", F.col("node").alias("run"), "children", "path", *more))
            break
        child = met.select("_g", "height", "node", "children", "path", *more, F.posexplode("children").alias("_at", "digest"))
        path = F.concat("path", F.array(_others(F.col("children"), F.col("_at"))))
        child = child.select("_g", "height", (F.col("node") * FAN + F.col("_at")).alias("node"), "digest", path.alias("path"), *more)
        kept = wanted[h - 1].withColumnsRenamed({"_g": "_g2"})
        below = store(child.join(bounded(kept, 48), (F.col("_g") == F.col("_g2")) & (F.col("node") == F.col("prefix")), "left_semi"))
    return found


@dataclass
class Manifest:
    """``leaves``: _g, rank, doc_id, leaf and what else the caller kept; the trees of the sources and the one over them."""

    leaves: DataFrame
    sources: Tree
    order: DataFrame
    top: Tree
    root: str | None

    def records(self) -> DataFrame:
        """digest and children of each node: all that is needed to prove a leaf against the root."""
        both = [*self.sources.levels, *self.top.levels]
        if not both:
            return self.leaves.limit(0).select(F.col("leaf").alias("digest"), F.array("leaf").alias("children"))
        out = both[0].select("digest", "children")
        for level in both[1:]:
            out = out.unionByName(level.select("digest", "children"))
        return out.dropDuplicates(["digest"])

    def proofs(self, asked: DataFrame) -> DataFrame:
        """The asked leaves, rows of ``leaves``, with subroot, root and path (segments from the leaf up to the root)."""
        home = asked.select("_g").distinct().withColumnRenamed("_g", "_s")
        places = store(self.order.join(home, F.col("source") == F.col("_s"), "left_semi").select("_g", "rank", F.col("source").alias("_s")))
        start = self.top.roots.withColumn("path", F.array().cast(_PATH))
        runs = descend(self.top, places, start)
        digit = F.col("rank").bitwiseAND(FAN - 1).cast("int")
        # What the records say a source's subroot is, and the segments from the root down to it.
        at = places.join(runs, (places["_g"] == runs["_g"]) & (F.shiftright("rank", DIGIT_BITS) == F.col("run")))
        lone = F.size("children") == 0
        subroot = F.when(lone, F.lit(self.root)).otherwise(F.get("children", digit))
        down = F.when(lone, F.col("path")).otherwise(F.concat("path", F.array(_others(F.col("children"), digit))))
        subs = store(at.select(F.col("_s"), subroot.alias("subroot"), down.alias("path")))
        heights = self.sources.roots.select("_g", "height")
        starts = heights.join(bounded(subs, 4096), F.col("_g") == F.col("_s")).select("_g", "height", F.col("subroot").alias("digest"), "path", "subroot")
        runs = descend(self.sources, asked.select("_g", "rank"), store(starts)).withColumnRenamed("_g", "_g2")
        met = asked.join(runs, (F.col("_g") == F.col("_g2")) & (F.shiftright("rank", DIGIT_BITS) == F.col("run")))
        last = F.when(F.size("children") == 0, F.array().cast(_PATH)).otherwise(F.array(_others(F.col("children"), digit)))
        return met.select(*asked.columns, "subroot", F.lit(self.root).alias("root"), F.reverse(F.concat("path", last)).alias("path"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", source: str = "source", text: str = "text", tamper: int | None = None) -> Manifest:
    """Hash every row and build the trees. Null ids come first; rows of one id and source go by their digest.

    With ``tamper``, a row whose id's crc32 it divides has in ``other`` the leaf of its text with A-Z lower-cased.
    Texts are hashed where they are read; only digests are shuffled and stored.
    """
    row = [F.col(f"`{c}`") for c in fields]
    low = F.translate(F.col(text), _CAPITALS, _SMALL)
    changed = [low if c == text else F.col(f"`{c}`") for c in fields]
    hit = F.lit(False) if tamper is None else F.crc32(F.col(key).cast("string").cast("binary")) % tamper == 0
    group = F.coalesce(F.concat(F.lit("1"), F.col(source)), F.lit("0"))  # null before all others
    leaves = store(docs.select(group.alias("_g"), F.col(key).alias("doc_id"), digest(*map(field, row)).alias("leaf"), F.when(hit, digest(*map(field, changed))).alias("other")))
    leaves = ranked(leaves, "_g", ["doc_id", "leaf"])
    trees = build(leaves.select("_g", "rank", F.col("leaf").alias("digest")))
    one = trees.roots.select(F.lit("").alias("_g"), F.col("_g").alias("source"), "digest")
    order = ranked(one, "_g", ["source"])
    top = build(order.select("_g", "rank", "digest"))
    root = top.roots.first()
    return Manifest(leaves, trees, order, top, root["digest"] if root else None)


def verify_manifest(docs: DataFrame, tamper: int = TAMPER) -> DataFrame:
    """Each row's leaf, proof and whether it still leads to the root after some rows have been tampered with.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Every row is asked for, and its root is
    folded from its own (perhaps tampered) leaf and the siblings that the descent found. Nulls in any column are hashed as
    such; a null text isn't tampered with, nor is a row without an id. Repeated rows are leaves of their own with one
    digest. A very long text is hashed as a whole, where it is read. An empty table gives an empty result; further columns
    are left out.
    """
    made = manifest(docs, tamper=tamper)
    if made.root is None:
        return made.leaves.select("doc_id", "leaf", *[F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(False).alias("verified"))
    proven = made.proofs(made.leaves)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("other", "leaf"), lambda acc, s: digest(s["left"], acc, s["right"]))
    out = proven.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
