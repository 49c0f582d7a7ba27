"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with an assistant
turn. Dynamic programming over this automaton picks, for each turn, to keep it, to relabel it, to merge it into the turn
before it, or to put empty turns in front of it, at the least total cost; ties go to the first choice in that order. The
repaired turns are rendered with role markers.

The cost of a run of turns is a matrix from the role before it to its last role, and runs are joined by min-plus
products. A conversation of many turns is therefore solved in blocks of ``BLOCK`` turns: block matrices first, then the
roles at block borders, then the turns of each block, so that no task holds a whole long conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: States: nothing yet, system, user, assistant. Costs of a merge, a relabel and an empty turn.
ROLES = ("", "system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 3, 4

#: Turns of a block; a block is split further only where more than ``4 * BLOCK`` rows tie within it.
BLOCK = 1024

_NEVER = 1 << 40
#: Roles that may follow each state.
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


@lru_cache(None)
def bridge(before: int, after: int) -> tuple[int, ...] | None:
    """The shortest run of roles to insert between two states; None if there is none."""
    paths = [((), before)]
    for _ in range(4):
        for path, last in paths:
            if after in _NEXT[last]:
                return path
        paths = [((*path, r), r) for path, last in paths for r in _NEXT[last]]
    return None


@lru_cache(None)
def step(role: int, before: int, after: int) -> tuple[int, int, str, tuple[int, ...]]:
    """Cost, number of new turns, action and inserted roles of taking a turn of ``role`` from one state to another."""
    label = 0 if role == after else RELABEL
    options = []
    gap = bridge(before, after)
    if gap is not None:
        options.append((label + INSERT * len(gap), 1 + len(gap), "relabel" if label else "keep", gap))
    if before == after:
        options.append((label + MERGE, 0, "merge_relabel" if label else "merge", ()))
    return min(options, key=lambda o: o[0]) if options else (_NEVER, 0, "", ())


@lru_cache(None)
def closing(last: int) -> tuple[int, ...]:
    """Roles to insert after the last turn."""
    return () if last == 3 else bridge(last, 3) + (3,)


def role_of(role: str | None) -> int:
    """State of a role name, white space and case apart; 0 for null and unknown names, which have to be relabelled."""
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 0


def solve(roles: list[int], entry: int) -> tuple[list[int], list[int], list[list[int]]]:
    """From one state: cost and new turns by last state, and for each turn the best state before, by state after."""
    cost, count, back = [_NEVER] * 4, [0] * 4, []
    cost[entry] = 0
    for role in roles:
        new_cost, new_count, came = [_NEVER] * 4, [0] * 4, [0] * 4
        for after in (1, 2, 3):
            for before in range(4):
                add, turns, _, _ = step(role, before, after)
                if cost[before] + add < new_cost[after]:
                    new_cost[after], new_count[after], came[after] = cost[before] + add, count[before] + turns, before
        cost, count = new_cost, new_count
        back.append(came)
    return cost, count, back


def best_last(cost: list[int]) -> int:
    """The cheapest last state, what closes it included."""
    return min((1, 2, 3), key=lambda s: (cost[s] + INSERT * len(closing(s)), -s))


def repair_turns(roles: list[int], entry: int = 0, leave: int | None = None) -> list[tuple[str, int, tuple[int, ...]]]:
    """Action, role after, and inserted roles of each turn, on a cheapest path to ``leave`` (None: to the end)."""
    cost, _, back = solve(roles, entry)
    state = best_last(cost) if leave is None else leave
    out = []
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        before = came[state]
        _, _, action, gap = step(role, before, state)
        out.append((action, state, gap))
        state = before
    return out[::-1]


def render(text: str | None) -> str:
    """A turn's text without anything that looks like a marker."""
    return (text or "").replace("<|", "< |")


def fragments(turns: list[tuple[int | None, str | None, str | None]], entry: int, leave: int | None, base: int) -> Iterator[tuple]:
    """(turn, new_turn, new_role, action, fragment) of a block of (turn, role, text); ``base`` new turns come before it.

    The fragments of a conversation, in order, are its rendering: a new turn closes the one before it, and the last row
    of the conversation closes the last.
    """

    def opened(role: int) -> str:
        return ("<|im_end|>\n" if state else "") + f"<|im_start|>{ROLES[role]}\n"

    state, number = entry, base - 1
    for (turn, _, text), (action, after, gap) in zip(turns, repair_turns([role_of(t[1]) for t in turns], entry, leave), strict=True):
        for role in gap:
            number += 1
            yield None, number, ROLES[role], "insert", opened(role)
            state = role
        if action.startswith("merge"):
            yield turn, number, ROLES[after], action, "\n\n" + render(text)
        else:
            number += 1
            yield turn, number, ROLES[after], action, opened(after) + render(text)
        state = after
    if leave is None:
        for role in closing(state):
            number += 1
            yield None, number, ROLES[role], "insert", opened(role)
            state = role
        yield None, number, ROLES[state], "end", "<|im_end|>\n"


_OUT = "conv_id long, turn long, new_turn long, new_role string, action string, fragment string"
_LAST = (1 << 63) - 1


def repair_chats(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The repaired conversations, one row a source turn, inserted turn or end, with its fragment of the rendering.

    Returns conv_id, turn (null where none), new_turn (from 0), new_role, action (keep, relabel, merge, merge_relabel,
    insert, end) and fragment. Turns are taken in order of turn (null last); ties by a hash of role and text. Repeated
    rows are turns of their own. Null and unknown roles are relabelled; null texts are empty. Rows without a conversation
    id are one conversation. An empty table gives an empty result; other columns are left out.
    """
    rows = chats.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    place = F.coalesce("turn", F.lit(_LAST))
    rows = rows.withColumns({"_place": place, "_tie": F.xxhash64("role", "text"), "_cell": F.floor(place / block).cast("long")})
    cells = rows.groupBy("conv_id", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    long_ = cells.groupBy(F.col("conv_id").alias("_c")).agg(F.count(F.lit(1)).alias("_cells"), F.max("_n").alias("_most"))
    long_ = materialize(long_.filter((F.col("_cells") > 1) | (F.col("_most") > 4 * block)).withColumn("_long", F.lit(True)))
    turns = F.sort_array(F.collect_list(F.struct("_place", "_tie", "role", "text", "turn"))).alias("_turns")
    if long_.isEmpty():  # every conversation is one block
        whole = rows.groupBy("conv_id").agg(turns)
        return _emit(whole.select("conv_id", "_turns", F.lit(0).alias("_entry"), F.lit(None).cast("int").alias("_leave"), F.lit(0).cast("long").alias("_base")))

    parts = rows.join(long_.select("_c", "_long", "_most"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    fine = F.coalesce(F.col("_most") > 4 * block, F.lit(False))
    key = F.struct(
        F.when(F.col("_long"), F.col("_cell")).otherwise(-1).alias("cell"),
        F.when(fine, F.col("_place")).otherwise(-1).alias("place"),
        F.when(fine, F.shiftrightunsigned(F.col("_tie").bitwiseXOR(F.lit(-(1 << 63))), 48)).otherwise(-1).alias("tie"),
        F.when(fine, F.pmod(F.spark_partition_id(), F.lit(64))).otherwise(-1).alias("salt"),
    )
    parts = materialize(parts.withColumn("_block", key).drop("_cell", "_most"))
    roles = parts.filter("_long").groupBy("conv_id", "_block").agg(F.sort_array(F.collect_list(F.struct("_place", "_tie", "role"))).alias("_turns"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, counts = [], []
            for seq in batch.column(2).to_pylist():
                solved = [solve([role_of(t["role"]) for t in seq], entry) for entry in range(4)]
                costs.append([c for s in solved for c in s[0]])
                counts.append([c for s in solved for c in s[1]])
            columns = [batch.column(0), batch.column(1), pa.array(costs, type=pa.list_(pa.int64())), pa.array(counts, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "_block", "cost", "count"])

    kind = "struct<cell:bigint,place:bigint,tie:bigint,salt:int>"
    solved = roles.select("conv_id", F.col("_block").cast(kind).alias("_block"), "_turns").mapInArrow(matrices, f"conv_id long, _block {kind}, cost array<long>, count array<long>")
    runs = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_block", "cost", "count"))).alias("_blocks"))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv_id, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cost, came = [0, _NEVER, _NEVER, _NEVER], []
                for b in blocks:
                    reach = [min((cost[p] + b["cost"][4 * p + q], p) for p in range(4)) for q in range(4)]
                    cost = [min(c, _NEVER) for c, _ in reach]
                    came.append([p for _, p in reach])
                state, path = best_last(cost), []
                for back in reversed(came):
                    path.append((back[state], state))
                    state = back[state]
                base = 0
                for k, (b, (entry, leave)) in enumerate(zip(blocks, path[::-1], strict=True)):
                    out.append((conv_id, b["_block"], entry, None if k == len(blocks) - 1 else leave, base))
                    base += b["count"][4 * entry + leave]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), batch.schema.field(1).type.value_type.field("_block").type, pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["_c", "_b", "_entry", "_leave", "_base"])

    ends = runs.mapInArrow(borders, f"_c long, _b {kind}, _entry int, _leave int, _base long")
    blocks = parts.withColumn("_block", F.col("_block").cast(kind)).groupBy("conv_id", "_block").agg(turns)
    joined = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    return _emit(joined.select("conv_id", "_turns", F.coalesce("_entry", F.lit(0)).alias("_entry"), "_leave", F.coalesce("_base", F.lit(0).cast("long")).alias("_base")))


def _emit(blocks: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for conv_id, seq, *ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out += [(conv_id, *f) for f in fragments([(t["turn"], t["role"], t["text"]) for t in seq], *ends)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["conv_id", "turn", "new_turn", "new_role", "action", "fragment"])

    return blocks.mapInArrow(emit, _OUT)
