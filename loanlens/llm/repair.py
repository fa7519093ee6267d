"""Repair of conversation structure at least cost, by prefix-doubling path ranking.

Turns of a conversation are kept, given another role, deleted or preceded by inserted turns until their roles read
``(s?(ua)+)?`` (an optional system turn, then user and assistant in alternation; or nothing). A dynamic programme gives the
least cost from each node (turns read so far, state of the pattern). Among the arcs on least paths, nodes are ranked by
the edits of their best continuation of length 1, 2, 4, ...: a rank of twice the length is the rank of the pair (own
rank, rank of the node that the pointer leads to), and pointers double with it. The final ranks order whole continuations,
so they select the least audit, which is read off through the doubled pointers, all of its places at once.

Rows are numbered per conversation by range partitions and cut into blocks, so one conversation may span many tasks. A
block's part of the programme is a product of 4 x 4 matrices over (min, +), and where it leaves off depends only on the state
it begins in; both are chained per conversation over blocks. Only the hash of the repaired text, sequential by
its nature, reads a conversation in one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import runs, slices, starts_of, whole_groups
from loanlens.operators.ordered import with_group_index
from loanlens.session import materialize

#: Turns of a conversation that one block holds.
BLOCK = 4096
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = 4
NONE = 1 << 40
_NEVER = np.int64(NONE)
#: State after an inserted or renamed turn: assistant after user, else user.
_TURN = np.array([2, 2, 3, 2])
#: State after keeping a turn by its role's initial (0: another one, 1: s, 2: u, 3: a); -1: not allowed.
_KEEP = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
INSERT, RENAME, DELETE, UNENDED = 2, 2, 3, 1
#: Edits in ASCII order; 0 stands for the end.
EDITS = "DIKR"
_BLANK = r"\A[\x20\x09-\x0D]*\z"


# ---- arrays: many blocks at once; ``begin`` and ``size`` give each block's rows ----


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products over (min, +)."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), _NEVER)


def _inserting() -> np.ndarray:
    """Least cost of inserts from state to state."""
    out = np.where(np.eye(STATES, dtype=bool), 0, _NEVER)
    out[np.arange(STATES), _TURN] = INSERT
    return _times(out, out)


def turn_matrices(initial: np.ndarray, gone: np.ndarray, unended: np.ndarray) -> np.ndarray:
    """Cost from state to state over each row: inserts before it, and what happens to it."""
    n = len(initial)
    cost = np.full((n, STATES, STATES), _NEVER)
    every = np.arange(n)
    for s in range(STATES):
        cost[:, s, s] = DELETE
        stays = np.where(gone, _NEVER, unended)
        np.minimum(cost[:, s, _TURN[s]], stays + RENAME, out=cost[:, s, _TURN[s]])
        to = _KEEP[initial, s]
        ok = (to >= 0) & ~gone
        cost[every[ok], s, to[ok]] = np.minimum(cost[every[ok], s, to[ok]], unended[ok])
    return _times(_inserting()[None], cost)


def suffix_products(matrices: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Product of each row's matrix with those of the ``left - 1`` rows after it, by doubling."""
    out, step = matrices.copy(), 1
    while (far := left > step).any():
        at = np.flatnonzero(far)  # row i covers i .. i + step - 1; so does row i + step, clipped at the block's end
        out[at] = _times(out[at], out[at + step])
        step *= 2
    return out


def ends() -> np.ndarray:
    """Least cost of finishing from each state when all turns are read."""
    accept = np.array([0, _NEVER, _NEVER, 0])
    return np.minimum((_inserting() + accept[None]).min(axis=1), _NEVER)


class Ranked(NamedTuple):
    """Chosen arcs of all nodes: edit (place in ``EDITS`` + 1, 0 at ends) and pointers to the nodes after 1, 2, 4, ... edits."""

    edit: np.ndarray
    pointers: list[np.ndarray]


def rank_paths(edit: np.ndarray, target: np.ndarray) -> Ranked:
    """The least continuation of each node of a graph.

    ``edit`` and ``target`` (nodes x arcs) list each node's arcs on least-cost paths; edit 0 pads. Nodes without arcs are
    ends. No two arcs of a node bear the same edit, so a continuation's edits fix its nodes. Edits compare as text: the
    end is less than any edit.
    """
    nodes = np.arange(len(edit))
    own = np.where(edit > 0, edit, 127)
    best = own.argmin(axis=1)
    end = own[nodes, best] == 127
    rank, pointer = np.where(end, 0, own[nodes, best]).astype(np.int64), np.where(end, nodes, target[nodes, best])
    while True:
        after = pointer[pointer]
        _, doubled = np.unique(rank * (rank.max(initial=0) + 1) + rank[pointer], return_inverse=True)
        if np.array_equal(after, pointer):
            break
        rank, pointer = doubled, after
    # ranks now order whole continuations: the least edit, then the better node after it
    choice = np.where(edit > 0, edit * np.int64(len(nodes) + 1) + rank[target], np.iinfo(np.int64).max).argmin(axis=1)
    first, pointers = np.where(end, nodes, target[nodes, choice]), []
    while not pointers or not np.array_equal(pointers[-1], first):
        pointers.append(first)
        first = first[first]
    return Ranked(np.where(end, 0, edit[nodes, choice]), pointers)


def walk(ranked: Ranked, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Nodes after 0, 1, ... ``length - 1`` edits from each start, one after the other."""
    place, node = runs(np.zeros(len(start), np.int64), length), np.repeat(start, length)
    for bit, pointer in enumerate(ranked.pointers):
        far = (place >> bit) & 1 == 1
        node[far] = pointer[node[far]]
    return node


def lengths(ranked: Ranked) -> np.ndarray:
    """Edits from each node to its end."""
    out = np.zeros(len(ranked.edit), np.int64)
    at = np.arange(len(ranked.edit))
    for bit in range(len(ranked.pointers) - 1, -1, -1):  # the longest jump that does not arrive yet
        there = ranked.pointers[bit][at]
        go = ranked.edit[there] > 0
        out[go] += 1 << bit
        at = np.where(go, there, at)
    return out + (ranked.edit[at] > 0)


def least_paths(begin: np.ndarray, size: np.ndarray, exits: np.ndarray, last: np.ndarray, initial: np.ndarray, gone: np.ndarray, unended: np.ndarray):
    """Per block: least cost (blocks x states), the audit from each state of its first row, and the state it ends in.

    ``exits`` (blocks x states) is the least cost from a block's end on. A block that is the ``last`` of its conversation may
    insert turns after its rows; for others those belong to the next block.
    """
    blocks, n = len(begin), len(initial)
    block = np.repeat(np.arange(blocks), size)
    left = size[block] - (np.arange(n) - begin[block])
    products = suffix_products(turn_matrices(initial, gone, unended), left)
    cost = np.minimum((products + exits[block][:, None, :]).min(axis=-1), _NEVER)
    # nodes: states of each row, then states of each block's end
    total = np.concatenate([cost, exits]).reshape(-1)
    base = np.arange(n) * STATES
    following = np.where(left > 1, base + STATES, (n + block) * STATES)
    edit, target = np.zeros((len(total), 4), np.int8), np.zeros((len(total), 4), np.int64)

    def arcs(place: int, node: np.ndarray, to: np.ndarray, price) -> None:
        good = (total[node] < NONE) & (total[node] == price + total[to])
        edit[node[good], place], target[node[good], place] = place + 1, to[good]

    stays = np.where(gone, _NEVER, unended)
    for s in range(STATES):
        arcs(0, base + s, following + s, DELETE)
        arcs(1, base + s, base + _TURN[s], INSERT)
        kept = _KEEP[initial, s]
        arcs(2, base + s, following + np.maximum(kept, 0), np.where(kept < 0, _NEVER, stays))
        arcs(3, base + s, following + _TURN[s], stays + RENAME)
        final = (n + np.flatnonzero(last)) * STATES
        arcs(1, final + s, final + _TURN[s], INSERT)
    ranked = rank_paths(edit, target)
    starts = np.where(size > 0, begin * STATES, (n + np.arange(blocks)) * STATES)
    starts = (starts[:, None] + np.arange(STATES)).reshape(-1)
    count = lengths(ranked)[starts]
    path = walk(ranked, starts, count)
    letters = np.frombuffer(b"." + EDITS.encode(), np.uint8)[ranked.edit[path]].tobytes().decode()
    cuts = np.concatenate([[0], np.cumsum(count)])
    audits = [letters[a:b] for a, b in zip(cuts, cuts[1:])]
    reached = walk(ranked, starts, count + 1)[np.cumsum(count + 1) - 1] % STATES
    return total[starts].reshape(-1, STATES), audits, reached.reshape(-1, STATES)


# ---- tables ----


def key_name(key: Column) -> Column:
    """A name of a conversation that is never null."""
    return F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), key.cast("string")))


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "idx")


def _columns(group: dict[str, np.ndarray]):
    begin = starts_of([group["conv"], group["block"]])
    size = np.diff(np.append(begin, len(group["conv"])))
    return begin, size, (group["initial"].astype(np.int64), group["gone"].astype(bool), group["unended"].astype(np.int64))


def _block_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in whole_groups(batches, ["conv", "block"]):
        begin, size, turns = _columns(group)
        left = np.repeat(begin + size, size) - np.arange(len(group["conv"]))
        products = suffix_products(turn_matrices(*turns), left)[begin]
        yield pa.record_batch(
            [pa.array(group["conv"][begin]), pa.array(group["block"][begin]), pa.array(list(products.reshape(len(begin), -1)), pa.list_(pa.int64()))],
            names=["conv", "block", "costs"],
        )


def _chain_exits(table: pa.Table) -> pa.Table:
    order = np.argsort(table["block"].to_numpy())
    costs = [np.array(c).reshape(STATES, STATES) for c in table["costs"].to_pylist()]
    exits, out = ends(), {}
    for i in order[::-1]:
        out[i] = exits
        exits = np.minimum((costs[i] + exits[None]).min(axis=1), _NEVER)
    lists = pa.array([out[i].tolist() for i in range(len(order))], pa.list_(pa.int64()))
    return pa.table({"conv": table["conv"], "block": table["block"], "exits": lists})


_FOUND = "conv string, block long, last boolean, cost long, audits array<string>, reached array<long>, illegal long, head long, tail long"


def legal(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether neighbouring initials are su, ua or au."""
    return np.isin(one * 4 + two, [1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in whole_groups(batches, ["conv", "block"]):
        begin, size, turns = _columns(group)
        exits = np.array([ends() if e is None else np.asarray(e) for e in group["exits"][begin]], np.int64)
        cost, audits, reached = least_paths(begin, size, exits, group["last"][begin].astype(bool), *turns)
        initial, end = turns[0], begin + size - 1
        bad = ~legal(initial, np.append(initial[1:], 0))
        bad[end] = False
        yield pa.record_batch([
            pa.array(group["conv"][begin]), pa.array(group["block"][begin]), pa.array(group["last"][begin].astype(bool)), pa.array(cost[:, 0]),
            pa.array([audits[i : i + STATES] for i in range(0, len(audits), STATES)], pa.list_(pa.string())),
            pa.array(list(reached), pa.list_(pa.int64())), pa.array(np.add.reduceat(bad.astype(np.int64), begin)), pa.array(initial[begin]), pa.array(initial[end]),
        ], names=[f.split()[0] for f in _FOUND.split(", ")])


def _chain_states(table: pa.Table) -> pa.Table:
    """State each block of a conversation begins in, and whether its first turn may not follow the turn before."""
    order = np.argsort(table["block"].to_numpy())
    state, states = 0, np.zeros(len(order), np.int32)
    for i in order:
        states[i] = state
        state = table["reached"][int(i)].as_py()[state]
    heads, tails = table["head"].to_numpy()[order], table["tail"].to_numpy()[order]
    seam = np.zeros(len(order), np.int64)
    seam[order[1:]] = ~legal(tails[:-1], heads[1:])
    return pa.table({"conv": table["conv"], "block": table["block"], "state": pa.array(states), "seam": pa.array(seam)})


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from its rows in order; a ``mark`` before the rows of a block holds its audit."""
    conv, audits, digest, edits, state, first = None, [], None, iter(()), 0, True

    def put(role: str, text: str) -> None:
        nonlocal first, state
        digest.update(("" if first else "\n").encode() + role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
        first = False

    def insert() -> None:
        nonlocal state
        state = _TURN[state]
        put("assistant" if state == 3 else "user", "")

    for batch in slices(batches, 4096):
        done = []
        for name, mark, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "mark", "audit", "role", "text"))):
            if mark:
                if conv is not None:
                    for _ in edits:  # inserts after the last row
                        insert()
                if name != conv:
                    if conv is not None:
                        done.append((conv, "".join(audits), digest.hexdigest()))
                    conv, audits, digest, state, first = name, [], hashlib.sha256(), 0, True
                audits.append(audit)
                edits = iter(audit)
                continue
            for edit in edits:
                if edit == "I":
                    insert()
                    continue
                if edit == "R":
                    state = _TURN[state]
                    put("assistant" if state == 3 else "user", text)
                elif edit == "K":
                    state = _KEEP["sua".find(role[:1]) + 1 if role else 0][state]
                    put(role, text)
                break
        yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*done) if done else [[]] * 3)], names=["conv", "audit", "repaired_sha256"])
    if conv is not None:
        for _ in edits:
            insert()
        yield pa.record_batch([pa.array([v], pa.string()) for v in (conv, "".join(audits), digest.hexdigest())], names=["conv", "audit", "repaired_sha256"])


def number_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns ``(key, turn, role, text)`` by conversation ``conv``, with place ``idx`` (from 0), the first fault, and what the repair reads.

    Turns ascend by ``turn``, null first; equal ones by role and text, so that repeated rows are neighbours. Null roles and texts count as
    one space. Faults: ``blank`` (no character but ASCII white space), ``duplicate`` (role and text seen earlier), ``truncated``
    (last such character none of ``.!?``).
    """
    space = F.lit(" ")
    rows = turns.select(
        key_name(F.col(f"`{key}`")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    rows = with_group_index(rows, ["conv"], ["turn", "role", "text"], "idx").withColumn("idx", F.col("idx") - 1)
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("same", same)
    # counted per task before the shuffle; only repeated turns come back
    earliest = rows.groupBy("conv", "same").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(earliest, ["conv", "same"], "left").drop("same")
    fault = (
        F.when(F.col("text").rlike(_BLANK), "blank")
        .when(F.col("idx") > F.col("first"), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return rows.withColumn("fault", fault).withColumns({
        "block": F.floor(F.col("idx") / BLOCK),
        "initial": F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in (("s", 1), ("u", 2), ("a", 3)) for x in p)), F.substring("role", 1, 1)), F.lit(0)),
        "gone": F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)),
        "unended": F.coalesce((F.col("fault") == "truncated").cast("int"), F.lit(0)),
    }).drop("first")


def summarize(numbered: DataFrame) -> DataFrame:
    """Per conversation: gaps in the turn numbers (null ones ignored), and rows by fault."""
    faults = ("blank", "duplicate", "truncated")
    turns = numbered.groupBy("conv", "turn").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in faults))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv").agg(gaps.alias("gaps"), *(F.sum(f).alias(f) for f in faults))


def repair(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation with a row: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, by name ``conv``.

    ``illegal`` counts neighbours whose role initials are none of su, ua, au. ``audit`` holds the initials of the cheapest edits in
    order, of those the least as text; ``repaired_sha256`` is the hash of the repaired turns (``role:text``, one a line). Odd input is
    defined by ``number_turns``; extra columns are not read; an empty table gives no rows. A conversation of any
    length is read in blocks; its audit and hash are one row.
    """
    rows = number_turns(turns, key)
    numbered = materialize(rows.drop("role", "text"), "numbered")  # all but the texts
    sizes = numbered.groupBy("conv").agg(F.max("block").alias("final"))
    slim = numbered.select("conv", "block", "idx", "initial", "gone", "unended").join(sizes, "conv").withColumn("last", F.col("block") == F.col("final"))
    # only conversations of several blocks need what follows a block, and the state before it
    costs = _by_block(slim.where("final > 0")).mapInArrow(_block_matrices, "conv string, block long, costs array<long>")
    exits = materialize(costs.groupBy("conv").applyInArrow(_chain_exits, "conv string, block long, exits array<long>"), "exits")
    found = materialize(_by_block(slim.join(exits, ["conv", "block"], "left")).mapInArrow(_audits, _FOUND), "audits")
    chained = found.where("block > 0 or not last").select("conv", "block", "reached", "head", "tail").groupBy("conv")
    states = chained.applyInArrow(_chain_states, "conv string, block long, state int, seam long")
    pieces = found.join(states, ["conv", "block"], "left").select(
        "conv", "block", F.when(F.col("block") == 0, F.col("cost")).alias("cost"), (F.col("illegal") + F.coalesce("seam", F.lit(0))).alias("illegal"),
        F.get("audits", F.coalesce("state", F.lit(0))).alias("audit"),
    )
    pieces = materialize(pieces, "pieces")
    nothing = F.lit("")
    marks = pieces.select("conv", F.col("block") * BLOCK, F.lit(True), "audit", nothing, nothing)
    stream = marks.union(rows.select("conv", "idx", F.lit(False), nothing, "role", "text")).toDF("conv", "idx", "mark", "audit", "role", "text")
    stream = stream.repartition("conv").sortWithinPartitions("conv", "idx", F.desc("mark"))
    repaired = stream.mapInArrow(_apply, "conv string, audit string, repaired_sha256 string")
    totals = pieces.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    return summarize(numbered).join(totals, "conv").join(repaired, "conv")


def damage(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns with faults by the crc32 of ``key:turn`` modulo 20: 0 drops, 1 empties, 2 takes sentence ends, 3 repeats, 4 sets role user.

    Nulls count as one space, in the hash, in roles and in texts.
    """
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    case, role, text = F.crc32(named.cast("binary")) % 20, F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select(
        F.col(f"`{key}`"), "turn", F.when(case == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.array_repeat(F.lit(0), F.when(case == 0, 0).when(case == 3, 2).otherwise(1)).alias("copies"),
    )
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")
