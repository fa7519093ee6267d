"""Merkle manifest of a data set whose nodes keep SHA-256 midstates.

Leaves of each group form a tree of eight children a node; the groups' roots, in the order of their names, form the tree
of the whole set. A parent keeps a copy of its hash state before each child slot. To fold a replaced child upwards,
its slot's state is resumed with the replacement and the right siblings only; what lies left is never hashed again.

Leaves are numbered by range partitions and cut into blocks of 4,096 places. One task builds the nodes of a block,
whatever group it belongs to; the blocks' roots are the leaves of the next round, so the number of rounds is the
logarithm of the largest group to the base 4,096. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm import sha256
from loanlens.operators.ordered import with_group_index, with_row_index
from loanlens.session import materialize

FAN_OUT = 8
#: Levels built by one task; a block has so many leaves that its root is one node.
BLOCK_LEVELS = 4
_STEP = np.dtype([("slot", "u1"), ("count", "u1"), ("state", "<u4", 8), ("children", "<u4", (FAN_OUT, 8))])
_RECORD = "tree string, block long, n long, height int, nodes binary, states binary, root binary"


# ---- nodes of one block ----


def parents(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parents of a level: their digests, the states before each of their slots, and their numbers of children."""
    n = -(-len(nodes) // FAN_OUT)
    counts = np.minimum(FAN_OUT, len(nodes) - FAN_OUT * np.arange(n))
    state, kept = sha256.initial(n), np.zeros((n, FAN_OUT, 8), np.uint32)
    for slot, child in enumerate(_padded(nodes).swapaxes(0, 1)):
        kept[:, slot] = state
        sha256.absorb_where(state, child, slot < counts)
    return sha256.finish(state, counts), kept, counts


def _padded(nodes: np.ndarray) -> np.ndarray:
    """Children of each parent: parents x slots x words."""
    out = np.zeros((-(-len(nodes) // FAN_OUT) * FAN_OUT, 8), np.uint32)
    out[: len(nodes)] = nodes
    return out.reshape(-1, FAN_OUT, 8)


def grow(leaves: np.ndarray, whole: bool, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Up to ``most`` levels above ``leaves``, and the parents' states. A block that is one of several (``whole``) has all its levels."""
    levels, states = [leaves], []
    while len(states) < most and (whole or len(levels[-1]) > 1):
        up, kept, _ = parents(levels[-1])
        levels.append(up)
        states.append(kept)
    return levels, states


def _sizes(n: int, height: int) -> list[int]:
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // FAN_OUT))
    return out


def _steps(record: dict, places: np.ndarray) -> list[np.ndarray]:
    """What each place of a record meets on its way to the record's root, one array per level."""
    sizes = _sizes(record["n"], record["height"])
    nodes, states = sha256.from_bytes(record["nodes"]), sha256.from_bytes(record["states"]).reshape(-1, FAN_OUT, 8)
    out, low, above = [], 0, 0
    for size, ups in zip(sizes, sizes[1:]):
        slot, up = places % FAN_OUT, places // FAN_OUT
        step = np.zeros(len(places), _STEP)
        step["slot"], step["count"] = slot, np.minimum(FAN_OUT, size - FAN_OUT * up)
        step["state"], step["children"] = states[above + up, slot], _padded(nodes[low : low + size])[up]
        out.append(step)
        low, above, places = low + size, above + ups, up
    return out


def resume(step: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """The parents' digests after their children at ``slot`` have become ``digest``."""
    state = step["state"].astype(np.uint32)
    for slot in range(FAN_OUT):
        child = np.where((step["slot"] == slot)[:, None], digest, step["children"][:, slot])
        sha256.absorb_where(state, child, (slot >= step["slot"]) & (slot < step["count"]))
    return sha256.finish(state, step["count"])


def add_siblings(step: np.ndarray, state: np.ndarray) -> None:
    """Feed the siblings of each row, left to right, to its state."""
    for slot in range(FAN_OUT):
        sha256.absorb_where(state, step["children"][:, slot], (slot != step["slot"]) & (slot < step["count"]))


# ---- rounds of blocks ----


def _build_block(table: pa.Table, most: int) -> pa.Table:
    order = np.argsort(table["pos"].to_numpy())
    leaves = sha256.from_bytes(b"".join(table["digest"].to_pylist()))[order]
    block = table["block"][0].as_py()
    levels, states = grow(leaves, block > 0, most)
    return pa.table({
        "tree": pa.array([table["tree"][0].as_py()], pa.string()), "block": pa.array([block], pa.int64()), "n": pa.array([len(leaves)], pa.int64()),
        "height": pa.array([len(states)], pa.int32()), "nodes": pa.array([b"".join(map(sha256.to_bytes, levels))], pa.binary()),
        "states": pa.array([b"".join(map(sha256.to_bytes, states))], pa.binary()), "root": pa.array([sha256.to_bytes(levels[-1])], pa.binary()),
    })


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / FAN_OUT**levels)


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Records of the blocks over ``nodes (tree, pos, digest)``, then of those over their roots, until each tree is one block.

    Positions count from 0 within a tree. Which block a node lies in follows from its position, so a tree of any size is
    dealt over many tasks.
    """
    out = []
    while True:
        groups = nodes.withColumn("block", _block(levels)).groupBy("tree", "block")

        def grown(table: pa.Table) -> pa.Table:
            return _build_block(table, levels)

        records = materialize(groups.applyInArrow(grown, _RECORD), "merkle")
        out.append(records)
        if records.where("block > 0").isEmpty():
            return out
        nodes = records.select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"))


def _open_records(carried: list[str], levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                steps = _steps(record, np.arange(record["n"]))
                own = [b"".join(s[i].tobytes() for s in steps) for i in range(record["n"])]
                first = record["block"] * FAN_OUT**levels
                columns = {
                    "tree": [record["tree"]] * record["n"], "pos": range(first, first + record["n"]), "path": [p + record["path"] for p in own],
                    **{c: [record[c]] * record["n"] for c in carried},
                }
                types = [pa.string(), pa.int64(), *[pa.binary()] * (1 + len(carried))]
                yield pa.record_batch([pa.array(list(v), t) for v, t in zip(columns.values(), types)], names=list(columns))

    return run


def _descend(rounds: list[DataFrame], paths: DataFrame, carried: list[str], levels: int) -> DataFrame:
    """``paths (tree, path, ...)`` of whole trees, taken down to the blocks of the first round: ``(tree, block, path, ...)``."""
    paths = paths.withColumn("block", F.lit(0).cast("long"))
    for records in reversed(rounds[1:]):
        schema = "tree string, pos long, path binary" + "".join(f", {c} binary" for c in carried)
        opened = records.join(paths, ["tree", "block"]).select(*records.columns, "path", *carried)
        paths = opened.mapInArrow(_open_records(carried, levels), schema).withColumnRenamed("pos", "block")
    return paths


@dataclass
class Manifest:
    """``leaves``: all columns of the rows, with ``tree`` (their group's name) and ``pos``. ``blocks``: the records of the leaves' blocks
    with the path from each block to the root, and both roots. ``rounds``, ``top``: the records of all nodes of the groups'
    trees and of the tree over them, in blocks of so many ``levels``."""

    leaves: DataFrame
    blocks: DataFrame
    rounds: list[DataFrame]
    top: list[DataFrame]
    levels: int


def group_name(group: Column) -> Column:
    """A name that is never null and keeps the order: null first, then by bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def build(rows: DataFrame, key: str = "doc_id", group: str = "lang", leaf: str = "leaf", levels: int = BLOCK_LEVELS) -> Manifest:
    """Manifest of ``rows`` with a digest (binary, 32 bytes) in ``leaf``.

    Within a group leaves ascend by ``key``, null first; rows of equal keys by their digest, so repeated rows are leaves of
    their own and the root does not depend on their order. A null group is a group. An empty table has no blocks
    and no root. Extra columns of any name stay in ``leaves``, except that ``tree`` and ``pos`` are added in the place of equal names.
    """
    packed = rows.select(
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), group_name(F.col(f"`{group}`")).alias("tree"),
        F.col(f"`{key}`").alias("key"), F.col(f"`{leaf}`").alias("digest"),
    )
    placed = materialize(with_group_index(packed, ["tree"], ["key", "digest"], "pos").withColumn("pos", F.col("pos") - 1), "leaves")
    rounds = _rounds(placed.select("tree", "pos", "digest"), levels)
    names = materialize(with_row_index(rounds[-1].select(F.col("tree").alias("name"), F.col("root").alias("digest")), ["name"], "pos"), "groups")
    top = _rounds(names.select(F.lit("").alias("tree"), "pos", "digest"), levels)

    start = top[-1].select("tree", F.lit(b"").alias("path"), F.col("root").alias("whole"))
    over = _descend(top, start, ["whole"], levels)
    opened = top[0].join(over, ["tree", "block"]).select(*top[0].columns, "path", "whole")
    over = opened.mapInArrow(_open_records(["whole"], levels), "tree string, pos long, path binary, whole binary").drop("tree")
    over = over.join(names, "pos").select(F.col("name").alias("tree"), "path", "whole", F.col("digest").alias("part"))
    down = _descend(rounds, over, ["whole", "part"], levels)
    blocks = materialize(rounds[0].join(down, ["tree", "block"]), "paths")
    return Manifest(placed, blocks, rounds, top, levels)


def _fold_block(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
    record = blocks.to_pylist()[0]
    places = leaves["place"].to_numpy()
    digest = sha256.from_bytes(b"".join(leaves["now"].to_pylist()))
    state, hashed = sha256.initial(len(places)), np.zeros(len(places), np.int64)
    upper = np.frombuffer(record["path"], _STEP)
    for step in [*_steps(record, places), *(np.repeat(upper[i : i + 1], len(places)) for i in range(len(upper)))]:
        digest = resume(step, digest)
        add_siblings(step, state)
        hashed += step["count"].astype(np.int64) - 1
    out = leaves.select(["row"])
    for name, values in {
        "subroot": [record["part"].hex()] * len(places), "root": [record["whole"].hex()] * len(places),
        "proof_sha256": sha256.to_hex(sha256.finish(state, hashed)), "folded_root": sha256.to_hex(digest),
    }.items():
        out = out.append_column(name, pa.array(values, pa.string()))
    return out


def fold(manifest: Manifest, now: str) -> DataFrame:
    """Root that each leaf alone would give if it were ``now`` (a digest column of the rows; null: as it is).

    Returns the rows as ``row``, with ``subroot`` and ``root`` of the manifest, ``proof_sha256`` (the hash of all siblings on the way up,
    level by level, left to right) and ``folded_root``, all in hexadecimal. Only the states kept before the leaf's slots, the
    replacement and right siblings are hashed for the root.
    """
    place = F.col("pos") % FAN_OUT**manifest.levels
    leaves = manifest.leaves.select("row", "tree", _block(manifest.levels).alias("block"), place.alias("place"), F.coalesce(f"row.`{now}`", "digest").alias("now"))
    rows = leaves.schema["row"].dataType.simpleString()
    schema = f"row {rows}, subroot string, root string, proof_sha256 string, folded_root string"
    return leaves.groupBy("tree", "block").cogroup(manifest.blocks.groupBy("tree", "block")).applyInArrow(_fold_block, schema)


# ---- documents ----


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """Digest (binary) of the fields."""
    return F.unhex(F.sha2(F.concat(*(field(v) for v in values)), 256))
