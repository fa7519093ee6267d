"""Packing of documents into sequences of a fixed length, online and in bounded space.

Every task keeps a fixed number of open windows. A piece goes where it fits best; if it fits nowhere, the
fullest window is emitted (its gap is first filled by cutting the piece, if the gap is worth a cut) and a new
one opened. What is still open when a task ends is merged: the leftovers of 64 tasks are laid end to end and
cut at full windows, so each such group leaves one padded sequence.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import slices
from loanlens.llm.tokens import encoder
from loanlens.session import materialize

#: Tokens of a sequence, windows open at a time, and the smallest gap that is filled by cutting a piece.
LENGTH, WINDOWS, LEAST_CUT = 2048, 64, 32
#: Tasks whose leftovers are merged in one place: at most 64 x 64 windows.
MERGED_TASKS = 64

_SCHEMA = pa.schema([
    ("key", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("window", pa.int64()),
    ("offset", pa.int32()), ("open", pa.bool_()), ("ids", pa.binary()),
])
_PIECES = "key long, start long, doc_tokens long, part int, window long, offset int, open boolean, ids binary"


class Packer:
    """Places pieces ``(key, start, doc_tokens, ids)`` one after another; ids are 4 bytes each."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS, least_cut: int = LEAST_CUT):
        self.length, self.windows, self.least_cut = length, windows, least_cut
        self.open: list[list] = []  # free tokens, pieces
        self.done: list[list[tuple]] = []

    def add(self, key, ids: bytes) -> None:
        """A document, cut into full sequences from its front and a rest."""
        total = len(ids) // 4
        at = 0
        while total - at >= self.length:
            self.done.append([(key, at, total, ids[4 * at : 4 * (at + self.length)])])
            at += self.length
        while at < total:
            at += self._place(key, at, total, ids[4 * at :])

    def _place(self, key, start: int, total: int, ids: bytes) -> int:
        size = len(ids) // 4
        best = None
        for window in self.open:
            if size <= window[0] and (best is None or window[0] < best[0]):
                best = window
        if best is None and len(self.open) == self.windows:
            fullest = min(self.open, key=lambda w: w[0])
            if fullest[0] >= self.least_cut:
                best, size = fullest, fullest[0]
            else:
                self._emit(fullest)
        if best is None:
            best = [self.length, []]
            self.open.append(best)
        best[0] -= size
        best[1].append((key, start, total, ids[: 4 * size]))
        if not best[0]:
            self._emit(best)
        return size

    def _emit(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.done.append(window[1])


def _batches(part: int, first: int, windows: list[list[tuple]], still_open: bool) -> Iterator[pa.RecordBatch]:
    rows = []
    for n, pieces in enumerate(windows):
        offset = 0
        for key, start, total, ids in pieces:
            rows.append((key, start, total, part, first + n, offset, still_open, ids))
            offset += len(ids) // 4
    for at in range(0, len(rows), 2048):
        columns = zip(*rows[at : at + 2048], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", length: int = LENGTH, windows: int = WINDOWS) -> DataFrame:
    """Pieces of all documents: ``key``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    Every id of every document (null text: only ``end_id``) lies in one piece; ``ids`` are little-endian 32-bit
    integers; offsets in a sequence begin at 0 without gaps. Repeated and null keys are documents of their own.
    Sequence ids below 2^62 come from one task each, those above from merged leftovers.
    """
    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(tokenizer).encode, np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        packer, made = Packer(length, windows), 0
        for batch in slices(batches, 128):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(k, encode(t) + end)
            yield from _batches(part, made, packer.done, False)
            made += len(packer.done)
            packer.done = []
        yield from _batches(part, made, [w[1] for w in packer.open], True)

    placed = materialize(picked.mapInArrow(rows, _PIECES), "pieces")
    group = F.floor(F.col("part") / MERGED_TASKS)
    left = placed.where("open").withColumn("group", group.cast("int")).repartition("group").sortWithinPartitions("group", "part", "window", "offset")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, window, offset, out = None, 0, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group:
                    group, window, offset = r["group"], 0, 0
                at, ids = 0, r["ids"]
                while at < len(ids) // 4:
                    size = min(length - offset, len(ids) // 4 - at)
                    out.append((r["key"], r["start"] + at, r["doc_tokens"], group, window, offset, True, ids[4 * at : 4 * (at + size)]))
                    at, offset = at + size, offset + size
                    if offset == length:
                        window, offset = window + 1, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                out = []

    tail = left.mapInArrow(merged, _PIECES)
    sequence = F.shiftleft(F.col("part").cast("long"), 32) + F.col("window") + F.when(F.col("open"), F.lit(1 << 62)).otherwise(F.lit(0))
    return placed.where("not open").unionByName(tail).select(
        F.col("key").alias(key), "start", (F.length("ids") / 4).cast("long").alias("length"), "doc_tokens",
        sequence.alias("sequence_id"), F.col("offset").cast("long").alias("offset"), "ids",
    )
