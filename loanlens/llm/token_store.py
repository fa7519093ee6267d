"""Token ids in files of directly addressable codes.

An id is cut into chunks of bits, lowest first, one level per chunk. Level 0 holds a chunk of every id; a
continuation bitmap marks the ids that go on, and level 1 holds the next chunk of those, and so forth. A rank
directory counts the marks before each block of the bitmap, so the place of an id's next chunk, and with it
any single token, is found without decoding others.

File: ``DACF``, header length (8 bytes), JSON header, then 8-byte-aligned sections named in the header:
``docs`` (keys), ``ends`` (tokens up to each document's end), and ``chunks<k>``, ``more<k>``, ``rank<k>``.
"""

import json
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import slices
from loanlens.llm.tokens import encoder
from loanlens.session import materialize, scratch_path

MAGIC = b"DACF"
#: Tokens after which a file is closed (documents stay whole), and bits of a bitmap block.
FILE_TOKENS, RANK_BITS = 4_000_000, 512
MAX_LEVELS = 3
_STEP = 1 << 18


def level_widths(bit_lengths: np.ndarray) -> list[int]:
    """Chunk widths with the fewest bits in all; ``bit_lengths[n]`` ids need ``n`` bits."""
    most = max(1, int(np.flatnonzero(bit_lengths)[-1])) if bit_lengths.any() else 1
    over = np.concatenate([np.cumsum(bit_lengths[::-1])[::-1][1:], [0]])  # ids that need more than n bits
    best: tuple[int, list[int]] | None = None
    for levels in range(1, MAX_LEVELS + 1):
        for cuts in combinations(range(1, most), levels - 1):
            edges = [0, *cuts, most]
            size = sum((bit_lengths.sum() if a == 0 else over[a]) * (b - a + (b < most)) for a, b in zip(edges, edges[1:]))
            if best is None or size < best[0]:
                best = (size, [b - a for a, b in zip(edges, edges[1:])])
    return best[1]


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits each, lowest bit first."""
    parts = []
    for at in range(0, len(values), _STEP):  # a multiple of 8 values fills whole bytes
        bits = np.unpackbits(values[at : at + _STEP].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
        parts.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(parts)


def _unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.empty(n, np.uint32)
    for at in range(0, n, _STEP):
        m = min(_STEP, n - at)
        bits = np.unpackbits(data[at * width // 8 : (at * width + m * width + 7) // 8], count=m * width, bitorder="little").reshape(m, width)
        whole = np.zeros((m, 32), np.uint8)
        whole[:, :width] = bits
        out[at : at + m] = np.packbits(whole, axis=1, bitorder="little").view("<u4")[:, 0]
    return out


def to_file(keys: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file; ``ends`` counts the tokens up to the end of each document."""
    lengths = np.zeros(33, np.int64)
    for n in range(33):
        lengths[n] = int((ids < (1 << n)).sum()) if n < 32 else len(ids)
    lengths = np.diff(lengths, prepend=0)
    widths = level_widths(lengths)
    sections = {"docs": np.array([0 if k is None else k for k in keys], "<i8").tobytes(), "ends": ends.astype("<i8").tobytes()}
    counts, rest = [], ids
    for level, width in enumerate(widths):
        counts.append(len(rest))
        sections[f"chunks{level}"] = _pack(rest & np.uint32((1 << width) - 1), width)
        if level + 1 < len(widths):
            more = (rest >> np.uint32(width)) > 0
            blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            sections[f"more{level}"] = np.packbits(more, bitorder="little").tobytes()
            sections[f"rank{level}"] = (np.cumsum(blocks) - blocks).astype("<u4").tobytes()
            rest = rest[more] >> np.uint32(width)
    places, at, body = {}, 0, []
    for name, data in sections.items():
        places[name] = [at, len(data)]
        body.append(data + b"\0" * (-len(data) % 8))
        at += len(body[-1])
    header = json.dumps({"nulls": [i for i, k in enumerate(keys) if k is None], "widths": widths, "counts": counts, "places": places}).encode()
    header += b" " * (-(len(header) + 12) % 8)
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *body])


class TokenFile:
    """Reads a file's bytes (or memory map): any token, any range, any document."""

    def __init__(self, data):
        self.data = np.frombuffer(data, np.uint8)
        if self.data[:4].tobytes() != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(self.data[4:12].tobytes(), "little")
        header = json.loads(self.data[12 : 12 + size].tobytes())
        self.widths, self.counts, self.base, self.places = header["widths"], header["counts"], 12 + size, header["places"]
        self.ends, nulls = self._section("ends").view("<i8"), set(header["nulls"])
        self.keys = [None if i in nulls else k for i, k in enumerate(self._section("docs").view("<i8").tolist())]

    def _section(self, name: str) -> np.ndarray:
        at, size = self.places[name]
        return self.data[self.base + at : self.base + at + size]

    def __len__(self) -> int:
        return self.counts[0]

    def _chunk(self, level: int, i: int) -> int:
        width = self.widths[level]
        at = i * width
        raw = int.from_bytes(self._section(f"chunks{level}")[at // 8 : (at + width + 7) // 8].tobytes(), "little")
        return (raw >> (at % 8)) & ((1 << width) - 1)

    def token(self, i: int) -> int:
        """Token ``i``, from its own chunks only."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        out = shift = level = 0
        while True:
            out |= self._chunk(level, i) << shift
            if level + 1 == len(self.widths):
                return out
            marks = self._section(f"more{level}")
            if not marks[i // 8] >> (i % 8) & 1:
                return out
            shift, i, level = shift + self.widths[level], self._rank(level, marks, i), level + 1

    def _rank(self, level: int, marks: np.ndarray, i: int) -> int:
        """Marks before place ``i``: the directory's count and those in the block."""
        block = i // RANK_BITS
        before = int(self._section(f"rank{level}").view("<u4")[block])
        bits = int.from_bytes(marks[block * RANK_BITS // 8 : i // 8 + 1].tobytes(), "little")
        return before + (bits & ((1 << (i - block * RANK_BITS)) - 1)).bit_count()

    def tokens(self) -> np.ndarray:
        """All tokens at once."""
        out, where, shift = np.zeros(len(self), np.uint32), np.arange(len(self)), 0
        for level, (width, n) in enumerate(zip(self.widths, self.counts, strict=True)):
            out[where] |= _unpack(self._section(f"chunks{level}"), n, width) << np.uint32(shift)
            shift += width
            if level + 1 < len(self.widths):
                where = where[np.unpackbits(self._section(f"more{level}"), count=n, bitorder="little").astype(bool)]
        return out

    def document(self, k: int) -> list[int]:
        """The tokens of document ``k`` of the file by random access."""
        return [self.token(i) for i in range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes every text (null: empty), appends ``end_id``, and writes files in ascending order of ``key``.

    ``key`` is an integer; nulls come first, equal keys stand next to each other in order of their texts. The
    result lists the files that count: ``part``, ``seq``, ``file``, ``docs``, ``tokens``. Names are unique per
    attempt, so what a lost or repeated task leaves behind is listed nowhere. An empty table gives no file.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = picked.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.uint32(end_id).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal seq
            ends = np.cumsum([len(h) // 4 for h in held])
            data = to_file(keys, ends, np.frombuffer(b"".join(held), "<u4"))
            name = f"{folder}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            store, path = _store(name)
            with store.open_output_stream(path) as out:
                out.write(data)
            made = {"part": part, "seq": seq, "file": name, "docs": len(keys), "tokens": int(ends[-1])}
            seq += 1
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([made], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        size = 0
        for batch in slices(batches, 256):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                held.append(encode(t) + end)
                size += len(held[-1]) // 4
                if size >= file_tokens:
                    yield close()
                    size = 0
        if held:
            yield close()

    return materialize(ordered.mapInArrow(rows, "part int, seq int, file string, docs long, tokens long"), "files")


def with_starts(files: DataFrame) -> DataFrame:
    """``files`` with ``start``: tokens in the files before. Totals per part are summed first."""
    parts = files.groupBy("part").agg(F.sum("tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    base = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = files.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return own.join(base, "part").withColumn("start", (F.col("base") + F.col("inner")).cast("long")).drop("base", "inner")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Per document, from the files: ``key``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids`` (little-endian)."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    listed = with_starts(files).select("file", "start").repartition("file")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = _store(file)
                with store.open_input_file(path) as source:
                    found = TokenFile(source.read())
                ids, ends = found.tokens().astype("<u4").tobytes(), found.ends.tolist()
                begins = [0, *ends[:-1]]
                for at in range(0, len(ends), 1024):
                    own = list(zip(found.keys[at : at + 1024], begins[at : at + 1024], ends[at : at + 1024], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k for k, _, _ in own], pa.int64()), pa.array([start + b for _, b, _ in own], pa.int64()),
                            pa.array([e - b for _, b, e in own], pa.int64()), pa.array([ids[4 * b : 4 * e] for _, b, e in own], pa.binary()),
                        ],
                        schema=schema,
                    )

    return listed.mapInArrow(rows, "key long, start long, n_tokens long, ids binary")
