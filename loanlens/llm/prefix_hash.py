"""Document fingerprints by prefix polynomial hashes.

The hash of a text is the polynomial of its code points at a fixed base, modulo a prime. From the array of all its prefixes'
hashes the hash of any span follows by one subtraction, so spans of one text or of two can be compared wherever they
lie, and the longest common extension of two places is found by binary search over span lengths.

A fingerprint keeps a bounded part of these arrays: the hashes of the leading and of the trailing spans whose lengths are
multiples of a stride. The stride is a power of two, so fingerprints of texts of different lengths share lengths, and the
longest common extensions from both ends of two texts follow from their fingerprints alone, up to a stride.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import slices

#: Two primes below 2**31, so that products of residues fit in 64 bits, and the bases.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_270_425_523, 864_197_531)
#: Most leading (and most trailing) spans in a fingerprint; likeness is exact up to one part in so many of the text.
SPANS = 32


class _Powers:
    """Powers of a base and of its inverse modulo a prime, as far as the longest text so far."""

    def __init__(self, base: int, prime: int):
        self.prime, self.steps = prime, (base, pow(base, -1, prime))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def reach(self, n: int) -> None:
        while len(self.tables[0]) <= n:
            have = len(self.tables[0])
            self.tables = [np.concatenate([t, t * np.uint64(pow(s, have, self.prime)) % np.uint64(self.prime)]) for t, s in zip(self.tables, self.steps)]


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Prefixes:
    """Prefix hashes of a text of ``n`` code points: ``sums[k][i]`` belongs to the first ``i`` of them and the ``k``-th prime."""

    def __init__(self, points: np.ndarray, before: Prefixes | None = None, keep: int = 0):
        """With ``before``: the text that keeps its first ``keep`` code points and goes on with ``points``."""
        self.n = keep + len(points)
        self.sums = []
        for k, powers in enumerate(_POWERS):
            powers.reach(self.n)
            prime = np.uint64(powers.prime)
            grown = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(points * powers.tables[0][keep : self.n] % prime, out=grown[1:])
            if before is not None:
                grown += before.sums[k][keep]
                grown = np.concatenate([before.sums[k][:keep], grown])
            self.sums.append(grown % prime)

    def span(self, start, length, primes: int = 2):
        """Hash of a span, or of arrays of spans; the same wherever equal code points lie."""
        out = np.uint64(0)
        for powers, sums in list(zip(_POWERS, self.sums))[:primes]:
            prime = np.uint64(powers.prime)
            out = (out << np.uint64(31)) | ((sums[start + length] + prime - sums[start]) * powers.tables[1][start] % prime)
        return out

    def equal(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        """Whether two spans hold the same code points (but for a chance of about ``length / 2**62``)."""
        return self.span(start, length) == other.span(at, length)

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest equal spans from two places on."""
        return _longest(min(self.n - start, other.n - at), lambda length: self.equal(start, other, at, length))

    def extension_back(self, end: int, other: Prefixes, at: int) -> int:
        """Length of the longest equal spans up to two places."""
        return _longest(min(end, at), lambda length: self.equal(end - length, other, at - length, length))


def _longest(most: int, holds) -> int:
    """Largest number up to ``most`` for which ``holds``, which is true below its first failure."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if holds(middle) else (low, middle - 1)
    return low


class Fingerprint(NamedTuple):
    n: int
    whole: int
    leading: list[int]
    trailing: list[int]

    @property
    def stride(self) -> int:
        return _stride(self.n)

    def text(self) -> str:
        return f"{self.n:x}.{self.whole:016x}.{_hex(self.leading)}.{_hex(self.trailing)}"


def _stride(n: int) -> int:
    return 1 << max(0, (-(-n // SPANS) - 1).bit_length())


def _hex(values: list[int]) -> str:
    return np.array(values, ">u4").tobytes().hex()


def parse(text: str) -> Fingerprint:
    n, whole, leading, trailing = text.split(".")
    return Fingerprint(int(n, 16), int(whole, 16), *(np.frombuffer(bytes.fromhex(h), ">u4").tolist() for h in (leading, trailing)))


def fingerprint(prefixes: Prefixes) -> Fingerprint:
    n, stride = prefixes.n, _stride(prefixes.n)
    lengths = np.arange(1, n // stride + 1) * stride
    return Fingerprint(
        n, int(prefixes.span(0, n)), prefixes.span(np.zeros_like(lengths), lengths, 1).tolist(), prefixes.span(n - lengths, lengths, 1).tolist()
    )


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the longer text that lies in the common extensions from both ends; 1 for equal texts, empty ones included."""
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    stride, short = max(a.stride, b.stride), min(a.n, b.n)
    in_a, in_b = stride // a.stride, stride // b.stride

    def common(x: list[int], y: list[int]) -> int:
        return stride * _longest(short // stride, lambda k: x[k * in_a - 1] == y[k * in_b - 1])

    return min(short, common(a.leading, b.leading) + common(a.trailing, b.trailing)) / max(a.n, b.n)


# ---- tables ----


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint`` (in the place of one of that name). Null counts as the empty text."""
    names = [c for c in docs.columns if c != "fingerprint"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(Prefixes(code_points(t or ""))).text() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("row"), pa.array(found, pa.string())], names=["row", "fingerprint"])

    made = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, fingerprint string")
    return made.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "fingerprint")


def common_extensions(pairs: DataFrame) -> DataFrame:
    """``pairs (a, at_a, b, at_b, ...)`` with ``forward`` and ``backward``: code points that the texts share from these places on, and up to them.

    Places count from 0 and may lie at a text's end; null texts are empty, null places 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            forward, backward = [], []
            for a, i, b, j in zip(*(batch.column(c).to_pylist() for c in ("a", "at_a", "b", "at_b"))):
                x, y = Prefixes(code_points(a or "")), Prefixes(code_points(b or ""))
                forward.append(x.extension(i or 0, y, j or 0))
                backward.append(x.extension_back(i or 0, y, j or 0))
            columns = [*batch.columns, pa.array(forward, pa.int64()), pa.array(backward, pa.int64())]
            yield pa.record_batch(columns, names=[*batch.schema.names, "forward", "backward"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{fields}, forward long, backward long")


class _Text:
    """A document met in order, with what its neighbour needs of it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.points = code_points(self.text)
        self.prefixes = Prefixes(self.points)
        self.print = fingerprint(self.prefixes)


_EDITED = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(key: int | None, this: _Text, following: _Text) -> tuple:
    n = len(this.points)
    keep, head = n - n // 4, n // 4
    edited = this.text[:keep] + following.text[:head]
    other = fingerprint(Prefixes(following.points[:head], this.prefixes, keep))
    return (
        key, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), this.print.text(), other.text(),
        likeness(this.print, other), likeness(this.print, following.print),
    )


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _EDITED.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    held: tuple[int | None, _Text] | None = None
    for batch in slices(batches, 256):
        rows = []
        for key, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "ahead"))):
            this = _Text(text)
            if held is not None:
                rows.append(_compare(*held, this))
            held = None if ahead else (key, this)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document.

    The last quarter of the code points of a text is replaced by the first as many (or all) of the next document; after the last
    comes the first. Documents ascend by ``key`` (an integer; null first), those of equal keys by text, null first; repeated
    rows are documents of their own. A single document follows itself; an empty table gives no rows; null texts
    are empty. Other columns are not read.

    Texts are shuffled once, into ranges of keys (as many as shuffle partitions). Each range ends with a copy of the first
    document of the next one, so a task reads its sorted rows as a stream and holds two texts at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bounds of the ranges: one number per partition
    quantiles = rows.stat.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.unique(np.array(quantiles, np.int64))

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right"), pa.int32())

    placed = rows.withColumn("part", range_of("key"))
    least = placed.groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("least"))
    firsts = sorted((r["part"], r["least"]["key"]) for r in least.collect())  # at most one row per range
    if not firsts:
        return spark.createDataFrame([], _EDITED.replace("key", f"`{key}`", 1))
    before = {part: firsts[i - 1][0] for i, (part, _) in enumerate(firsts)}
    known = [k for _, k in firsts if k is not None]
    own = rows.where(F.col("key").isin(known) | (F.col("key").isNull() & F.lit(len(known) < len(firsts))))
    heads = own.groupBy("key").agg(F.min(F.struct(F.col("text").isNotNull().alias("known"), "text")).alias("first"))
    target = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    heads = heads.withColumn("part", range_of("key")).select("key", "first.text", target[F.col("part")].alias("part"), F.lit(True).alias("ahead"))
    dealt = placed.withColumn("ahead", F.lit(False)).unionByName(heads)
    ordered = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions(
        "part", "ahead", F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    return ordered.mapInArrow(_compare_neighbours, _EDITED).withColumnRenamed("key", key)
