"""Helpers shared by the training-data operators."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what is held at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and, per node, the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        label = label[label]
        if np.array_equal(label, before):
            return nodes, nodes[label]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of key-sorted batches, regrouped so that no group of equal keys is cut."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {n: to_numpy(batch.column(i)) for i, n in enumerate(batch.schema.names)}
        held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in new}
        rows = len(held[keys[0]])
        same = np.ones(rows, bool)
        for k in keys:
            same &= held[k] == held[k][-1]
        cut = int(np.argmin(same[::-1]))  # length of the last group; 0: one group only
        if not cut:
            continue
        yield {n: v[: rows - cut] for n, v in held.items()}
        held = {n: v[rows - cut :] for n, v in held.items()}
    if held is not None:
        yield held


def to_numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def starts_of(keys: list[np.ndarray]) -> np.ndarray:
    """Positions at which a new group of sorted rows begins."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``start, start + 1, ...`` of each length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def hash_sample(rows: DataFrame, group: str, key: str, per_group: int | dict) -> DataFrame:
    """About ``per_group`` rows (one number, or one per group) of each non-null ``group``: those with small hashes of ``key``.

    The bound follows from the group's count, so only counts are shuffled. Rows with equal keys come or stay
    together; a final limit of twice the number guards against repeated keys.
    """
    counts = rows.where(F.col(group).isNotNull()).groupBy(group).count().collect()  # one row per group
    place = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    keep, most = F.lit(False), 0
    for r in counts:
        wanted = per_group if isinstance(per_group, int) else per_group.get(r[group], 0)
        most += wanted
        bound = (1 << 63) - 1 if r["count"] <= wanted else int((wanted / r["count"] - 0.5) * 2.0**64)
        keep = keep | ((F.col(group) == F.lit(r[group])) & (place <= F.lit(bound)))
    return rows.where(keep).limit(max(1, 2 * most))
