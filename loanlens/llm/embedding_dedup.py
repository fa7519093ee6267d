"""Near-duplicate embeddings by an inverted multi-index.

Vectors are scaled to length one and cut into two halves, each with its own codebook; the pairs of codewords
form a grid of cells, and every vector lies in one. A query walks the cells by rising sum of its two distances
(multi-sequence order) and compares itself exactly with all members of the cells it visits. How many cells it
visits is fitted: pairs made at the similarity threshold itself, the hardest that count, shall be met from one
side or the other with a target recall.

Equal vectors are one class throughout, so copies multiply no work and no pairs.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import local_components, slices, starts_of, whole_groups
from loanlens.llm.components import components
from loanlens.session import materialize

#: Classes per cell on average, codewords of a half at most, vectors that codebooks and traversal are fitted on.
CELL_MEMBERS, MAX_CODEWORDS, FIT_SAMPLE = 16, 1024, 8192
TARGET_RECALL = 0.98
#: Members and queries of a block that are compared in one place.
MEMBERS, QUERIES = 4096, 16384
_SEED = 7


def _codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced starting points; an empty cluster keeps its centre."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = _distances(points, centres).argmin(axis=1)
        n = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


class MultiIndex:
    """Two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, classes: int, threshold: float, recall: float = TARGET_RECALL):
        x = sample / np.linalg.norm(sample, axis=1)[:, None]
        self.cut = x.shape[1] // 2
        k = int(np.clip(round((classes / CELL_MEMBERS) ** 0.5), 1, min(MAX_CODEWORDS, len(x))))
        self.books = _codebook(x[:, : self.cut], k), _codebook(x[:, self.cut :], k)
        self.visits = self._fit(x[: 8 * 256], threshold, recall)
        a = np.arange(1, k + 1)
        self.grid = np.argwhere(np.outer(a, a) <= self.visits)  # ranks that the first `visits` cells can have

    @property
    def k(self) -> int:
        return len(self.books[0])

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x / np.linalg.norm(x, axis=1)[:, None]
        return _distances(x[:, : self.cut], self.books[0]), _distances(x[:, self.cut :], self.books[1])

    def _fit(self, x: np.ndarray, threshold: float, recall: float) -> int:
        """Cells to visit so that pairs at the threshold are met from either side with the target recall."""
        noise = np.random.default_rng(_SEED).standard_normal(x.shape)
        noise -= (noise * x).sum(axis=1)[:, None] * x
        size = np.linalg.norm(noise, axis=1)[:, None]
        y = threshold * x + (1 - threshold**2) ** 0.5 * noise / np.where(size > 0, size, 1)
        ranks = []
        for at in range(0, len(x), 64):
            sides = [self.halves(v[at : at + 64]) for v in (x, y)]
            each = []
            for (p, q), (r, s) in (sides, sides[::-1]):
                sums = p[:, :, None] + q[:, None, :]
                own = sums[np.arange(len(p)), r.argmin(axis=1), s.argmin(axis=1)]
                each.append((sums < own[:, None, None]).sum(axis=(1, 2)))
            ranks.append(np.minimum(*each))
        return int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = self.halves(x)
        return p.argmin(axis=1), q.argmin(axis=1)

    def visited(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The visited cells of each vector, as two arrays (vectors, visits)."""
        p, q = self.halves(x)
        first, second = np.argsort(p, axis=1, kind="stable"), np.argsort(q, axis=1, kind="stable")
        i, j = first[:, self.grid[:, 0]], second[:, self.grid[:, 1]]
        rows = np.arange(len(x))[:, None]
        sums = p[rows, i] + q[rows, j]
        most = min(self.visits, sums.shape[1])
        best = np.argpartition(sums, most - 1, axis=1)[:, :most]
        return i[rows, best], j[rows, best]


def _vectors(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _run(members: np.ndarray, k: int) -> np.ndarray:
    """What sets the cells of each member apart from those of the others."""
    return np.arange(len(members), dtype=np.int64)[:, None] * (k * k)


def _spanning(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that connect all that the true places of ``close`` (rows ``left``, columns ``right``) connect."""
    label, none = np.arange(close.shape[1]), close.shape[1]
    for _ in range(8 if close.sum() > 4096 else 0):  # labels of dense parts settle in few rounds
        of_row = np.where(close, label, none).min(axis=1)
        new = np.minimum(label, np.where(close, of_row[:, None], none).min(axis=0))
        if np.array_equal(new, label):
            some = of_row < none
            return np.concatenate([left[some], right]), np.concatenate([right[of_row[some]], right[label]])
        label = new
    row, column = np.nonzero(close)
    return local_components(left[row], right[column])


def class_links(classes: DataFrame, index: MultiIndex, threshold: float, kind: str) -> DataFrame:
    """Links and link counts of classes ``(id, n, vec)`` with cosine >= threshold; ``vec`` holds numbers of type ``kind``.

    Rows ``(a, b, n)`` with ``b`` connect all linked classes, directly or by way of others; rows without ``b`` add ``n`` to
    the linked vectors of ``a``. No pair is listed: a block of comparisons gives at most two rows per class in it.
    A pair that is met from both sides counts where its smaller id asks.
    """

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        raw = batch.column("vec").to_pylist()
        values = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
        return batch.column("id").to_numpy(), batch.column("n").to_numpy(), raw, values

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, queries = np.zeros(index.k, np.int64), np.zeros(index.k, np.int64)
        for batch in slices(batches):
            x = split(batch)[3]
            members += np.bincount(index.cells(x)[0], minlength=index.k)
            rows = np.sort(index.visited(x)[0], axis=1)
            fresh = np.ones(rows.shape, bool)
            fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
            queries += np.bincount(rows[fresh], minlength=index.k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(index.k)), pa.array(members), pa.array(queries)], ["i", "members", "queries"])

    counted = classes.mapInArrow(sizes, "i long, members long, queries long").groupBy("i").agg(F.sum("members").alias("m"), F.sum("queries").alias("q")).collect()
    chunks = np.ones((index.k, 2), np.int64)  # one row per codeword of the first half
    for r in counted:
        chunks[r["i"]] = max(1, -(-r["m"] // MEMBERS)), max(1, -(-r["q"] // QUERIES))

    names = ["i", "c", "d", "query", "id", "n", "own", "cells", "vec"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class as a member of its cell, with all cells it visits, and as a query with those of one row of the grid.

        Both carry their own cell, so that a block can tell which pairs the other side meets too.
        """
        for batch in slices(batches):
            ids, weight, raw, x = split(batch)
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own_i, own_j = index.cells(x)
            rows, cells = index.visited(x)
            visits = np.sort(rows * index.k + cells, axis=1)
            rows, cells = visits // index.k, (visits % index.k).astype("<i2")
            visits, own = visits.astype("<i4"), own_i * index.k + own_j
            out = []
            for r in range(len(ids)):
                n, m = chunks[own_i[r]]
                out += [(own_i[r], spread[r] % n, d, False, ids[r], weight[r], own[r], visits[r].tobytes(), raw[r]) for d in range(m)]
                cuts = [0, *(np.flatnonzero(np.diff(rows[r])) + 1).tolist(), rows.shape[1]]
                for a, b in zip(cuts, cuts[1:]):
                    i = rows[r, a]
                    n, m = chunks[i]
                    out += [(i, c, spread[r] % m, True, ids[r], weight[r], own[r], cells[r, a:b].tobytes(), raw[r]) for c in range(n)]
            for at in range(0, len(out), 8192):
                columns = zip(*out[at : at + 8192], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], names)

    def rows_of(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array(a), other, pa.array(n)], ["a", "b", "n"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, ["i", "c", "d"]):
            begins = starts_of([x["i"], x["c"], x["d"]])
            for s, e in zip(begins, [*begins[1:], len(x["i"])], strict=True):
                asks = x["query"][s:e]
                if asks.all() or not asks.any():
                    continue
                vec = np.frombuffer(b"".join(x["vec"][s:e]), kind).reshape(e - s, -1).astype(np.float64)
                size, ids, weight, home = np.linalg.norm(vec, axis=1), x["id"][s:e], x["n"][s:e], x["own"][s:e]
                at = np.flatnonzero(~asks)
                at = at[np.argsort(home[at], kind="stable")]
                of = home[at] % index.k
                starts = starts_of([of])
                place = {int(of[p]): (p, q) for p, q in zip(starts, [*starts[1:], len(of)], strict=True)}
                who = np.flatnonzero(asks)
                asked = [np.frombuffer(c, "<i2") for c in x["cells"][s:e][asks]]
                flat = np.concatenate(asked)
                owner = np.repeat(who, [len(c) for c in asked])
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                edges = starts_of([flat])
                total = np.zeros(e - s, np.int64)  # linked vectors per row of the block
                near, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for p, q in zip(edges, [*edges[1:], len(flat)], strict=True):
                    if int(flat[p]) not in place:
                        continue
                    lo, hi = place[int(flat[p])]
                    members, met = at[lo:hi], None
                    for k in range(p, q, 512):
                        own = owner[k : min(q, k + 512)]
                        cosine = (vec[own] @ vec[members].T) / np.outer(size[own], size[members])
                        close = (cosine >= threshold) & (ids[own][:, None] != ids[members])
                        if not close.any():
                            continue
                        if met is None:  # cells that the members visit, one sorted run for each
                            met = np.frombuffer(b"".join(x["cells"][s + members]), "<i4").reshape(len(members), -1) + _run(members, index.k)
                        homes, of_own = np.unique(home[own], return_inverse=True)
                        wanted = homes + _run(members, index.k)
                        place_in = np.searchsorted(met.ravel(), wanted).clip(max=met.size - 1)
                        both = (met.ravel()[place_in] == wanted).T[of_own]
                        counted = (close & ((ids[own][:, None] < ids[members]) | ~both)).astype(np.float64)
                        total[own] += (counted @ weight[members]).astype(np.int64)
                        total[members] += (weight[own] @ counted).astype(np.int64)
                        a, b = _spanning(close, ids[own], ids[members])
                        near.append(a)
                        far.append(b)
                a, b = np.concatenate(near), np.concatenate(far)
                if len(a):
                    nodes, root = local_components(a, b)
                    yield rows_of(nodes[nodes != root], root[nodes != root], np.zeros((nodes != root).sum(), np.int64))
                linked = np.flatnonzero(total)
                if len(linked):
                    yield rows_of(ids[linked], None, total[linked])

    rows = classes.mapInArrow(dealt, "i long, c long, d long, query boolean, id long, n long, own long, cells binary, vec binary")
    rows = rows.repartition("i", "c", "d").sortWithinPartitions("i", "c", "d")
    return rows.mapInArrow(compared, "a long, b long, n long")


def fit_index(classes: DataFrame, threshold: float, kind: str, recall: float = TARGET_RECALL) -> MultiIndex:
    """Codebooks from at most ``FIT_SAMPLE`` classes (hash order); there must be one."""
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(FIT_SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    return MultiIndex(_vectors(sample, kind).astype(np.float64), classes.count(), threshold, recall)


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = TARGET_RECALL) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing. Vectors of different
    lengths have no cosine; each length has an index of its own. Repeated keys are vectors of their own; rows
    with null keys link, but name a component only if all its keys are null. An empty table gives an empty result.
    Other columns are not read.
    """
    element = rows.schema[vector].dataType.elementType.simpleString()
    kind, width = ("<f4", "float") if element == "float" else ("<f8", "double")
    picked = rows.select(F.col(key).alias("key"), F.col(vector).cast(f"array<{width}>").alias("vector"))
    sound = F.coalesce(
        F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False)
    )
    valid = picked.where(sound)
    grouped = materialize(valid.groupBy("vector").agg(F.min("key").alias("low"), F.count("*").alias("n")), "classes")
    classes = materialize(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    lengths = [r["length"] for r in classes.groupBy(F.size("vector").alias("length")).count().where("count > 1").orderBy("length").collect()]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind)
            raw = values.tobytes()
            step = len(raw) // max(1, batch.num_rows)
            vec = pa.array([raw[at : at + step] for at in range(0, len(raw), step)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), vec], ["id", "n", "vec"])

    found = [classes.select(F.col("id").alias("a"), F.col("id").alias("b"), "n").limit(0)]
    for length in lengths:  # one index for each number of components; others have no cosine with it
        own = classes.where(F.size("vector") == length).select("id", "n", "vector").mapInArrow(packed, "id long, n long, vec binary")
        found.append(materialize(class_links(own, fit_index(own, threshold, kind, recall), threshold, kind), "links"))
    links = reduce(DataFrame.union, found)
    labels = components(links.where("b is not null").select("a", "b"))
    others = links.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    named = classes.join(others, classes["id"] == others["a"], "left").join(labels, classes["id"] == labels["node"], "left")
    named = named.select("vector", "low", F.coalesce("component", "id").alias("component"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    found = materialize(named.join(lowest, "component").select("vector", "component_id", "n_links"), "named")
    linked = valid.join(found, "vector").select("key", "n_links", "component_id")
    alone = picked.where(~sound).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept")
    )
