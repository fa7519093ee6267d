"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has one bit per hash bit of the text's word shingles. All pairs of fingerprints that differ in
at most ``distance`` bits are found without comparing all pairs:

1. The 64 bits are grouped so that correlated bits share a block of 16, blocks form partitions.
2. By the generalised pigeonhole principle, thresholds ``t_i >= -1`` that sum to ``distance - partitions + 1``
   lose no pair: some partition of any such pair differs in at most ``t_i`` bits. -1 means: not probed.
3. Per fingerprint a dynamic program chooses the thresholds with the fewest estimated candidates, from counts
   of block values over all fingerprints (tables of 2^16 counts, whatever the input's size).
4. Fingerprints are indexed under their partition values and probe all values within their thresholds;
   candidates are verified by their Hamming distance, in blocks of bounded size.

Only links that join components leave a block of comparisons, so a large group of copies gives few rows.
"""

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import local_components, runs, slices, starts_of, texts, to_numpy, whole_groups
from loanlens.llm.components import components
from loanlens.session import materialize

BLOCK_BITS = 16
#: Partitions as lists of 16-bit blocks; the one with the least estimated work is used.
LAYOUTS = ([[0], [1], [2], [3]], [[0], [1], [2, 3]], [[0, 1], [2, 3]])
#: Rows of a bucket compared at once, on either side, and candidate pairs held at once.
CHUNK, PAIRS = 2048, 1 << 21
#: Estimated cost of a probe in candidates.
PROBE_COST = 4.0
#: Fingerprints on which the layouts are compared (a choice of plan only; every layout is exact).
PLAN_SAMPLE = 1024


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the lower-cased (A-Z only) text's word shingles, repeats included; no word: none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= width:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in spans], dtype="<u8")


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the text's word shingles; no word: 0."""
    hashes = shingles(text, width)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) of every row. Null texts count as empty."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in texts(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found.view(np.int64))], ["key", "fp"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.mapInArrow(rows, f"key {kind}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_blocks(fps: DataFrame) -> list[list[int]]:
    """Four blocks of 16 bits; each gathers the bits most correlated with those it holds already."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = _bits(to_numpy(batch.column(0))).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            cells = np.concatenate([both.ravel(), [n]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    total = np.zeros(64 * 64 + 1)
    for row in fps.select("fp").mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[row["cell"]] = row["n"]
    n, both = max(total[-1], 1), total[:-1].reshape(64, 64)
    share = np.diag(both) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    link = np.abs((both / n - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(link, -1)
    free, blocks = set(range(64)), []
    while free:
        rest = sorted(free)
        sub = link[np.ix_(rest, rest)]
        block = [rest[int(sub.max(axis=1).argmax())]]
        free.discard(block[0])
        while len(block) < BLOCK_BITS:
            best = max(sorted(free), key=lambda b: link[b, block].sum())
            block.append(best)
            free.discard(best)
        blocks.append(sorted(block))
    return blocks


class Plan:
    """Block layout, candidate estimates and probe masks; its size does not depend on the input."""

    def __init__(self, blocks: list[list[int]], near: np.ndarray, total: int, layout: list[list[int]], distance: int):
        self.blocks, self.near, self.total, self.layout, self.distance = blocks, near, max(total, 1), layout, distance
        self.top = min(distance, 2) if distance - len(layout) + 1 <= 2 * len(layout) else distance

    def block_values(self, fps: np.ndarray) -> np.ndarray:
        bits = _bits(fps).astype(np.int64)
        return np.stack([bits[:, b] @ (1 << np.arange(BLOCK_BITS)) for b in self.blocks])

    def values(self, fps: np.ndarray) -> np.ndarray:
        """Partition values, one row per partition."""
        own = self.block_values(fps)
        return np.stack([sum(own[b] << (BLOCK_BITS * k) for k, b in enumerate(part)) for part in self.layout])

    def masks(self, part: int, t: int) -> np.ndarray:
        """All differences of at most ``t`` bits in the partition."""
        width = BLOCK_BITS * len(self.layout[part])
        return np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(width), d)], dtype=np.int64)

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """Estimated candidates and probes per partition and threshold -1, 0, ...; threshold -1 costs nothing."""
        own, out = self.block_values(fps), np.zeros((len(self.layout), self.top + 2, len(fps)))
        for i, part in enumerate(self.layout):
            exact = self.near[part[0], : self.top + 1][:, own[part[0]]] / self.total
            for b in part[1:]:
                other = self.near[b, : self.top + 1][:, own[b]] / self.total
                exact = np.stack([sum(exact[j] * other[d - j] for j in range(d + 1)) for d in range(self.top + 1)])
            for t in range(self.top + 1):
                out[i, t + 1] = exact[: t + 1].sum(axis=0) * self.total + PROBE_COST * len(self.masks(i, t))
        return out

    def thresholds(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cheapest thresholds per fingerprint (one row per partition), and their cost."""
        cost, parts = self.costs(fps), len(self.layout)
        need = self.distance + 1  # sum of t_i + 1
        best = np.full((need + 1, len(fps)), np.inf)
        best[0] = 0
        choice = np.zeros((parts, need + 1, len(fps)), np.int8)
        for i in range(parts):
            new = np.full_like(best, np.inf)
            for used in range(min(self.top + 1, need) + 1):
                tried = best[: need + 1 - used] + cost[i, used]
                better = tried < new[used:]
                new[used:] = np.where(better, tried, new[used:])
                choice[i, used:] = np.where(better, used, choice[i, used:])
            best = new
        left, out = np.full(len(fps), need), np.zeros((parts, len(fps)), np.int8)
        for i in reversed(range(parts)):
            used = choice[i, left, np.arange(len(fps))]
            out[i] = used - 1
            left = left - used
        return out, best[need]


def make_plan(fps: DataFrame, distance: int) -> Plan:
    """Bit blocks and value counts over all fingerprints (4 x 2^16 counts at most), and the cheapest layout."""
    blocks = bit_blocks(fps)
    values = [
        sum((F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1).cast("long")) * (1 << k) for k, bit in enumerate(block)), F.lit(0).cast("long"))
        for block in blocks
    ]
    found = fps.select(F.posexplode(F.array(*values)).alias("block", "value")).groupBy("block", "value").count().toArrow()
    near = np.zeros((len(blocks), distance + 1, 1 << BLOCK_BITS))
    near[to_numpy(found["block"]), 0, to_numpy(found["value"])] = to_numpy(found["count"])
    index, bits = np.arange(1 << BLOCK_BITS), 1 << np.arange(BLOCK_BITS)
    for d in range(1, distance + 1):  # counts at exactly d bits, from those at d - 1 and d - 2
        near[:, d] = sum(near[:, d - 1][:, index ^ b] for b in bits)
        if d >= 2:
            near[:, d] -= (BLOCK_BITS - d + 2) * near[:, d - 2]
        near[:, d] /= d
    total = int(near[0, 0].sum())
    sample = to_numpy(fps.orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).select("fp").toArrow()["fp"])
    plans = [Plan(blocks, near.astype(np.float32), total, layout, distance) for layout in LAYOUTS if distance + 1 >= len(layout) or layout is LAYOUTS[-1]]
    return min(plans, key=lambda p: p.thresholds(sample)[1].sum() if len(sample) else 0)


def _dealt(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["part", "value", "probe", "fp"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            fps = to_numpy(batch.column(0))
            values, (limits, _) = plan.values(fps), plan.thresholds(fps)
            for i in range(len(plan.layout)):
                for t in range(-1, plan.top + 1):
                    if t < 0:  # the index holds every fingerprint in every partition
                        own, found, probe = fps, values[i], False
                    else:
                        at = np.flatnonzero(limits[i] == t)
                        if not len(at):
                            continue
                        masks = plan.masks(i, t)
                        own, found, probe = np.repeat(fps[at], len(masks)), (values[i][at][:, None] ^ masks).ravel(), True
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, i, np.int32)), pa.array(found), pa.array(np.full(n, probe)), pa.array(own)], names
                    )

    return rows


def _verified(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the probes of each block with its index rows; links that join components remain."""
    keys = ["part", "value", "i", "j"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, keys):
            begin = starts_of([x[k] for k in keys])
            length = np.diff(np.append(begin, len(x["fp"])))
            probes_in = np.add.reduceat(x["probe"].astype(np.int64), begin)
            indexed = length - probes_in  # index rows come first
            group = np.repeat(np.arange(len(begin)), length)
            at = np.flatnonzero(x["probe"])
            n = indexed[group[at]]
            at, n = at[n > 0], n[n > 0]
            if not len(at):
                continue
            fps, a, b = x["fp"].view(np.uint64), [], []
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1
            for own, m in zip(np.split(at, cuts), np.split(n, cuts), strict=True):
                other = runs(begin[group[own]], m)
                left, right = np.repeat(fps[own], m), fps[other]
                close = (np.bitwise_count(left ^ right) <= distance) & (left != right)
                if close.any():
                    nodes, root = local_components(left[close], right[close])
                    a.append(nodes[nodes != root])
                    b.append(root[nodes != root])
            if a:
                nodes, root = local_components(np.concatenate(a), np.concatenate(b))
                keep = nodes != root
                yield pa.RecordBatch.from_arrays([pa.array(nodes[keep].view(np.int64)), pa.array(root[keep].view(np.int64))], ["a", "b"])

    return rows


def fingerprint_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints within ``distance`` bits, directly or by way of others.

    ``fps`` holds distinct values in ``fp``.
    """
    plan = make_plan(fps, distance)
    dealt = materialize(fps.select("fp").mapInArrow(_dealt(plan), "part int, value long, probe boolean, fp long"), "buckets")
    sizes = dealt.groupBy("part", "value").agg(
        F.count(F.when(~F.col("probe"), 1)).alias("n_index"), F.count(F.when(F.col("probe"), 1)).alias("n_probe")
    )
    large = sizes.where((F.col("n_index") > CHUNK) | (F.col("n_probe") > CHUNK)).select(
        "part", "value", F.ceil(F.col("n_index") / CHUNK).cast("int").alias("ni"), F.ceil(F.col("n_probe") / CHUNK).cast("int").alias("nj")
    )
    ni, nj = F.greatest(F.coalesce("ni", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("nj", F.lit(1)), F.lit(1))

    def own(n):
        return F.array(F.pmod(F.xxhash64("fp"), n).cast("int"))

    def each(n):
        return F.sequence(F.lit(0), n - 1)

    # A bucket is cut into index chunks i and probe chunks j; each pair (i, j) is compared in one place.
    blocks = (
        dealt.join(large, ["part", "value"], "left")
        .withColumn("i", F.explode(F.when(F.col("probe"), each(ni)).otherwise(own(ni))))
        .withColumn("j", F.explode(F.when(F.col("probe"), own(nj)).otherwise(each(nj))))
        .select("part", "value", "i", "j", "probe", "fp")
    )
    blocks = blocks.repartition("part", "value", "i", "j").sortWithinPartitions("part", "value", "i", "j", "probe")
    return blocks.mapInArrow(_verified(distance), "a long, b long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest key that links reach) of every row.

    Null and empty texts have fingerprint 0 and link with each other like any texts; repeated keys keep
    their rows; null keys do not name a component unless it has no other; other columns are not read.
    """
    rows = materialize(with_fingerprints(docs, key, text, width), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("key").alias("low")), "distinct")
    labels = components(fingerprint_links(fps, distance))
    named = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    found = materialize(named.join(lowest, "component").select("fp", "component_id"), "named")
    return rows.join(found, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
