"""Additive feature contributions of boosted trees, computed where the rows are.

Path-dependent Shapley values: within one leaf only the features on its path matter, and each of
them either sends the row on or not. The contribution of a leaf therefore depends on a bit pattern
over at most ``depth`` features. The leaves of a small subtree are tabulated together, once per model: by the bits of the path to it
and the outcomes of its splits. Where the tables would pass a bound in bytes, the weights along a leaf's path are worked out
for the patterns that the rows at hand have, each once per batch.
"""

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.session import scratch_path


#: Most memory for tabulated contributions of a model and of one subtree.
TABLE_BYTES, BLOCK_BYTES = 64 << 20, 1 << 16


@dataclass
class Table:
    """A subtree's leaves together. A pattern has the bits of the path to it, then the outcome of each of its splits."""

    features: list[int]
    splits: list[tuple[int, float]]  # feature and cut
    start: int  # bits of the path
    cells: np.ndarray  # [place in features, pattern] -> contribution


@dataclass
class Leaf:
    features: list[int]  # path features; position = bit in the pattern
    fractions: list[float]  # share of training rows that go on, per path feature
    value: float
    table: Table | None = None


@dataclass
class Split:
    feature: int
    cut: float
    bit: int
    first_use: bool  # the feature has not occurred further up
    left: "Split | Leaf"
    right: "Split | Leaf"
    table: Table | None = None  # of all leaves below; None if there is no room for it


def path_contributions(holds: np.ndarray, fractions: list[float], value: float) -> np.ndarray:
    """Contribution of each path feature; ``holds[j]`` tells where feature j sends the row on.

    The weighted sum over subsets is read off the coefficients of the product of
    ``fraction + holds * t`` over the other features.
    """
    d, n = holds.shape
    weight = [factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)]
    out = np.zeros((d, n))
    for j in range(d):
        poly = np.zeros((d, n))
        poly[0] = 1.0
        for k in range(d):
            if k != j:
                shifted = poly[:-1] * holds[k]
                poly *= fractions[k]
                poly[1:] += shifted
        out[j] = value * (holds[j] - fractions[j]) * np.tensordot(weight, poly, 1)
    return out


def _holds(patterns: np.ndarray, d: int) -> np.ndarray:
    """Bits of the patterns, one row per path feature."""
    return (patterns[None] >> np.arange(d)[:, None]) & 1


def _splits(node: Split | Leaf) -> list[Split]:
    return [] if isinstance(node, Leaf) else [node, *_splits(node.left), *_splits(node.right)]


def _leaves(node: Split | Leaf) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [*_leaves(node.left), *_leaves(node.right)]


def _table(node: Split | Leaf, path: list[int]) -> Table:
    splits = _splits(node)
    features = list(dict.fromkeys(f for leaf in _leaves(node) for f in leaf.features))
    bits = len(path) + len(splits)
    pattern, cells = np.arange(1 << bits), np.zeros((len(features), 1 << bits))
    outcome = {id(s): (pattern >> (len(path) + k)) & 1 for k, s in enumerate(splits)}

    def add(at: Split | Leaf, holds: dict[int, np.ndarray]) -> None:
        if isinstance(at, Leaf):
            d = len(at.features)
            own = path_contributions(_holds(np.arange(1 << d), d), at.fractions, at.value)
            cells[[features.index(f) for f in at.features]] += own[:, sum((holds[f] << j for j, f in enumerate(at.features)), 0 * pattern)]
            return
        left = outcome[id(at)]
        for child, goes in ((at.left, left), (at.right, 1 - left)):
            add(child, {**holds, at.feature: holds.get(at.feature, 1) & goes})

    add(node, {f: (pattern >> k) & 1 for k, f in enumerate(path)})
    return Table(features, [(s.feature, s.cut) for s in splits], len(path), cells)


def _tabulate(trees: list[Split | Leaf]) -> None:
    """A table for each largest subtree of at most ``BLOCK_BYTES``, as far as ``TABLE_BYTES`` reach."""
    room = TABLE_BYTES

    def tabulate(node: Split | Leaf, path: list[int]) -> None:
        nonlocal room
        size = 8 * len({f for leaf in _leaves(node) for f in leaf.features}) << len(path) + len(_splits(node))
        if size <= min(room, BLOCK_BYTES):
            room -= size
            node.table = _table(node, path)
        elif isinstance(node, Split):
            for child in (node.left, node.right):
                tabulate(child, [*path, node.feature] if node.first_use else path)

    for t in trees:
        tabulate(t, [])


def _tree(nodes: dict, weight: float) -> Split | Leaf:
    def build(i: int, path: dict) -> Split | Leaf:
        node = nodes[i]
        if node["leftChild"] < 0:
            return Leaf(list(path), list(path.values()), weight * node["prediction"])
        feature, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        below = [
            build(child, {**path, feature: path.get(feature, 1.0) * nodes[child]["rawCount"] / node["rawCount"]})
            for child in (node["leftChild"], node["rightChild"])
        ]
        bit = list(path).index(feature) if feature in path else len(path)
        return Split(feature, cut, bit, feature not in path, *below)

    return build(0, {})


def model_trees(spark, model) -> list[Split | Leaf]:
    """Trees of a fitted boosted classifier, read from its saved node table."""
    path = scratch_path(spark, "model")
    model.save(path)
    trees: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").collect():  # bounded by trees x nodes per tree
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(recursive=True)
    weights = list(model.treeWeights)
    # the model's margin is half the log-odds
    out = [_tree(trees[t], 2.0 * weights[t]) for t in sorted(trees)]
    _tabulate(out)
    return out


def expected_value(trees: list[Split | Leaf]) -> float:
    def total(node: Split | Leaf) -> float:
        if isinstance(node, Leaf):
            return node.value * float(np.prod(node.fractions))
        return total(node.left) + total(node.right)

    return sum(total(t) for t in trees)


def contributions(trees: list[Split | Leaf], x: np.ndarray) -> np.ndarray:
    """Log-odds contributions, rows by features.

    Each tree is walked once for the whole batch; a row's pattern gets one bit per path feature.
    """
    out = np.zeros((x.shape[1], x.shape[0]))
    columns = np.ascontiguousarray(x.T)

    def add(features: list[int], parts: np.ndarray) -> None:
        for f, part in zip(features, parts):
            out[f] += part

    def walk(node: Split | Leaf, pattern: np.ndarray) -> None:
        if node.table is not None:
            bits = pattern
            for k, (feature, cut) in enumerate(node.table.splits, node.table.start):
                bits = bits | (columns[feature] <= cut).astype(bits.dtype) << bits.dtype.type(k)
            add(node.table.features, node.table.cells.take(bits.astype(np.intp), axis=1, mode="clip"))
        elif isinstance(node, Leaf):
            met, place = np.unique(pattern, return_inverse=True)
            add(node.features, path_contributions(_holds(met.astype(np.intp), len(node.features)), node.fractions, node.value)[:, place])
        else:
            goes_left = columns[node.feature] <= node.cut
            for child, goes in ((node.left, goes_left), (node.right, ~goes_left)):
                bit = goes.astype(pattern.dtype) << pattern.dtype.type(node.bit)
                walk(child, pattern | bit if node.first_use else pattern & (bit | ~pattern.dtype.type(1 << node.bit)))

    for t in trees:
        walk(t, np.zeros(x.shape[0], np.uint16 if _most_bits(t) <= 16 else np.int64))
    return out.T


def _most_bits(node: Split | Leaf, path: int = 0) -> int:
    """Bits of the longest pattern."""
    if node.table is not None:
        return node.table.start + len(node.table.splits)
    if isinstance(node, Leaf):
        return path
    below = path + node.first_use
    return max(_most_bits(node.left, below), _most_bits(node.right, below))


class Explainer:
    """A model's trees, read and sent to the executors once, for any number of frames."""

    def __init__(self, spark, model):
        trees = model_trees(spark, model)
        self.base, self.shared = float(expected_value(trees)), spark.sparkContext.broadcast(trees)

    def explain(self, df: DataFrame, features: list[str], vector: str = "features", name: str = "shap_values") -> DataFrame:
        """Add ``shap_values`` (feature -> log-odds contribution) and ``expected_value``."""
        shared = self.shared

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def explain(rows: pa.Array) -> pa.Array:
            found = contributions(shared.value, rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(features)))
            return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(features), found.ravel())

        keys = F.array(*[F.lit(f) for f in features])
        return df.withColumns({
            name: F.map_from_arrays(keys, explain(vector_to_array(F.col(vector)))),
            "expected_value": F.lit(self.base),
        })


def shap_values(df: DataFrame, model, features: list[str], vector: str = "features",
                name: str = "shap_values") -> DataFrame:
    """``Explainer.explain`` for one frame."""
    return Explainer(df.sparkSession, model).explain(df, features, vector, name)


def top_contributors(shap: Column, k: int = 5) -> Column:
    """The ``k`` entries of largest absolute value, ties by feature name."""
    entries = F.transform(
        F.map_entries(shap),
        lambda e: F.struct((-F.abs(e["value"])).alias("rank"), e["key"].alias("feature"), e["value"].alias("value")),
    )
    return F.transform(
        F.slice(F.array_sort(entries), 1, k),
        lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value")),
    )


def contribution_totals(entries: Column) -> Column:
    """``(positive, negative, max_abs)`` over an array of (feature, value)."""
    def total(pick) -> Column:
        return F.aggregate(F.transform(entries, pick), F.lit(0.0), lambda a, v: a + v)

    return F.struct(
        total(lambda e: F.greatest(e["value"], F.lit(0.0))).alias("positive"),
        total(lambda e: F.greatest(-e["value"], F.lit(0.0))).alias("negative"),
        F.array_max(F.transform(entries, lambda e: F.abs(e["value"]))).alias("max_abs"),
    )
