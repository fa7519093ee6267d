"""Column statistics: one pass for moments, distributed counting for quantiles and modes."""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schema as S
from loanlens.functions.names import quoted
from loanlens.operators.ordered import running_totals


def tall(df: DataFrame, columns: list[str], keep: list[str] = (), dtype: str = "double") -> DataFrame:
    """``(keep..., feature, value)`` rows, one per column."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), quoted(c).cast(dtype).alias("value")) for c in columns
    ])
    return df.select(*keep, F.inline(pairs))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _wide_to_tall(row: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}__{p}`").alias(p) for p in parts])
        for c in columns
    ])
    return row.select(F.inline(entries))


def feature_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(feature, min, max, mean, std)`` with the sample deviation, in a single pass."""
    columns = columns or numeric_columns(df)
    made = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    row = df.agg(*[
        fn(F.col(f"`{c}`").cast("double")).alias(f"{c}__{p}") for c in columns for p, fn in made.items()
    ])
    return _wide_to_tall(row, columns, list(made))


SKETCH = 10_000
SMALL_COUNT = 1_000_000


def quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float],
              accuracy: int | None = None) -> DataFrame:
    """``(feature, <name>...)``: linearly interpolated quantiles of each column; columns without a value are left out.

    Exact by default: a sketch brackets every quantile, a second pass counts what lies below the
    brackets, and only the values inside them (about ``4 / SKETCH`` of the rows) are counted one by
    one. ``accuracy`` returns the sketch's own answer instead.
    """
    if accuracy:
        row = df.agg(*[
            F.percentile_approx(_number(c), q, accuracy).alias(f"{c}__{n}")
            for c in columns for n, q in probabilities.items()
        ])
        return _wide_to_tall(row, columns, list(probabilities)).dropna(subset=list(probabilities))
    values = _exact_quantiles(df, columns, probabilities)
    fields = ", ".join(f"`{n}` double" for n in probabilities)
    return df.sparkSession.createDataFrame(
        [(c, *[v[n] for n in probabilities]) for c, v in values.items()], f"feature string, {fields}"
    )


def medians(df: DataFrame, columns: list[str], accuracy: int | None = None) -> dict[str, float]:
    """Median of every column that has values, as ``quantiles`` gives it, without a frame in between."""
    if not columns:
        return {}
    if accuracy:
        return {r.feature: r.median for r in quantiles(df, columns, {"median": 0.5}, accuracy).collect()}
    found = _exact_quantiles(df, columns, {"median": 0.5})
    return {c: v["median"] for c, v in found.items() if v["median"] is not None}


def _exact_quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float]) -> dict[str, dict[str, float]]:
    margin = 2 / SKETCH
    ends = sorted({min(max(q + d, 0.0), 1.0) for q in probabilities.values() for d in (-margin, margin)})
    sketch = df.agg(*[
        part for i, c in enumerate(columns) for part in (
            F.count(_number(c)).alias(f"n{i}"), F.percentile_approx(_number(c), ends, SKETCH).alias(f"s{i}")
        )
    ]).first()
    slots = []  # (column, name, probability, rows, low, high)
    for i, c in enumerate(columns):
        if sketch[f"n{i}"]:
            at = dict(zip(ends, sketch[f"s{i}"]))
            for name, q in probabilities.items():
                low = at[q - margin] if q > margin else float("-inf")
                high = at[q + margin] if q + margin < 1 else float("inf")
                slots.append((c, name, q, sketch[f"n{i}"], low, high))
    found = _ranked_values(df, slots)
    wrong = {c for (c, *_), v in zip(slots, found) if v is None}
    if wrong:  # a bracket missed its rank: open the brackets of that column
        slots = [(c, n, q, k, *((float("-inf"), float("inf")) if c in wrong else (lo, hi))) for c, n, q, k, lo, hi in slots]
        found = _ranked_values(df, slots)
    values: dict[str, dict] = {}
    for (c, name, *_), v in zip(slots, found):
        values.setdefault(c, {})[name] = v
    return values


def _number(column: str) -> Column:
    """The column as a double, NaN as null."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def _ranked_values(df: DataFrame, slots: list[tuple]) -> list[float | None]:
    """The quantile of each slot, or None where its bracket does not hold the rank."""
    if not slots:
        return []
    counts = df.agg(*[
        part for i, (c, _, _, _, low, high) in enumerate(slots) for part in (
            F.count_if(_number(c) < low).alias(f"b{i}"), F.count_if(_number(c).between(low, high)).alias(f"i{i}")
        )
    ]).first()
    inside = F.array_compact(F.array(*[
        F.when(_number(c).between(low, high), F.struct(F.lit(i).alias("slot"), _number(c).alias("value")))
        for i, (c, _, _, _, low, high) in enumerate(slots)
    ]))
    tallied = df.select(F.inline(inside)).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    if sum(counts[f"i{i}"] for i in range(len(slots))) <= SMALL_COUNT:
        ranked = tallied.withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("value")))
    else:
        ranked = running_totals(tallied, ["slot"], ["value"], {"upto": "n"})

    # wanted ranks within each bracket, counted from 0
    ranks = []
    for i, (_, _, q, rows, _, _) in enumerate(slots):
        position = (rows - 1) * q
        ranks.append((math.floor(position) - counts[f"b{i}"], math.ceil(position) - counts[f"b{i}"], position % 1))
    wanted = F.array(*[F.array(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint")) for lo, hi, _ in ranks])

    def value_at(end: int) -> Column:
        rank = F.get(F.get(wanted, F.col("slot")), F.lit(end))
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value")))

    rows = ranked.groupBy("slot").agg(value_at(0).alias("lo"), value_at(1).alias("hi")).collect()
    ends = {r.slot: (r.lo, r.hi) for r in rows}
    out = []
    for i, (_, _, part) in enumerate(ranks):
        lo, hi = ends.get(i, (None, None))
        out.append(None if lo is None or hi is None else lo + (hi - lo) * part)
    return out


def historical_statistics(df: DataFrame, columns: list[str] | None = None,
                          accuracy: int | None = None) -> DataFrame:
    """``(feature, mean, median, std, min, max, q25, q75)`` per numeric column."""
    columns = columns or numeric_columns(df)
    moments = feature_statistics(df, columns)
    cuts = quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75}, accuracy)
    columns_only = ["feature", "mean", "median", "std", "min", "max", "q25", "q75"]
    return moments.join(F.broadcast(cuts), "feature", "left").select(*columns_only)  # one row per column


def categorical_modes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(feature, mode)``: most frequent value, the smallest on a tie, upper-cased."""
    columns = columns or string_columns(df)
    counts = (
        tall(df, columns, dtype="string").where(F.col("value").isNotNull())
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value")))
    return counts.groupBy("feature").agg(F.upper(best["value"]).alias("mode"))


@dataclass
class FillValues:
    """What the imputer falls back on; every part holds at most one entry per column."""

    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)


def fit_fill_values(history: DataFrame, training: dict | None = None,
                    accuracy: int | None = None) -> FillValues:
    """Medians and modes of the history, means of the training statistics."""
    numeric = [c for c in S.NUMERIC if c in history.columns]
    text = [c for c in S.CATEGORICAL if c in history.columns]
    modes = categorical_modes(history, text).collect() if text else []
    return FillValues(
        medians=medians(history, numeric, accuracy),
        means={c: s["mean"] for c, s in (training or {}).items() if "mean" in s},
        modes={r.feature: r.mode for r in modes},
    )


def statistics_to_dict(stats: DataFrame) -> dict[str, dict[str, float]]:
    """Tall statistics (one row per column) as a dictionary."""
    return {r.feature: {k: v for k, v in r.asDict().items() if k != "feature"} for r in stats.collect()}


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, data_type, row_count, null_count, distinct_count)``; distinct counts are exact.

    Values are de-duplicated per column before they are counted, so repeated values cost nothing
    after the map side.
    """
    columns = columns or df.columns
    kinds = F.create_map(*[
        F.lit(x) for c in columns for x in (c, simple_kind(df.schema[c].dataType))
    ])
    values = tall(df, columns, dtype="string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("feature").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
    ).select(
        F.col("feature").alias("column_name"),
        F.try_element_at(kinds, F.col("feature")).alias("data_type"),
        "row_count", "null_count", "distinct_count",
    )


def simple_kind(dtype: T.DataType) -> str:
    return "numeric" if isinstance(dtype, T.NumericType) else "text"


def low_cardinality_counts(df: DataFrame, columns: list[str], below: int) -> dict[str, int]:
    """Exact distinct count of every column that has fewer than ``below`` distinct values.

    A one-pass sketch rules out the wide columns (with a five-fold margin), so only columns of few
    values are counted exactly and nothing wide is shuffled.
    """
    sketch = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    narrow = [c for i, c in enumerate(columns) if sketch[f"c{i}"] < 5 * below]
    if not narrow:
        return {}
    exact = (
        tall(df, narrow, dtype="string").where(F.col("value").isNotNull()).distinct()
        .groupBy("feature").agg(F.count("value").alias("n")).collect()
    )
    found = {c: 0 for c in narrow} | {r.feature: r.n for r in exact}
    return {c: n for c, n in found.items() if n < below}
