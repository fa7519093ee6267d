"""One-hot encoding, feature alignment, scaling and target handling."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.functions.names import quoted
from loanlens.functions.risk import target_from_text
from loanlens.operators.stats import low_cardinality_counts, numeric_columns, tall


def _flag(column: str, value: str, name: str) -> Column:
    return F.coalesce((quoted(column) == value).cast("int"), F.lit(0)).alias(name)


def fixed_flags() -> dict[str, Column]:
    """Encoded column name -> 0/1 expression, for the fixed vocabularies."""
    return {
        S.encoded_name(c, v): _flag(c, v, S.encoded_name(c, v)) for c, vs in S.VOCABULARY.items() for v in vs
    }


def one_hot_fixed(df: DataFrame) -> DataFrame:
    return df.withColumns(fixed_flags())


def align_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly ``features`` in order, as doubles; absent ones and nulls are 0."""
    have = set(df.columns)
    return df.select(*keep, *[
        (F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f)
        for f in features
    ])


def encode_for_model(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Canonical columns to the model's feature columns in one projection."""
    flags = fixed_flags()

    def feature(f: str) -> Column:
        if f in flags:
            return flags[f].cast("double").alias(f)
        if f in df.columns:
            return F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f)
        return F.lit(0.0).alias(f)

    return df.select(*keep, *[feature(f) for f in features])


def ignored_feature_count(features: list[str]) -> Column:
    """How many of a row's four encoded categories the model has no column for."""
    flags = [v for k, v in fixed_flags().items() if k not in features]
    return sum(flags, F.lit(0))


def categories(df: DataFrame, columns: list[str], least: int = 1) -> dict[str, list[str]]:
    """Sorted values per column that at least ``least`` rows hold.

    Values are counted before the shuffle; only those kept reach the driver, where they become part of the model.
    """
    if not columns:
        return {}
    places = df.select(*[quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    counts = tall(places, places.columns, dtype="string").where(F.col("value").isNotNull()).groupBy("feature", "value").count()
    found = {c: [] for c in columns}
    for r in counts.where(F.col("count") >= least).select("feature", "value").collect():
        found[columns[int(r.feature[1:])]].append(r.value)
    return {c: sorted(vs) for c, vs in found.items()}


def flag_stages(values: dict[str, list[str]], output: str) -> list[Transformer]:
    """Stages that turn text columns into one sparse vector of 0/1 flags, in the order of ``values``.

    Each column becomes an index, each index a run of places in the vector: no column per category, so their number has no
    limit, and no category in a column name. A value outside the list, or null, has no flag. Categories are
    matched behind a mark, because the stages take no empty ones. A column without categories gives no place.
    """
    used = {c: [f"={v}" for v in vs] for c, vs in values.items() if vs}
    if not used:
        return []
    index, flags = [f"{c}__index" for c in used], [f"{c}__flags" for c in used]
    # one stage per column: lists of different lengths do not pass into one
    indexers = [StringIndexerModel.from_labels(vs, c, i, handleInvalid="keep") for (c, vs), i in zip(used.items(), index)]
    # learns the number of categories from the indexers' metadata; no row is read
    empty = SparkSession.getActiveSession().createDataFrame([], ", ".join(f"{c} string" for c in used))
    encoder = OneHotEncoder(inputCols=index, outputCols=flags, dropLast=True).fit(PipelineModel(indexers).transform(empty))
    return [*indexers, encoder, VectorAssembler(inputCols=flags, outputCol=output)]


def one_hot_sparse(df: DataFrame, values: dict[str, list[str]], drop_first: bool = False, name: str = "flags") -> DataFrame:
    """Replace each column of ``values`` by its flags in one sparse vector ``name`` over all categories of all of them."""
    columns = {f"t{i}": vs[1 if drop_first else 0 :] for i, vs in enumerate(values.values())}
    others = [c for c in df.columns if c not in values]
    marked = [F.concat(F.lit("="), quoted(c).cast("string")).alias(t) for c, t in zip(values, columns)]
    packed = df.select(F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(others)]).alias("others"), *marked)
    stages = flag_stages(columns, "flags__")
    out = PipelineModel(stages).transform(packed) if stages else packed.withColumn("flags__", array_to_vector(F.array().cast("array<double>")))
    return out.select(*[F.col(f"others.o{i}").alias(c) for i, c in enumerate(others)], F.col("flags__").alias(name))


def set_flags(vector: Column) -> Column:
    """Places of the flags that are set in a sparse vector, ascending."""
    parts = F.unwrap_udt(vector)
    dense = F.filter(F.transform(parts["values"], lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    return F.coalesce(parts["indices"], dense)


def one_hot_dynamic(df: DataFrame, values: dict[str, list[str]], drop_first: bool = False) -> DataFrame:
    """Replace each column by one 0/1 column ``<column>_<value>`` per value; for many values take ``one_hot_sparse``."""
    flags = [
        _flag(c, v, f"{c}_{v}") for c, vs in values.items() for v in vs[1 if drop_first else 0:]
    ]
    return df.select(*[quoted(c) for c in df.columns if c not in values], *flags)


@dataclass
class Scaler:
    """Mean and population deviation per feature."""

    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "Scaler":
        """One pass over the training rows; a constant column keeps scale 1."""
        row = df.agg(*[
            agg(quoted(c)).alias(f"{p}_{i}")
            for i, c in enumerate(columns) for p, agg in (("m", F.avg), ("s", F.stddev_pop))
        ]).first()
        at = range(len(columns))
        return cls(
            {columns[i]: row[f"m_{i}"] if row[f"m_{i}"] is not None else 0.0 for i in at},
            {columns[i]: row[f"s_{i}"] or 1.0 for i in at},
        )

    def scaled(self, column: str) -> Column:
        return (quoted(column) - F.lit(self.mean[column])) / F.lit(self.std[column])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.mean})


def detect_columns(df: DataFrame, max_distinct: int = 10, max_ratio: float = 0.05) -> dict:
    """Target, numeric and categorical columns of an unknown frame.

    The target is the first known target name, else the first column with two values. A numeric
    column of few values, both absolutely and relative to the rows, counts as categorical.
    """
    few = low_cardinality_counts(df, df.columns, max_distinct)
    target = next((c for c in S.TARGET_CANDIDATES if c in df.columns), None)
    if target is None:
        target = next((c for c in df.columns if few.get(c) == 2), None)
    if target is None:
        raise ValueError(f"no target column found; name one of {S.TARGET_CANDIDATES}")
    rows = df.count()
    features = [c for c in df.columns if c != target]
    numbers = set(numeric_columns(df))
    numeric = [
        c for c in features if c in numbers and not (c in few and few[c] / rows < max_ratio)
    ]
    return {
        "target": target,
        "numeric": numeric,
        "categorical": [c for c in features if c not in numeric],
        "features": features,
    }


def map_target(df: DataFrame, column: str, name: str = "label", on_unmapped: str = "zero") -> DataFrame:
    """Binary label from a target column; unknown values count as 0, are dropped, or fail.

    ``<name>_unmapped`` marks the rows whose value was unknown: text without a meaning, or a number other than 0
    and 1. A missing target is no label: rows with null or NaN there are always left out.
    """
    kind = dict(df.dtypes)[column]
    if kind == "string":
        label = target_from_text(quoted(column))
    else:
        number = quoted(column).cast("double")
        df = df.where(~F.isnan(number))
        label = F.when(number.isin(0.0, 1.0), number.cast("int"))
    df = df.where(quoted(column).isNotNull())
    out = df.withColumns({f"{name}_unmapped": label.isNull(), name: F.coalesce(label, F.lit(0))})
    if on_unmapped == "drop":
        return out.where(~F.col(f"{name}_unmapped"))
    if on_unmapped == "error":
        problem = F.raise_error(F.concat(F.lit("unknown target value: "), quoted(column).cast("string")))
        return out.withColumn(name, F.when(F.col(f"{name}_unmapped"), problem.cast("int")).otherwise(F.col(name)))
    return out


def share_of_total(counts: DataFrame, count: str = "n", name: str = "share") -> DataFrame:
    """Add each group's part of the total; the total is a scalar subquery, not a global window."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(name, F.try_divide(F.col(count).cast("double"), total))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return share_of_total(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
