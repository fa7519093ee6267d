"""Repeatable splits from a hash of the row id, independent of partitioning."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def in_test(key: str, test_size: float = 0.2, seed: int = 42) -> Column:
    """True for about ``test_size`` of the rows."""
    return F.substring(row_hash(key, seed), 1, 4) < F.lit(f"{int(test_size * 65536):04x}")


def split_random(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    return df.withColumn("is_test", in_test(key, test_size, seed))


def split_stratified(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """The ``ceil(n * test_size)`` rows of lowest hash of each class form the test set.

    The exact cut of a class is found by counting hash prefixes and then ranking only the rows of
    the one prefix that holds it, so no class is ever sorted in one task. Labels are few. Rows without a
    label are never in the test set.
    """
    prefix = F.substring(row_hash(key, seed), 1, 4)
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_class"), prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("_class").orderBy("_prefix")  # at most 65,536 prefixes per class
    counted = counts.withColumn("upto", F.sum("n").over(upto))
    totals = counts.groupBy("_class").agg(F.sum("n").alias("total")).collect()
    need = {r["_class"]: math.ceil(r["total"] * test_size) for r in totals}
    needed = F.create_map(*[F.lit(x) for pair in need.items() for x in pair]) if need else None
    if needed is None:
        return df.withColumn("is_test", F.lit(False))
    rank = F.try_element_at(needed, F.col("_class"))
    cuts = {
        r["_class"]: r for r in
        counted.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).collect()
    }
    wanted = F.lit(False)
    for value, r in cuts.items():
        wanted = wanted | ((F.col(label) == F.lit(value)) & (prefix == r["_prefix"]))
    rows = df.where(wanted).select(F.col(label).alias("_class"), row_hash(key, seed).alias("_hash"))
    place = F.row_number().over(Window.partitionBy("_class").orderBy("_hash"))
    take = {v: need[v] - (r["upto"] - r["n"]) for v, r in cuts.items()}
    takes = F.create_map(*[F.lit(x) for pair in take.items() for x in pair])
    bounds = (
        rows.withColumn("_place", place).where(F.col("_place") == F.try_element_at(takes, F.col("_class"))).collect()
    )
    test = F.lit(False)
    for r in bounds:
        test = test | ((F.col(label) == F.lit(r["_class"])) & (row_hash(key, seed) <= r["_hash"]))
    return df.withColumn("is_test", F.coalesce(test, F.lit(False)))


def fold(key: str, folds: int = 5, seed: int = 42) -> Column:
    return F.pmod(F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")
