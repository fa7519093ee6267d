"""Positions and running totals over a total order, without one big sort task.

Rows are range-partitioned on the order, the blocks are written once, and the totals of the blocks
before each block are added. No task sees more than one block; a group that spans many blocks is
split like any other rows, as long as the order columns tell its rows apart.
"""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.session import materialize

_BLOCK, _POS = "_block", "_pos"


def _blocks(df: DataFrame, order: list, blocks: int | None) -> DataFrame:
    by = [blocks, *order] if blocks else order
    return materialize(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*order)
        .withColumns({
            _BLOCK: F.spark_partition_id(),
            _POS: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
        }),
        "blocks",
    )


def with_row_index(
    df: DataFrame, order: list, name: str = "row_index", start: int = 0, blocks: int | None = None
) -> DataFrame:
    """Add the position of each row in ``order``, counting from ``start``."""
    cut = _blocks(df, order, blocks)
    # one row per block, so both the window and the broadcast are bounded by the partition count
    before = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("_n")).select(
        _BLOCK, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_start")
    )
    return (
        cut.join(F.broadcast(starts), _BLOCK)
        .withColumn(name, F.col("_start") + F.col(_POS))
        .drop(_BLOCK, _POS, "_start")
    )


def with_group_index(
    df: DataFrame, group: list[str], order: list, name: str, blocks: int | None = None
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``; a hot group spans many tasks.

    Rows are counted per group and block, and meet the counts of earlier blocks by both keys.
    """
    keys = [*group, _BLOCK]
    cut = _blocks(df, [*group, *order], blocks)
    before = Window.partitionBy(*group).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(_POS).alias("_first"))
    sizes = sizes.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier")
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return cut.join(sizes, same).select(*df.columns, (F.col("_earlier") + F.col(_POS) - F.col("_first") + 1).alias(name))


def running_totals(
    df: DataFrame, group: list[str], order: list, totals: dict[str, str], blocks: int | None = None
) -> DataFrame:
    """Add cumulative sums (``new column -> summed column``) per group along ``order``.

    The order must be unique within a group.
    """
    keys = [*group, _BLOCK]
    cut = _blocks(df, [*group, *order], blocks)
    before = Window.partitionBy(*group).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys).agg(*[F.sum(c).alias(f"_o_{n}") for n, c in totals.items()])
    offsets = offsets.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])  # a null group is a group
    inside = Window.partitionBy(*keys).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumns({n: F.sum(c).over(inside) for n, c in totals.items()})
        .join(offsets, same)
        .withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in totals})
        .drop(_BLOCK, _POS, *[f"_key_{k}" for k in keys], *[f"_o_{n}" for n in totals])
    )


def with_previous(df: DataFrame, group: list[str], order: list, column: str, name: str, blocks: int | None = None) -> DataFrame:
    """Add the value of ``column`` in the row before, within its group along ``order``; a hot group spans many tasks.

    The first row of a group in a block takes the last value of the group's block before.
    """
    keys = [*group, _BLOCK]
    cut = _blocks(df, [*group, *order], blocks)
    lasts = cut.groupBy(*keys).agg(F.max_by(F.struct(column), _POS).alias("_last"), F.min(_POS).alias("_first"))
    earlier = F.lag("_last").over(Window.partitionBy(*group).orderBy(_BLOCK))  # one row per group and block
    lasts = lasts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_first", earlier.getField(column).alias("_earlier"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    inside = F.lag(column).over(Window.partitionBy(*keys).orderBy(_POS))
    joined = cut.withColumn(name, inside).join(lasts, same)
    value = F.when(F.col(_POS) == F.col("_first"), F.col("_earlier")).otherwise(F.col(name))
    return joined.select(*[c for c in df.columns if c != name], value.alias(name))
