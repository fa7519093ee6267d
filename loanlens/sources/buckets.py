"""Tables laid out by a hash bucket of their key, so that an update leaves all other buckets alone."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.operators.joins import apply_updates
from loanlens.operators.mapping import count_misfits

BUCKET = "bucket__"


class BucketedTable:
    """A Parquet table under ``root`` with one folder for each of ``buckets`` hash buckets of ``key``.

    An update reads and rewrites only the buckets its keys fall into, by dynamic partition overwrite: until the commit
    nothing changes, so lost executors and failed attempts leave the table as it was. One writer at a time. Rows with a
    null key are spread by their contents and are never updated. The number of buckets is part of the path, because a
    table cannot be read by another one.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "id", buckets: int = 1000):
        self.spark, self.schema, self.key, self.buckets = spark, schema, key, buckets
        self.path = f"{root.rstrip('/')}/buckets-{buckets}"

    def _bucket(self, columns: list[str]) -> Column:
        """The bucket of a row; equal keys have one, whatever the other columns."""
        key = F.col(f"`{self.key}`")
        spread = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in columns))
        return F.pmod(F.when(key.isNull(), spread).otherwise(F.xxhash64(key)), self.buckets).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        """Rows that have a bucket. Rebalancing gives a bucket one file, and more only if it is large."""
        writer = rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).mode(mode)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def _typed(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Columns in the stored types; values that do not fit end the call before anything is written."""
        lost = {c: n for c, n in count_misfits(rows, self.schema, columns).items() if n}
        if lost:
            raise ValueError(f"values that do not fit the stored types: {lost}")
        return rows.withColumns({c: F.col(f"`{c}`").cast(self.schema[c].dataType) for c in columns if rows.schema[c].dataType != self.schema[c].dataType})

    def create(self, rows: DataFrame) -> None:
        """Write the table; an existing one is not touched (an error)."""
        rows = self._typed(rows.select(*(F.col(f"`{c}`") for c in self.schema.names)), self.schema.names)
        self._write(rows.withColumn(BUCKET, self._bucket(self.schema.names)), "errorifexists")

    def append(self, rows: DataFrame) -> None:
        """Add rows to their buckets; missing columns are null."""
        missing = {f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name not in rows.columns}
        rows = rows.withColumns(missing).select(*(F.col(f"`{c}`") for c in self.schema.names))
        self._write(self._typed(rows, self.schema.names).withColumn(BUCKET, self._bucket(self.schema.names)), "append")

    def read(self) -> DataFrame:
        return self._read().drop(BUCKET)

    def rows_of(self, keys: DataFrame) -> tuple[DataFrame, list[int]]:
        """Rows of all buckets that the non-null ``keys`` fall into (with their bucket), and those buckets: at most as many as the table has."""
        typed = keys.select(F.col(f"`{self.key}`").cast(self.schema[self.key].dataType).alias(self.key)).where(F.col(f"`{self.key}`").isNotNull())
        touched = sorted(r[0] for r in typed.select(self._bucket([self.key])).distinct().collect())
        return self._read().where(F.col(BUCKET).isin(touched)), touched

    def update(self, updates: DataFrame, merge: Callable[..., DataFrame] = apply_updates, **options) -> int:
        """Lay ``updates`` over the table by ``merge(rows, updates, **options)`` (``apply_updates``, ``record_feedback``).

        Returns the number of buckets that were read and written anew. Unknown and null keys change nothing.
        """
        shared = [c for c in updates.columns if c in self.schema.names]
        updates = self._typed(updates.where(F.col(f"`{self.key}`").isNotNull()), shared)
        rows, touched = self.rows_of(updates)
        if touched:
            self._write(merge(rows, updates, **options).select(*(F.col(f"`{c}`") for c in [*self.schema.names, BUCKET])), "overwrite")
        return len(touched)
