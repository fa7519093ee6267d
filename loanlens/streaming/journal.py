"""Tables that a stream fills batch by batch, so that a repeated batch writes nothing twice."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY = T.StructType([T.StructField("batch", T.LongType()), T.StructField("last_id", T.LongType()), T.StructField("n_rows", T.LongType())])


class Journal:
    """Tables under ``root``, each with one folder per batch, and the list of batches that are whole.

    A batch writes its folders, replacing what a broken attempt left there, and is listed last. Readers see listed
    batches only, so tables of one batch appear together. A batch that comes again after it was listed is skipped. The
    stream's checkpoint lies under the same ``root``, so batch numbers and list belong together.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def entries(self) -> DataFrame:
        """``(batch, last_id, n_rows)`` of the listed batches."""
        try:
            return self.spark.read.schema(_ENTRY).parquet(f"{self.root}/journal")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _ENTRY)

    def begin(self, batch: int) -> int | None:
        """The last id given by earlier batches, or None if this batch is listed already."""
        before = F.max(F.when(F.col("batch") < batch, F.col("last_id")))
        row = self.entries().agg(F.count_if(F.col("batch") == batch).alias("here"), before.alias("last")).first()
        return None if row.here else (row.last or 0)

    def write(self, name: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def commit(self, batch: int, last_id: int, n_rows: int) -> None:
        self.spark.createDataFrame([(batch, last_id, n_rows)], _ENTRY).coalesce(1).write.mode("append").parquet(f"{self.root}/journal")

    def read_batch(self, name: str, batch: int) -> DataFrame:
        """One batch as it was written, listed or not."""
        return self.spark.read.parquet(f"{self.root}/{name}/batch={batch}")

    def read(self, name: str) -> DataFrame:
        """All rows of the listed batches, with the column ``batch``; fails if there is none."""
        listed = self.entries().select("batch")  # one row per batch
        if listed.isEmpty():
            raise ValueError(f"no batch of {name} at {self.root}")
        rows = self.spark.read.parquet(f"{self.root}/{name}").withColumn("batch", F.col("batch").cast("long"))
        return rows.join(listed, "batch", "left_semi")
