"""Stored tables: append, replace by a new version, clear; and the model manifest."""

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schema as S
from loanlens.operators.mapping import count_misfits
from loanlens.operators.reports import latest_per_key

_VERSIONS = T.StructType([T.StructField("version", T.LongType()), T.StructField("path", T.StringType())])

MANIFEST_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])


class Table:
    """A Parquet table under ``root`` whose current contents are its newest version.

    Appends add files to the current version. A replacement is written beside it and becomes
    current by one small append to the version list, so readers never see a half-written table.
    One writer at a time: an append that finds the version moved under it fails.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _current(self) -> tuple[int, str | None]:
        try:
            row = self.spark.read.schema(_VERSIONS).parquet(f"{self.root}/_versions_").agg(
                F.max(F.struct("version", "path")).alias("v")
            ).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, None
        return (row.v.version, row.v.path) if row and row.v else (0, None)

    def exists(self) -> bool:
        return self._current()[1] is not None

    def read(self) -> DataFrame:
        path = self._current()[1]
        if path is None:
            if self.schema is None:
                raise ValueError(f"no table at {self.root}")
            return self.spark.createDataFrame([], self.schema)
        if self.schema is not None:
            return self.spark.read.schema(self.schema).parquet(path)
        return self.spark.read.option("mergeSchema", True).parquet(path)

    def append(self, df: DataFrame) -> None:
        """Add rows in the stored types. Values that do not fit a stored type end the append before anything is written."""
        version, path = self._current()
        if path is None:
            self.replace(df)
            return
        stored = self.read().schema
        shared = [c for c in df.columns if c in stored.names]
        lost = {c: n for c, n in count_misfits(df, stored, shared).items() if n}
        if lost:
            raise ValueError(f"values that do not fit the stored types: {lost}")
        typed = df.withColumns({c: F.col(f"`{c}`").cast(stored[c].dataType) for c in shared if df.schema[c].dataType != stored[c].dataType})
        typed.write.mode("append").parquet(path)
        if self._current()[0] != version:
            raise RuntimeError(f"{self.root} was replaced during an append; append again")

    def replace(self, df: DataFrame) -> None:
        version = self._current()[0] + 1
        path = f"{self.root}/data-{version:08d}"
        df.write.parquet(path)
        self.spark.createDataFrame([(version, path)], _VERSIONS).coalesce(1).write.mode("append").parquet(
            f"{self.root}/_versions_"
        )

    def clear(self) -> int:
        """Make the table empty, keeping its columns; returns how many rows it had."""
        rows = self.read()
        count = rows.count()
        self.replace(rows.limit(0))
        return count


def clear_tables(tables: dict[str, Table], confirm: bool = False) -> dict[str, int]:
    """Empty the tables and return the number of deleted rows of each and in total."""
    if not confirm:
        raise ValueError("clear_tables needs confirm=True")
    deleted = {name: t.clear() for name, t in tables.items()}
    return {**deleted, "total_deleted": sum(deleted.values())}


def insert_predictions(df: DataFrame, now=None) -> DataFrame:
    """Rows ready for the prediction table: creation time, feedback time where an outcome is known."""
    stamp = F.lit(now).cast("timestamp_ntz") if now is not None else F.current_timestamp().cast("timestamp_ntz")
    made = {"created_at": stamp}
    if "actual_outcome" in df.columns:
        made["feedback_date"] = F.when(F.col("actual_outcome").isNotNull(), stamp)
    return df.withColumns(made)


def version_stamp(at: datetime | None = None) -> str:
    return (at or datetime.now(timezone.utc)).strftime("v%Y%m%dT%H%M%SZ")


def latest_versions(manifest: DataFrame) -> DataFrame:
    """The newest manifest entry of each model type."""
    return latest_per_key(manifest, ["model_type"], ["timestamp", "version"])


class ModelStore:
    """Fitted pipelines with a manifest; the newest entry is the active model."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Table(spark, f"{self.root}/manifest", MANIFEST_SCHEMA)
        self.metrics = Table(spark, f"{self.root}/metrics", S.METRICS_SCHEMA)

    def save(self, model: PipelineModel, features: list[str], metrics: dict, model_type: str = "gbt",
             source: str = "training", at: datetime | None = None) -> str:
        at = at or datetime.now(timezone.utc)
        version = version_stamp(at)
        path = f"{self.root}/models/{version}"
        model.write().save(path)
        when = at.replace(tzinfo=None)
        numbers = {k: float(v) for k, v in metrics.items() if v is not None}
        self.manifest.append(self.spark.createDataFrame(
            [(version, model_type, path, features, numbers, source, when)], MANIFEST_SCHEMA
        ))
        row = {**metrics, "model_type": model_type, "model_version": version, "evaluation_date": when, "notes": source}
        self.metrics.append(self.spark.createDataFrame([[row.get(c) for c in S.METRICS_SCHEMA.names]], S.METRICS_SCHEMA))
        return version

    def entry(self, model_type: str = "gbt") -> dict:
        row = latest_versions(self.manifest.read().where(F.col("model_type") == model_type)).first()
        if row is None:
            raise ValueError(f"no {model_type} model in {self.root}")
        return row.asDict()

    def load(self, model_type: str = "gbt") -> tuple[PipelineModel, list[str], str]:
        """Newest pipeline, its feature order and version; fails if a part is missing."""
        found = self.entry(model_type)
        if not found["features"]:
            raise ValueError(f"manifest entry {found['version']} has no feature order")
        return PipelineModel.load(found["path"]), found["features"], found["version"]

    def rollback(self, version: str) -> None:
        """Make an older version the newest entry again."""
        old = self.manifest.read().where(F.col("version") == version).limit(1)
        if old.isEmpty():
            raise ValueError(f"unknown version {version}")
        now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        self.manifest.append(old.withColumn("timestamp", now))
