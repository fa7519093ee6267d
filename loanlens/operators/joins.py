"""Joins and updates between the stored tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators.reports import latest_per_key


def join_application_prediction(predictions: DataFrame, applications: DataFrame) -> DataFrame:
    """Every prediction with its application, if it has one."""
    apps = applications.withColumnsRenamed({c: f"application_{c}" for c in applications.columns if c != "id"})
    apps = apps.withColumnRenamed("id", "application_id")
    return predictions.join(apps, "application_id", "left")


def unscored_applications(applications: DataFrame, predictions: DataFrame) -> DataFrame:
    """Applications without a prediction; ids are made unique first, so a hot one is not shuffled whole."""
    scored = predictions.select(F.col("application_id").alias("id")).distinct()
    return applications.join(scored, "id", "left_anti")


def apply_updates(table: DataFrame, updates: DataFrame, key: str = "id", order: list[str] = ("updated_at",),
                  columns: list[str] | None = None, null_sets: bool = False) -> DataFrame:
    """``table`` with the newest update of each key laid over it; unknown keys change nothing.

    ``updates`` may hold any of the table's columns; a null there leaves the old value, or with ``null_sets``
    becomes the new one.
    """
    columns = columns or [c for c in updates.columns if c in table.columns and c != key]
    newest = latest_per_key(updates, [key], list(order)).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_new"))

    def value(c: str):
        return F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)) if null_sets else F.coalesce(f"_new_{c}", c)

    return table.join(newest, key, "left").select(*[value(c).alias(c) if c in columns else F.col(c) for c in table.columns])


def record_feedback(predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Predictions with outcome and feedback time from ``(id, actual_outcome, feedback_date)`` rows."""
    return apply_updates(predictions, feedback, "id", ["feedback_date", "actual_outcome"])


def union_batch_status(scored: DataFrame, errors: DataFrame) -> DataFrame:
    """Scored rows and failed rows in one result."""
    return scored.withColumn("status", F.lit("success")).unionByName(
        errors.withColumn("status", F.lit("error")), allowMissingColumns=True
    )
