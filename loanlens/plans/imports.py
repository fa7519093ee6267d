"""Import of applications with known outcomes, as application and prediction rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.functions.names import check_name
from loanlens.functions.risk import outcome_from_columns
from loanlens.operators import mapping as M
from loanlens.operators.ordered import with_row_index
from loanlens.plans.history import HistoryStatistics
from loanlens.session import materialize


def coerce_outcome(df: DataFrame, name: str = "actual_outcome") -> DataFrame:
    """Outcome from the target columns in their fixed order; null if none holds a value."""
    present = [F.col(c) for c in S.TARGETS if c in df.columns]
    return df.withColumn(name, outcome_from_columns(*present) if present else F.lit(None).cast("int"))


def link_ids(df: DataFrame, order: list[str], last_id: int = 0, blocks: int | None = None) -> DataFrame:
    """Give each row an id after ``last_id`` in ``order``.

    The numbering is written once; both outputs of an import read the same ids.
    """
    return with_row_index(df, order, "id", last_id + 1, blocks)


def stored_history(df: DataFrame, order: list[str], mapping: dict | None = None, last_id: int = 0) -> DataFrame:
    """The rows of a history file under the names of the application table, numbered after ``last_id``."""
    rows = M.nan_to_null(M.rename_aliases(M.normalize_columns(df), mapping))
    return link_ids(rows.withColumn("application_status", F.lit("approved")), order, last_id)


def import_history(df: DataFrame, order: list[str], mapping: dict | None = None, last_id: int = 0,
                   now=None) -> tuple[DataFrame, DataFrame]:
    """``(applications, predictions)`` of a history file.

    ``order`` names columns, after mapping, that give the rows their id order.
    """
    stored = stored_history(df, order, mapping, last_id)
    features = [c for c in stored.columns if c not in S.TARGETS and c not in ("id",)]
    packed = M.pack_features(coerce_outcome(stored), features, keep_nulls=True)
    stamp = F.lit(now).cast("timestamp_ntz") if now is not None else F.current_timestamp().cast("timestamp_ntz")
    predictions = packed.select(
        F.col("id").alias("application_id"), "input_features", F.lit(S.HISTORY_LEVEL).alias("risk_level"),
        F.lit(S.HISTORY_SCORE).alias("probability_default"),
        F.coalesce("actual_outcome", F.lit(0)).alias("binary_prediction"),
        F.lit(S.HISTORY_TYPE).alias("model_type"), "actual_outcome",
        F.when(F.col("actual_outcome").isNotNull(), stamp).alias("feedback_date"),
    )
    return M.create_dynamic_table(stored), predictions


def import_history_minimal(df: DataFrame) -> DataFrame:
    """Prediction rows straight from the raw dataset: fixed columns, nulls left out, placeholder score."""
    renamed = df.withColumnsRenamed(S.RAW_NAMES)
    features = [c for c in S.CANONICAL if c in renamed.columns]
    outcome = F.col("loan_status").try_cast("double").cast("int")
    return M.pack_features(renamed, features).select(
        "input_features", F.lit(S.MINIMAL_LEVEL).alias("risk_level"), F.lit(S.MINIMAL_SCORE).alias("probability_default"),
        F.coalesce(outcome, F.lit(0)).alias("binary_prediction"),
        F.lit(S.MINIMAL_TYPE).alias("model_type"), outcome.alias("actual_outcome"),
    )


def import_into(df: DataFrame, applications, predictions, order: list[str], mapping: dict | None = None,
                statistics: HistoryStatistics | None = None) -> int:
    """Run ``import_history`` against stored tables (schema widened as needed); returns the row count.

    A cell that does not fit the stored type of its column becomes null there and is kept as ``column=value`` in
    ``notes``. Both outputs come from one written batch, and so does its part of ``statistics``, which bears the number of
    the batch's first id.
    """
    last = 0
    if applications.exists():
        last = applications.read().agg(F.max("id")).first()[0] or 0
    new_apps, new_preds = import_history(df, order, mapping, last)
    if applications.exists():
        old = applications.read()
        missing = [f for f in new_apps.schema if f.name not in old.columns]
        for f in missing:
            check_name(f.name)
        cast = {c: F.col(c).try_cast(old.schema[c].dataType) for c in new_apps.columns if c in old.columns and c != "notes"}
        kept = [F.when(F.col(c).isNotNull() & v.isNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c, v in cast.items()]
        notes = F.concat_ws("; ", "notes", *kept)
        new_apps = new_apps.withColumns({**cast, "notes": F.when(notes != "", notes)})
    new_apps = materialize(new_apps, "import")
    applications.append(new_apps)
    predictions.append(new_preds)
    count = new_apps.count()
    if statistics is not None and count:
        statistics.add(new_apps, last + 1)
    return count
