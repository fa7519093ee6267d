"""Bulk scoring: validate, impute, encode, score, tier, drift, in one plan."""

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.functions.risk import probability_percent, risk_tier
from loanlens.functions.text import operational_notes
from loanlens.operators import explain as X
from loanlens.operators import validate as V
from loanlens.operators.drift import drift_check, drift_notes
from loanlens.operators.encode import encode_for_model
from loanlens.operators.impute import impute, uppercase_categoricals, with_all_columns
from loanlens.operators.stats import FillValues


@dataclass
class Scorer:
    """A fitted pipeline with its feature order, fill values and version."""

    model: PipelineModel
    features: list[str]
    fill: FillValues
    version: str = "unversioned"
    _explainer: X.Explainer | None = field(default=None, init=False, repr=False, compare=False)

    def explainer(self, spark: SparkSession) -> X.Explainer:
        """Built at the first explanation and kept."""
        if self._explainer is None:
            self._explainer = X.Explainer(spark, self.model.stages[-1])
        return self._explainer


def score(encoded: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``probability_default`` and ``binary_prediction`` to encoded rows."""
    out = model.transform(encoded)
    return out.withColumns({
        "probability_default": vector_to_array("probability")[1],
        "binary_prediction": F.col("prediction").cast("int"),
    }).drop("rawPrediction", "probability", "prediction")


def score_batch(applications: DataFrame, scorer: Scorer, key: str = "application_id", mode: str = "dynamic",
                threshold: float = S.HIGH_THRESHOLD, explain: bool = False, stats: dict | None = None) -> DataFrame:
    """Score every application; a row that breaks a rule gets status ``error`` and no score.

    ``dynamic`` imputes missing values and checks drift on the result; ``strict`` demands complete
    records. Nothing is shuffled: each step is a projection on the row.
    """
    if mode not in ("dynamic", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = uppercase_categoricals(with_all_columns(applications.drop(*S.TARGETS)))
    rows = V.quarantine(rows, V.RANGE_RULES if mode == "dynamic" else V.STRICT_RULES)
    rows = V.validation_warnings(rows)
    if mode == "dynamic":
        rows = impute(rows, scorer.fill)
    else:
        rows = rows.withColumn("imputation_log", F.array().cast("array<string>"))
    rows = drift_check(rows, stats)
    carried = [key, "status", "error", "imputation_log", "validation_warnings", "drift", "inputs"]
    rows = rows.withColumn("inputs", F.struct(*S.CANONICAL))
    encoded = encode_for_model(rows, scorer.features, carried)
    scored = score(encoded, scorer.model)
    if explain:
        scored = scorer.explainer(applications.sparkSession).explain(scored, scorer.features)
    ok = F.col("status") == "success"
    p = F.col("probability_default")
    out = {
        key: F.col(key), "status": F.col("status"), "error": F.col("error"),
        "risk_level": F.when(ok, risk_tier(p, threshold)),
        "probability_default": F.when(ok, p),
        "probability_default_percent": F.when(ok, probability_percent(p)),
        "binary_prediction": F.when(ok, F.col("binary_prediction")),
        "imputation_log": F.col("imputation_log"),
        "operational_notes": operational_notes(
            F.col("imputation_log"), F.col("validation_warnings"), drift_notes(F.col("drift"))
        ),
        "drift": F.col("drift"),
        "input_features": F.col("inputs"),
    }
    if explain:
        out["shap_values"] = F.when(ok, F.col("shap_values"))
        out["expected_value"] = F.col("expected_value")
    return scored.select(*[v.alias(k) for k, v in out.items()])


def prediction_rows(scored: DataFrame, version: str, model_type: str = "dynamic", now=None,
                    key: str = "application_id") -> DataFrame:
    """Scored rows in the layout of the prediction table (failed rows are not logged)."""
    stamp = F.lit(now).cast("timestamp_ntz") if now is not None else F.current_timestamp().cast("timestamp_ntz")
    shap = F.col("shap_values") if "shap_values" in scored.columns else F.lit(None).cast("map<string,double>")
    return scored.where(F.col("status") == "success").select(
        F.col(key).alias("application_id"), F.to_json("input_features").alias("input_features"), "risk_level",
        "probability_default", "binary_prediction", F.lit(model_type).alias("model_type"),
        F.lit(version).alias("model_version"), shap.alias("shap_values"), stamp.alias("created_at"),
    )


def compare_paths(applications: DataFrame, scorer: Scorer, key: str = "application_id") -> DataFrame:
    """Tier of the same complete record by both modes, side by side."""
    strict = score_batch(applications, scorer, key, "strict").where(F.col("status") == "success")
    dynamic = score_batch(applications, scorer, key, "dynamic").where(F.col("status") == "success")
    left = strict.select(key, F.col("risk_level").alias("strict_tier"), F.col("probability_default").alias("strict_p"))
    right = dynamic.select(key, F.col("risk_level").alias("dynamic_tier"), F.col("probability_default").alias("dynamic_p"))
    return left.join(right, key).withColumn("tiers_match", F.col("strict_tier") == F.col("dynamic_tier"))
