"""Classifier metrics from label, prediction and score columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions.risk import ratio_or_zero
from loanlens.operators.ordered import running_totals, with_previous


def _pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows that have both; rows without a label or a prediction count nowhere."""
    pairs = df.select(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("z"))
    return pairs.where("y IS NOT NULL AND z IS NOT NULL")


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, precision, recall, F1 (0 when undefined) and the counts; one pass."""
    y, z = F.col("y"), F.col("z")
    counts = _pairs(df, label, prediction).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(y == z).alias("correct_predictions"),
        F.count_if((z == 1) & (y == 0)).alias("false_positives"),
        F.count_if((z == 0) & (y == 1)).alias("false_negatives"),
        F.count_if((z == 1) & (y == 1)).alias("_tp"),
    )
    tp, fp, fn = F.col("_tp"), F.col("false_positives"), F.col("false_negatives")
    return counts.select(
        ratio_or_zero(F.col("correct_predictions"), F.col("total_predictions")).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        "total_predictions", "correct_predictions", "false_positives", "false_negatives",
    )


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; rows without a score (null, NaN) rank nowhere and are left out."""
    value = F.col(score).cast("double")
    return df.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def auc_roc(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """One row ``auc_roc``: chance that a positive outranks a negative, ties counting half."""
    ranked = running_totals(score_counts(df, label, score), [], ["score"], {"neg_upto": "neg"})
    below = F.col("neg_upto") - F.col("neg")
    sums = ranked.agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("won"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
    )
    return sums.select(F.try_divide(F.col("won"), F.col("p").cast("double") * F.col("n")).alias("auc_roc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "probability", bins: int | None = None) -> DataFrame:
    """``(threshold, fpr, tpr, area)`` per distinct score, or per score bin; ``area`` is the trapezoid ending there."""
    value = F.col(score).cast("double")
    if bins:
        value = F.floor(value * bins) / bins
    counts = score_counts(df.withColumn("_s", value), label, "_s").withColumn("_down", -F.col("score"))
    ranked = running_totals(counts, [], ["_down"], {"tp": "pos", "fp": "neg"})
    p = ranked.agg(F.max("tp")).scalar()  # the last running total, read from the written blocks
    n = ranked.agg(F.max("fp")).scalar()
    tpr, fpr = F.try_divide(F.col("tp").cast("double"), p), F.try_divide(F.col("fp").cast("double"), n)
    step = F.try_divide(F.col("neg").cast("double"), n)
    height = F.try_divide(F.col("tp") - F.col("pos") / 2.0, p)
    return ranked.select(
        F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"), (step * height).alias("area")
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (
        _pairs(df, label, prediction).groupBy(F.col("y").alias("label")).pivot("z", [0, 1])
        .agg(F.count(F.lit(1))).na.fill(0)
        .withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(class, precision, recall, f1_score, support)`` for 0, 1, accuracy, macro and weighted average."""
    y, z = F.col("y"), F.col("z")
    counts = _pairs(df, label, prediction).agg(*[
        F.count_if((y == a) & (z == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)
    ])
    c = {(a, b): F.col(f"c{a}{b}") for a in (0, 1) for b in (0, 1)}
    per = {}
    for k in (0, 1):
        hit, said, real = c[k, k], c[0, k] + c[1, k], c[k, 0] + c[k, 1]
        per[k] = (ratio_or_zero(hit, said), ratio_or_zero(hit, real), ratio_or_zero(2 * hit, said + real), real)
    total = per[0][3] + per[1][3]
    accuracy = ratio_or_zero(c[0, 0] + c[1, 1], total)

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1_score"), support.alias("support"),
        )

    macro = [(per[0][i] + per[1][i]) / 2 for i in range(3)]
    weighted = [ratio_or_zero(per[0][i] * per[0][3] + per[1][i] * per[1][3], total) for i in range(3)]
    lines = F.array(
        line("0", *per[0]), line("1", *per[1]), line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *macro, total), line("weighted avg", *weighted, total),
    )
    return counts.select(F.inline(lines))


def live_accuracy(predictions: DataFrame) -> DataFrame:
    known = F.col("actual_outcome").isNotNull()
    right = F.count_if(F.col("binary_prediction") == F.col("actual_outcome"))
    return predictions.agg(F.count_if(known).alias("with_feedback"), right.alias("correct")).select(
        "with_feedback", "correct", (ratio_or_zero(F.col("correct"), F.col("with_feedback")) * 100).alias("accuracy_pct")
    )


def retraining_readiness(predictions: DataFrame | None, min_samples: int = 100,
                         min_feedback_ratio: float = 0.1, spark=None) -> DataFrame:
    """One row: totals, whether retraining may start, and what is still missing. ``None`` = no table yet."""
    if predictions is None:
        counts = spark.range(1).select(
            F.lit(0).cast("bigint").alias("total_predictions"), F.lit(0).cast("bigint").alias("feedback_count")
        )
    else:
        counts = predictions.agg(
            F.count(F.lit(1)).alias("total_predictions"), F.count("actual_outcome").alias("feedback_count")
        )
    total, known = F.col("total_predictions"), F.col("feedback_count")
    ratio = ratio_or_zero(known, total)
    zero = F.lit(0).cast("bigint")
    return counts.select(
        ((total >= min_samples) & (ratio >= min_feedback_ratio)).alias("is_ready"),
        total, known, ratio.alias("feedback_ratio"),
        F.greatest(zero, min_samples - total).alias("samples_needed"),
        F.greatest(zero, int(min_samples * min_feedback_ratio) - known).alias("feedback_needed"),
    )


def metrics_gate(metrics: DataFrame, target: float = 0.85, alarm: float = 0.75) -> DataFrame:
    """Per metrics row: change of accuracy since the previous one of its type, and the quality flags."""
    rows = with_previous(metrics, ["model_type"], ["evaluation_date", "model_version"], "accuracy", "_previous")
    return rows.withColumn("accuracy_change", F.col("accuracy") - F.col("_previous")).drop("_previous").withColumns({
        "accuracy_dropped": F.coalesce(F.col("accuracy_change") < 0, F.lit(False)),
        "auc_alarm": F.col("auc_roc") < alarm,
        "meets_target": (F.col("accuracy") > target) & (F.col("auc_roc") > target),
    })
