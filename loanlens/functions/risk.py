"""Scalar rules on scores and outcomes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens import schema as S


def risk_tier(p: Column, threshold: float = S.HIGH_THRESHOLD) -> Column:
    return (
        F.when(p > threshold, S.HIGH_RISK)
        .when(p > S.BORDERLINE_THRESHOLD, S.BORDERLINE_RISK)
        .when(p.isNotNull(), S.LOW_RISK)
    )


def probability_percent(p: Column) -> Column:
    return F.round(p * 100, 2)


def decision_label(prediction: Column) -> Column:
    return F.when(prediction == 1, S.REJECTED).when(prediction.isNotNull(), S.APPROVED)


def outcome_label(outcome: Column) -> Column:
    return F.when(outcome == 1, S.DEFAULTED).otherwise(S.NOT_DEFAULTED)


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; 0 where there is nothing."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def target_from_text(value: Column) -> Column:
    """0/1 for a known outcome word, null for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in S.TARGET_LABELS.items() for x in pair])
    return F.try_element_at(table, F.lower(value.cast("string")))


def outcome_from_columns(*candidates: Column) -> Column:
    """First non-null candidate as 0/1: numbers cut to whole ones, yes-words 1, other text 0; NaN and numbers too large: null."""
    first = F.coalesce(*[c.cast("string") for c in candidates])
    number = first.try_cast("double")
    return F.when(
        first.isNotNull(),
        F.when(number.isNotNull(), number.try_cast("int")).otherwise(F.lower(first).isin(S.TRUTHY_OUTCOMES).cast("int")),
    )
