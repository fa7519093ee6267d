"""Input values against training statistics: range first, else three deviations around the mean."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens import schema as S


def _finding(feature: str, value: Column, s: dict) -> Column:
    low, high = s["mean"] - 3 * s["std"], s["mean"] + 3 * s["std"]

    def found(kind: str, lower: float, upper: float) -> Column:
        return F.struct(
            F.lit(feature).alias("feature"), value.alias("value"), F.lit(kind).alias("kind"),
            F.lit(float(lower)).alias("lower"), F.lit(float(upper)).alias("upper"),
        )

    return F.when((value < s["min"]) | (value > s["max"]), found("range", s["min"], s["max"])).when(
        (value < low) | (value > high), found("sigma", low, high)
    )


def drift_check(df: DataFrame, stats: dict | None = None, name: str = "drift") -> DataFrame:
    """Add an array of ``(feature, value, kind, lower, upper)``; one projection, no join."""
    stats = stats or S.TRAINING_STATISTICS
    checks = [
        _finding(f, F.col(f).try_cast("double"), s) for f, s in stats.items() if f in df.columns
    ]
    return df.withColumn(name, F.array_compact(F.array(*checks)))


def drift_notes(findings: Column) -> Column:
    """The findings as text: range bounds as they are, deviations with two places."""
    def text(d: Column) -> Column:
        outside = F.when(d["kind"] == "range", S.DRIFT_OUTSIDE["range"]).otherwise(S.DRIFT_OUTSIDE["sigma"])
        whole = F.concat(d["lower"].cast("string"), F.lit(", "), d["upper"].cast("string"))
        span = F.when(d["kind"] == "range", whole).otherwise(F.format_string("%.2f, %.2f", d["lower"], d["upper"]))
        return F.concat(d["feature"], F.lit(S.DRIFT_VALUE), d["value"].cast("string"), outside, span, F.lit("]"))

    return F.transform(findings, text)


def join_stats(values: DataFrame, stats: DataFrame) -> DataFrame:
    """Tall ``(feature, value)`` rows with their feature's statistics; ``stats`` holds one row per column, which bounds it."""
    return values.join(F.broadcast(stats), "feature", "left")
