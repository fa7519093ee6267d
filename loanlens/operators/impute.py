"""Missing-value rules for applications (one projection) and for training frames."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.operators.stats import FillValues, medians


def with_all_columns(df: DataFrame) -> DataFrame:
    """Add the canonical columns that are absent, as nulls of the right type."""
    absent = {
        f.name: F.lit(None).cast(f.dataType) for f in S.APPLICATION_SCHEMA if f.name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def uppercase_categoricals(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.upper(c) for c in S.CATEGORICAL if c in df.columns})


def derived_ratio() -> Column:
    """``loan_amnt / person_income`` where the ratio is missing and both are known, else null."""
    return F.when(
        F.col("loan_percent_income").isNull() & (F.col("person_income") > 0),
        F.col("loan_amnt") / F.col("person_income"),
    )


def derive_loan_percent_income(df: DataFrame) -> DataFrame:
    return df.withColumn("loan_percent_income", F.coalesce("loan_percent_income", derived_ratio()))


def _numeric_fill(column: str, fill: FillValues) -> tuple[float, str]:
    if column in fill.medians:
        return fill.medians[column], S.NOTE_MEDIAN
    if column in fill.means:
        return fill.means[column], S.NOTE_MEAN
    return S.NUMERIC_DEFAULTS[column], S.NOTE_DEFAULT


def _categorical_fill(column: str, fill: FillValues) -> tuple[str, str]:
    if column in fill.modes:
        return fill.modes[column], S.NOTE_MODE
    return S.CATEGORICAL_DEFAULTS[column], S.NOTE_DEFAULT


def impute(df: DataFrame, fill: FillValues, log: str | None = "imputation_log") -> DataFrame:
    """Fill the canonical columns and, if ``log`` is given, list what was filled and how.

    Target columns are dropped. The ratio is derived from values that were really present.
    """
    df = with_all_columns(df.drop(*S.TARGETS))
    ratio = derived_ratio()
    made, notes = {}, []
    notes.append(F.when(ratio.isNotNull(), S.NOTE_DERIVED))
    for column in S.NUMERIC:
        value, source = _numeric_fill(column, fill)
        known = F.coalesce(column, ratio) if column == "loan_percent_income" else F.col(column)
        made[column] = F.coalesce(known.cast("double"), F.lit(float(value)))
        notes.append(F.when(known.isNull(), f"{column}: {source}"))
    for column in S.CATEGORICAL:
        value, source = _categorical_fill(column, fill)
        made[column] = F.coalesce(column, F.lit(value))
        notes.append(F.when(F.col(column).isNull(), f"{column}: {source}"))
    if log:
        made[log] = F.array_compact(F.array(*notes))
    return df.withColumns(made)


def impute_numeric(df: DataFrame, fill: FillValues) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(float(_numeric_fill(c, fill)[0])))
        for c in S.NUMERIC if c in df.columns
    })


def impute_categorical(df: DataFrame, fill: FillValues) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(c, F.lit(_categorical_fill(c, fill)[0])) for c in S.CATEGORICAL if c in df.columns
    })


def to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; what does not parse becomes null."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in columns})


def train_medians(df: DataFrame, columns: list[str], accuracy: int | None = None) -> dict[str, float]:
    return medians(df, columns, accuracy)


def impute_train_median(df: DataFrame, columns: list[str], medians: dict[str, float]) -> DataFrame:
    """Column median for nulls; a column without any value stays null."""
    return df.withColumns({
        c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[c])) for c in columns if c in medians
    })


def impute_train_unknown(df: DataFrame, columns: list[str], upper: bool = True) -> DataFrame:
    def filled(c: str) -> Column:
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("UNKNOWN"))
        return F.upper(value) if upper else value

    return df.withColumns({c: filled(c) for c in columns})


def fill_residual_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns})
