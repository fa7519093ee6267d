"""Validation rule sets, cell coercion and row quarantine."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens import schema as S


@dataclass(frozen=True)
class Rule:
    column: str
    low: float | None = None
    high: float | None = None
    domain: tuple[str, ...] = ()
    required: bool = False

    def violation(self) -> Column:
        """A short reason where the rule is broken, else null."""
        c = F.col(self.column)
        found = F.when(c.isNull(), f"{self.column}: missing") if self.required else F.when(F.lit(False), "")
        if self.low is not None:
            found = found.when(c < self.low, f"{self.column}: below {self.low:g}")
        if self.high is not None:
            found = found.when(c > self.high, f"{self.column}: above {self.high:g}")
        if self.domain:
            found = found.when(~c.isin(list(self.domain)), f"{self.column}: not in domain")
        return found


# The bounds of each rule set.
STRICT_RULES = [
    Rule(c, 18, 100, required=True) if c == "person_age" else Rule(c, required=True) for c in S.CANONICAL
]
RANGE_RULES = [
    Rule("person_age", 18, 100),
    Rule("person_income", 0),
    Rule("person_emp_length", 0),
    Rule("loan_amnt", 0),
    Rule("loan_int_rate", 0, 100),
    Rule("loan_percent_income", 0, 1),
    Rule("cb_person_cred_hist_length", 0),
]
FORM_RULES = [
    Rule("person_age", 18, 120, required=True),
    Rule("person_income", 0, required=True),
    Rule("person_emp_length", 0, required=True),
    Rule("loan_amnt", 100, required=True),
    Rule("loan_int_rate", 0, 100, required=True),
    Rule("loan_percent_income", 0, 1, required=True),
    Rule("cb_person_cred_hist_length", 0, required=True),
] + [Rule(c, domain=tuple(v), required=True) for c, v in S.VOCABULARY.items()]
LEGACY_FORM_RULES = [
    Rule("person_age", 18, 120),
    Rule("person_income", 0, 1000000),
    Rule("person_emp_length", 0, 600),
    Rule("loan_amnt", 1000, 100000),
    Rule("loan_int_rate", 0, 30),
    Rule("loan_percent_income", 0, 1),
]


def violations(rules: list[Rule]) -> Column:
    return F.array_compact(F.array(*[r.violation() for r in rules]))


def validate(df: DataFrame, rules: list[Rule], errors: str = "errors") -> DataFrame:
    """Add the list of broken rules; an empty list means valid."""
    return df.withColumn(errors, violations(rules))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, rules)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def quarantine(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``status`` and ``error``: a broken row is marked, the others go on."""
    reasons = violations(rules)
    return df.withColumns({
        "status": F.when(F.size(reasons) > 0, "error").otherwise("success"),
        "error": F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")),
    })


def _shown(c: Column) -> Column:
    return c.cast("string")


def validation_warnings(df: DataFrame) -> DataFrame:
    """Add ``validation_warnings`` and ``is_valid`` as in the dynamic path.

    A row without any value is invalid; otherwise a row is valid unless a warning other than
    "will be imputed" applies.
    """
    present = [c for c in S.CANONICAL if c in df.columns]
    empty = F.coalesce(*[F.col(c).cast("string") for c in present]).isNull()
    missing = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), c) for c in ("person_income", "loan_amnt") if c in present
    ]))
    soft = F.when(
        F.size(missing) > 0,
        F.concat(F.lit(S.WARN_MISSING), F.array_join(missing, ", ")),
    )
    age, ratio = F.col("person_age"), F.col("loan_percent_income")
    hard = [
        F.when(
            (age < 18) | (age > 100),
            F.concat(F.lit(S.WARN_AGE[0]), _shown(age), F.lit(S.WARN_AGE[1])),
        ),
        F.when(
            ratio > 1, F.concat(F.lit(S.WARN_RATIO[0]), _shown(ratio), F.lit(S.WARN_RATIO[1]))
        ),
    ] + [
        F.when(F.col(c) < 0, F.concat(F.lit(c + S.WARN_NEGATIVE), _shown(F.col(c))))
        for c in ("person_income", "person_emp_length", "loan_amnt", "loan_int_rate", "cb_person_cred_hist_length")
    ]
    nothing = F.array(F.lit(S.WARN_EMPTY))
    broken = F.coalesce(*hard).isNotNull()
    return df.withColumns({
        "validation_warnings": F.when(empty, nothing).otherwise(F.array_compact(F.array(soft, *hard))),
        "is_valid": ~empty & ~broken,
    })


def coerce_number(cell: Column) -> Column:
    """Leading number of a text cell, 0 where there is none; an empty cell stays missing."""
    text = F.trim(cell.cast("string"))
    leading = F.regexp_extract(text, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(cell.isNotNull() & (cell != ""), F.coalesce(leading.try_cast("double"), F.lit(0.0)))


def coerce_choice(column: str, cell: Column) -> Column:
    """Trimmed upper-case value if it is in the domain, else missing; the default flag takes 0/1 words."""
    value = F.upper(F.trim(cell.cast("string")))
    kept = F.when(value.isin(S.VOCABULARY[column]), value)
    if column == "default_on_file":
        kept = F.when(value.isin("0", "FALSE", "NO"), "N").when(value.isin("1", "TRUE", "YES"), "Y").otherwise(kept)
    return kept


def coerce_cells(df: DataFrame) -> DataFrame:
    """Text cells to typed canonical columns; other columns stay text, '' becomes null."""
    made = {}
    for c in df.columns:
        if c in S.NUMERIC:
            made[c] = coerce_number(F.col(c))
        elif c in S.VOCABULARY:
            made[c] = coerce_choice(c, F.col(c))
        elif dict(df.dtypes)[c] == "string":
            made[c] = F.when(F.col(c) != "", F.col(c))
    return df.withColumns(made)


def drop_blank_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows in which every cell is null or ''."""
    cells = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns or df.columns]
    return df.where(F.coalesce(*cells).isNotNull())
