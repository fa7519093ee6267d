"""Text clean-up and rendering."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanlens import schema as S


def clean_response(text: Column) -> Column:
    """Drop sequence markers, shorten runs of blank lines, trim."""
    bare = F.regexp_replace(text, r"</?s>", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def operational_notes(imputation_log: Column, warnings: Column, drift: Column) -> Column:
    """One line from the three note lists; at most 5 imputations and 3 drift notes are shown."""
    parts = [
        F.when(
            F.size(imputation_log) > 0,
            F.concat(
                F.lit(S.NOTES_IMPUTED[0]), F.size(imputation_log).cast("string"), F.lit(S.NOTES_IMPUTED[1]),
                F.array_join(F.slice(imputation_log, 1, 5), ", "),
            ),
        ),
        F.when(F.size(warnings) > 0, F.concat(F.lit(S.NOTES_WARNINGS), F.array_join(warnings, "; "))),
        F.when(
            F.size(drift) > 0,
            F.concat(F.lit(S.NOTES_DRIFT), F.array_join(F.slice(drift, 1, 3), "; ")),
        ),
    ]
    return F.concat_ws(S.NOTES_BAR, *parts)


def explanation_prompt(tier: Column, contributions: Column, applicant: Column) -> Column:
    """Request text for one decision: tier, strongest contributions, applicant data."""
    return F.concat(
        F.lit("Explain this loan decision to the applicant in one short paragraph.\nDecision: "), tier,
        F.lit("\nStrongest contributions: "), contributions,
        F.lit("\nApplicant: "), applicant,
    )
