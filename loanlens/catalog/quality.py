"""Queries for validation and imputation."""

from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.catalog import views as W
from loanlens.catalog.registry import query, r6
from loanlens.operators import drift as D
from loanlens.operators import impute as I
from loanlens.operators import stats as A
from loanlens.operators import validate as V
from loanlens.operators.stats import FillValues
from loanlens.plans.history import HistoryStatistics
from loanlens.session import materialize, scratch_path

_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in S.NUMERIC)
_CATEGORIES = ", ".join(S.CATEGORICAL)


def _rounded(df, *extra):
    return df.select("application_id", *[r6(c).alias(c) for c in S.NUMERIC if c in df.columns], *extra)


def _rule_sql(rule: V.Rule) -> str:
    c = rule.column
    arms = []
    if rule.required:
        arms.append(f"WHEN {c} IS NULL THEN '{c}: missing'")
    if rule.low is not None:
        arms.append(f"WHEN {c} < {rule.low} THEN '{c}: below {rule.low:g}'")
    if rule.high is not None:
        arms.append(f"WHEN {c} > {rule.high} THEN '{c}: above {rule.high:g}'")
    if rule.domain:
        arms.append(f"WHEN {c} NOT IN ({', '.join(repr(v) for v in rule.domain)}) THEN '{c}: not in domain'")
    return f"CASE {' '.join(arms)} END" if arms else "NULL"


def _rules_sql(rules) -> str:
    return "array_to_string(list_filter([" + ", ".join(_rule_sql(r) for r in rules) + "], lambda x: x IS NOT NULL), '; ')"


def _checked(spark, sf_dir, rules, upper=True):
    rows = W.applications(spark, sf_dir)
    rows = V.validate(I.uppercase_categoricals(rows) if upper else rows, rules)
    return rows.select("application_id", F.array_join("errors", "; ").alias("errors"), (F.size("errors") == 0).alias("valid"))


def _checked_sql(rules) -> str:
    return f"SELECT application_id, e AS errors, e = '' AS valid FROM (SELECT application_id, {_rules_sql(rules)} AS e FROM upper_apps)"


@query(_checked_sql(V.STRICT_RULES), "upper_apps")
def validate_strict(spark, sf_dir):
    return _checked(spark, sf_dir, V.STRICT_RULES)


@query(_checked_sql(V.RANGE_RULES), "upper_apps")
def validate_ranges(spark, sf_dir):
    return _checked(spark, sf_dir, V.RANGE_RULES)


@query(_checked_sql(V.FORM_RULES).replace("upper_apps", "apps"), "apps")
def validate_form(spark, sf_dir):
    return _checked(spark, sf_dir, V.FORM_RULES, upper=False)


@query(_checked_sql(V.LEGACY_FORM_RULES), "upper_apps")
def validate_form_legacy(spark, sf_dir):
    return _checked(spark, sf_dir, V.LEGACY_FORM_RULES)


@query("""SELECT application_id, list_contains(w, 'age') OR list_contains(w, 'ratio') AS out_of_range,
            CAST(len(w) AS INTEGER) AS warnings,
            NOT (list_contains(w, 'age') OR list_contains(w, 'ratio')) AS is_valid,
            CASE WHEN person_income IS NULL AND loan_amnt IS NULL THEN 'Critical fields missing (will be imputed): person_income, loan_amnt'
                 WHEN person_income IS NULL THEN 'Critical fields missing (will be imputed): person_income'
                 WHEN loan_amnt IS NULL THEN 'Critical fields missing (will be imputed): loan_amnt' ELSE '' END AS missing_note
          FROM (SELECT *, list_filter([
              CASE WHEN person_income IS NULL OR loan_amnt IS NULL THEN 'missing' END,
              CASE WHEN person_age < 18 OR person_age > 100 THEN 'age' END,
              CASE WHEN loan_percent_income > 1 THEN 'ratio' END], lambda x: x IS NOT NULL) AS w FROM apps)""", "apps")
def validation_warnings(spark, sf_dir):
    rows = V.validation_warnings(W.applications(spark, sf_dir))
    notes = F.col("validation_warnings")
    return rows.select(
        "application_id", "is_valid", F.size(notes).alias("warnings"),
        F.exists(notes, lambda n: n.contains("outside valid range") | n.contains("> 1 (should")).alias("out_of_range"),
        F.coalesce(
            F.try_element_at(F.filter(notes, lambda n: n.contains("will be imputed")), F.lit(1)), F.lit("")
        ).alias("missing_note"),
    )


@query(f"SELECT application_id, {_CATEGORIES} FROM upper_apps", "upper_apps")
def uppercase_categoricals(spark, sf_dir):
    return I.uppercase_categoricals(W.applications(spark, sf_dir)).select("application_id", *S.CATEGORICAL)


@query("""SELECT application_id, CASE WHEN application_id % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN application_id % 5 = 1 THEN NULL
            ELSE CAST(application_id % 1000 AS DOUBLE) END AS loan_amnt,
          CASE WHEN upper(home_ownership) IN ('RENT', 'OWN', 'MORTGAGE', 'OTHER') THEN upper(home_ownership) END AS home_ownership,
          CASE application_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'Y' WHEN 2 THEN default_on_file END AS default_on_file,
          CASE WHEN application_id % 2 = 0 THEN 'x' END AS remark FROM apps""", "apps")
def coerce_cells(spark, sf_dir):
    """Text cells as a file gives them: numbers with trailing text, padded words, 0/1 flags, blanks."""
    key = F.col("application_id")
    text = W.applications(spark, sf_dir).select(
        "application_id",
        F.when(key % 5 == 0, "n/a").when(key % 5 == 1, "")
        .otherwise(F.concat((key % 1000).cast("string"), F.lit(" USD"))).alias("loan_amnt"),
        F.concat(F.lit(" "), F.lower("home_ownership")).alias("home_ownership"),
        F.when(key % 4 == 0, "no").when(key % 4 == 1, "True").when(key % 4 == 2, F.lower("default_on_file"))
        .otherwise("maybe").alias("default_on_file"),
        F.when(key % 2 == 0, "x").otherwise("").alias("remark"),
    )
    return V.coerce_cells(text)


@query(f"""SELECT application_id, CASE WHEN e <> '' THEN 'error' ELSE 'success' END AS status,
             CASE WHEN e <> '' THEN e END AS error FROM (SELECT application_id, {_rules_sql(V.RANGE_RULES)} AS e FROM apps)""", "apps")
def quarantine_errors(spark, sf_dir):
    return V.quarantine(W.applications(spark, sf_dir), V.RANGE_RULES).select("application_id", "status", "error")


_STATS = {
    "mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "std": "stddev_samp({c})", "min": "min({c})",
    "max": "max({c})", "q25": "quantile_cont({c}, 0.25)", "q75": "quantile_cont({c}, 0.75)",
}


def _stats_sql(parts, table="apps") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, " + ", ".join(f"round({_STATS[p].format(c=c)}, 4) AS \"{p}\"" for p in parts) + f" FROM {table}"
        for c in S.NUMERIC
    )


def _stats_rows(df, parts):
    return df.select("feature", *[F.round(p, 4).alias(p) for p in parts])


@query(_stats_sql(list(_STATS)), "apps")
def historical_stats(spark, sf_dir):
    """Exact quantiles from distributed counting, moments from one pass."""
    rows = materialize(W.applications(spark, sf_dir).select(*S.NUMERIC))  # stored, as it is read several times
    return _stats_rows(A.historical_statistics(rows, S.NUMERIC), list(_STATS))


def _imported(spark, sf_dir, numeric, text) -> HistoryStatistics:
    """The applications as three imports, the last of which comes twice."""
    made = HistoryStatistics(spark, scratch_path(spark, "statistics"), numeric, text)
    rows = I.uppercase_categoricals(W.applications(spark, sf_dir))
    for number in (1, 2, 3, 3):
        made.add(rows.where(F.col("application_id") % 3 == number - 1), number)
    return made


@query(_stats_sql(list(_STATS)), "apps")
def historical_stats_by_import(spark, sf_dir):
    """Moments and histograms of the imports added up; of the values only the quantiles' buckets are read."""
    return _stats_rows(_imported(spark, sf_dir, S.NUMERIC, []).historical(), list(_STATS))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, m_{c} AS mode FROM modes" for c in S.CATEGORICAL), "modes")
def categorical_modes_by_import(spark, sf_dir):
    return _imported(spark, sf_dir, [], S.CATEGORICAL).modes()


@query(_stats_sql(["min", "max", "mean", "std"]), "apps")
def feature_statistics(spark, sf_dir):
    return _stats_rows(A.feature_statistics(W.applications(spark, sf_dir), S.NUMERIC), ["min", "max", "mean", "std"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, m_{c} AS mode FROM modes" for c in S.CATEGORICAL), "modes")
def categorical_modes(spark, sf_dir):
    return A.categorical_modes(I.uppercase_categoricals(W.applications(spark, sf_dir)), S.CATEGORICAL)


@query("""SELECT application_id, round(COALESCE(loan_percent_income, CASE WHEN person_income > 0
            THEN loan_amnt / person_income END), 6) AS loan_percent_income FROM apps""", "apps")
def derive_loan_percent_income(spark, sf_dir):
    rows = I.derive_loan_percent_income(W.applications(spark, sf_dir))
    return rows.select("application_id", r6("loan_percent_income").alias("loan_percent_income"))


@query("SELECT application_id, " + ", ".join(
    f"round(COALESCE({c}, " + (
        f"m_{c}" if c in ("person_income", "loan_amnt") else str(S.TRAINING_STATISTICS[c]["mean"])
        if c in ("person_emp_length", "loan_int_rate") else str(S.NUMERIC_DEFAULTS[c])
    ) + f"), 6) AS {c}" for c in S.NUMERIC) + " FROM upper_apps, fills", "upper_apps fills")
def impute_numeric(spark, sf_dir):
    """All three sources of a fill value: historical median, training mean, fixed default."""
    fitted = W.fill_values(spark, sf_dir)
    fill = FillValues(
        medians={c: fitted.medians[c] for c in ("person_income", "loan_amnt")},
        means={c: S.TRAINING_STATISTICS[c]["mean"] for c in ("person_emp_length", "loan_int_rate")},
    )
    return _rounded(I.impute_numeric(W.applications(spark, sf_dir), fill))


@query("""SELECT application_id, COALESCE(home_ownership, m_home_ownership) AS home_ownership,
            COALESCE(loan_intent, m_loan_intent) AS loan_intent, COALESCE(loan_grade, 'C') AS loan_grade,
            COALESCE(default_on_file, 'N') AS default_on_file FROM upper_apps, modes""", "upper_apps modes")
def impute_categorical(spark, sf_dir):
    fitted = W.fill_values(spark, sf_dir)
    fill = FillValues(modes={c: fitted.modes[c] for c in ("home_ownership", "loan_intent")})
    rows = I.uppercase_categoricals(W.applications(spark, sf_dir))
    return I.impute_categorical(rows, fill).select("application_id", *S.CATEGORICAL)


@query("""SELECT application_id, array_to_string(imputation_log, ', ') AS imputation_log,
            CAST(len(imputation_log) AS INTEGER) AS imputed_fields FROM imputed""", "imputed")
def imputation_log(spark, sf_dir):
    return W.imputed(spark, sf_dir).select(
        "application_id", F.array_join("imputation_log", ", ").alias("imputation_log"),
        F.size("imputation_log").alias("imputed_fields"),
    )


@query(f"SELECT application_id, {_ROUNDED}, {_CATEGORIES} FROM imputed", "imputed")
def impute_application(spark, sf_dir):
    return _rounded(W.imputed(spark, sf_dir), *S.CATEGORICAL)


_TRAIN = S.NUMERIC


@query("SELECT application_id, " + ", ".join(f"round(COALESCE({c}, m_{c}), 6) AS {c}" for c in _TRAIN) + " FROM upper_apps, fills",
       "upper_apps fills")
def impute_train_median(spark, sf_dir):
    rows = W.applications(spark, sf_dir).select("application_id", *_TRAIN)
    return _rounded(I.impute_train_median(rows, _TRAIN, I.train_medians(rows, _TRAIN)))


@query("SELECT application_id, " + ", ".join(f"upper(COALESCE({c}, 'UNKNOWN')) AS {c}" for c in S.CATEGORICAL) + " FROM apps", "apps")
def impute_train_unknown(spark, sf_dir):
    rows = W.applications(spark, sf_dir).select("application_id", *S.CATEGORICAL)
    return I.impute_train_unknown(rows, S.CATEGORICAL)


@query("""SELECT application_id, CAST(0 AS DOUBLE) AS empty_column, COALESCE(person_income, 0) AS person_income FROM apps""", "apps")
def fill_residual_zero(spark, sf_dir):
    rows = W.applications(spark, sf_dir).select(
        "application_id", F.lit(None).cast("double").alias("empty_column"), "person_income"
    )
    return I.fill_residual_zero(rows, ["empty_column", "person_income"])


@query("""SELECT application_id, CASE WHEN application_id % 3 <> 0 THEN person_age END AS person_age FROM apps""", "apps")
def to_numeric_coerce(spark, sf_dir):
    rows = W.applications(spark, sf_dir).select(
        "application_id",
        F.when(F.col("application_id") % 3 == 0, "unknown").otherwise(F.col("person_age").cast("string")).alias("person_age"),
    )
    return I.to_numeric(rows, ["person_age"])


_DRIFT_ROWS = " UNION ALL ".join(
    f"""SELECT application_id, '{f}' AS feature, round({f}, 6) AS value,
      CASE WHEN {f} < {s['min']} OR {f} > {s['max']} THEN 'range' ELSE 'sigma' END AS kind FROM imputed
      WHERE {f} < {s['min']} OR {f} > {s['max']} OR {f} < {s['mean'] - 3 * s['std']!r} OR {f} > {s['mean'] + 3 * s['std']!r}"""
    for f, s in S.TRAINING_STATISTICS.items()
)


@query(_DRIFT_ROWS, "imputed")
def drift_check(spark, sf_dir):
    """One row per value that leaves the training range or three deviations."""
    rows = D.drift_check(W.imputed(spark, sf_dir))
    found = rows.select("application_id", F.explode("drift").alias("d"))
    return found.select("application_id", "d.feature", r6("d.value").alias("value"), "d.kind")


@query(f"""WITH drifted AS ({_DRIFT_ROWS}),
    filled AS (SELECT unnest(imputation_log) AS note FROM imputed)
    SELECT 'imputed' AS section, note AS item, count(*) AS n FROM filled GROUP BY note
    UNION ALL SELECT 'drift', feature || ': ' || kind, count(*) FROM drifted GROUP BY feature, kind""", "imputed")
def imputation_and_drift(spark, sf_dir):
    """How often each field was filled, and how, and how often each feature drifts."""
    rows = D.drift_check(W.imputed(spark, sf_dir))
    found = F.concat(
        F.transform("imputation_log", lambda n: F.struct(F.lit("imputed").alias("section"), n.alias("item"))),
        F.transform("drift", lambda d: F.struct(
            F.lit("drift").alias("section"), F.concat(d["feature"], F.lit(": "), d["kind"]).alias("item")
        )),
    )
    return rows.select(F.inline(found)).groupBy("section", "item").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT application_id, '{c}' AS feature, round({c}, 6) AS value, round(lo, 4) AS "min", round(hi, 4) AS "max"
      FROM imputed, (SELECT min({c}) AS lo, max({c}) AS hi FROM apps)""" for c in S.NUMERIC) + ")", "imputed apps")
def join_stats(spark, sf_dir):
    """Every value beside its feature's statistics."""
    values = A.tall(W.imputed(spark, sf_dir), S.NUMERIC, ["application_id"])
    stats = A.feature_statistics(W.applications(spark, sf_dir), S.NUMERIC)
    return D.join_stats(values, stats).select(
        "application_id", "feature", r6("value").alias("value"), F.round("min", 4).alias("min"), F.round("max", 4).alias("max")
    )


_PROFILED = ["application_id", *S.CANONICAL, "loan_status", "created_at"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{"text" if c in [*S.CATEGORICAL, "created_at"] else "numeric"}' AS data_type, count(*) AS row_count,
      count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM apps""" for c in _PROFILED), "apps")
def column_profile(spark, sf_dir):
    return A.column_profile(W.applications(spark, sf_dir), _PROFILED)
