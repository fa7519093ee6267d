"""Schemas and fixed values shared by every operator."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names, vocabularies, tables and thresholds that results depend on.
# ---------------------------------------------------------------------------

NUMERIC = [
    "person_age",
    "person_income",
    "person_emp_length",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
]

VOCABULARY = {
    "home_ownership": ["RENT", "OWN", "MORTGAGE", "OTHER"],
    "loan_intent": [
        "PERSONAL", "EDUCATION", "MEDICAL", "VENTURE", "HOMEIMPROVEMENT", "DEBTCONSOLIDATION",
    ],
    "loan_grade": ["A", "B", "C", "D", "E", "F", "G"],
    "default_on_file": ["Y", "N"],
}

# canonical categorical -> prefix of its encoded columns
ENCODED_PREFIX = {
    "home_ownership": "person_home_ownership",
    "loan_intent": "loan_intent",
    "loan_grade": "loan_grade",
    "default_on_file": "cb_person_default_on_file",
}

TARGETS = ["loan_status", "loan_status_num", "default", "target", "label", "outcome"]

# order in which the flexible trainer looks for its target
TARGET_CANDIDATES = ["loan_status", "default", "target", "label", "outcome"]

TARGET_LABELS = {
    "default": 1, "no_default": 0,
    "yes": 1, "no": 0,
    "y": 1, "n": 0,
    "1": 1, "0": 0,
    "true": 1, "false": 0,
    "approved": 0, "rejected": 1,
    "good": 0, "bad": 1,
}

TRUTHY_OUTCOMES = ["y", "yes", "1", "true"]

NUMERIC_DEFAULTS = {
    "person_age": 35.0,
    "person_income": 50000.0,
    "person_emp_length": 24.0,
    "loan_amnt": 10000.0,
    "loan_int_rate": 10.0,
    "loan_percent_income": 0.25,
    "cb_person_cred_hist_length": 5.0,
}

CATEGORICAL_DEFAULTS = {
    "home_ownership": "RENT",
    "loan_intent": "PERSONAL",
    "loan_grade": "C",
    "default_on_file": "N",
}

# header -> canonical column, used by the importer
ALIASES = {
    "age": "person_age",
    "income": "person_income",
    "annual_income": "person_income",
    "emp_length": "person_emp_length",
    "person_home_ownership": "home_ownership",
    "home": "home_ownership",
    "loan_amount": "loan_amnt",
    "amount": "loan_amnt",
    "interest_rate": "loan_int_rate",
    "rate": "loan_int_rate",
    "percent_income": "loan_percent_income",
    "intent": "loan_intent",
    "purpose": "loan_intent",
    "grade": "loan_grade",
    "cred_hist_length": "cb_person_cred_hist_length",
    "default_history": "default_on_file",
    "cb_person_default_on_file": "default_on_file",
}

# header pattern -> canonical column, tried in this order by the tiered header match
FORM_ALIASES = [
    ("age", "person_age"),
    ("income", "person_income"),
    ("annual_income", "person_income"),
    ("employment_length", "person_emp_length"),
    ("emp_length", "person_emp_length"),
    ("loan_amount", "loan_amnt"),
    ("loan", "loan_amnt"),
    ("amount", "loan_amnt"),
    ("interest_rate", "loan_int_rate"),
    ("rate", "loan_int_rate"),
    ("int_rate", "loan_int_rate"),
    ("credit_history", "cb_person_cred_hist_length"),
    ("credit_hist_length", "cb_person_cred_hist_length"),
    ("credit", "cb_person_cred_hist_length"),
    ("home", "home_ownership"),
    ("ownership", "home_ownership"),
    ("intent", "loan_intent"),
    ("purpose", "loan_intent"),
    ("grade", "loan_grade"),
    ("default", "default_on_file"),
    ("defa", "default_on_file"),
    ("default_on_file", "default_on_file"),
    ("percent_income", "loan_percent_income"),
    ("loan_percent", "loan_percent_income"),
]

METADATA_COLUMNS = ["id", "created_at", "updated_at", "application_status", "notes"]

# raw dataset column -> canonical column
RAW_NAMES = {
    "person_home_ownership": "home_ownership",
    "cb_person_default_on_file": "default_on_file",
}

# statistics of the published training set, used by the drift check
TRAINING_STATISTICS = {
    "person_age": {"min": 20.0, "max": 144.0, "mean": 27.76469459791283, "std": 6.392377289741509},
    "person_income": {"min": 4000.0, "max": 6000000.0, "mean": 66171.84384591774, "std": 63598.11240332875},
    "person_emp_length": {"min": 0.0, "max": 123.0, "mean": 4.787233203140411, "std": 4.109162342881874},
    "loan_amnt": {"min": 500.0, "max": 35000.0, "mean": 9601.073319521178, "std": 6315.6322362242845},
    "loan_int_rate": {"min": 5.42, "max": 22.48, "mean": 11.010116175535298, "std": 3.228833012680076},
    "loan_percent_income": {"min": 0.0, "max": 0.78, "mean": 0.17044582565991406, "std": 0.10698918558085699},
    "cb_person_cred_hist_length": {"min": 2.0, "max": 30.0, "mean": 5.816720380601596, "std": 4.0542641443773615},
}

HIGH_RISK = "High Risk 🔴"
BORDERLINE_RISK = "Borderline Risk 🟠"
LOW_RISK = "Low Risk 🟢"
HIGH_THRESHOLD = 0.6
BORDERLINE_THRESHOLD = 0.4

# texts of imputation notes
NOTE_DERIVED = "loan_percent_income: derived from loan_amnt/person_income"
NOTE_MEDIAN = "historical median"
NOTE_MEAN = "training mean"
NOTE_MODE = "historical mode"
NOTE_DEFAULT = "safe default"

# texts of validation warnings; the second of a pair follows the value
WARN_EMPTY = "No input data provided - all values will be imputed"
WARN_MISSING = "Critical fields missing (will be imputed): "
WARN_AGE = ("person_age (", ") outside valid range [18, 100]")
WARN_RATIO = ("loan_percent_income (", ") > 1 (should be 0-1)")
WARN_NEGATIVE = " is negative: "

# texts of drift findings
DRIFT_VALUE = ": value "
DRIFT_OUTSIDE = {"range": " outside training min/max [", "sigma": " outside 3-sigma range ["}

# labels of decisions and outcomes, and the marks of imported rows
REJECTED, APPROVED = "Rejected", "Approved"
DEFAULTED, NOT_DEFAULTED = "Default", "No Default"
HISTORY_LEVEL, HISTORY_TYPE, HISTORY_SCORE = "Historical", "historical_import", 0.0
MINIMAL_LEVEL, MINIMAL_TYPE, MINIMAL_SCORE = "Unknown", "imported_data", 0.5

# headings of the operational notes
NOTES_IMPUTED = ("Imputed ", " fields: ")
NOTES_WARNINGS = "Validation warnings: "
NOTES_DRIFT = "Data drift detected: "
NOTES_BAR = " | "

# end of fixed values -------------------------------------------------------

CATEGORICAL = list(VOCABULARY)
CANONICAL = NUMERIC + CATEGORICAL


def encoded_name(column: str, value: str) -> str:
    return f"{ENCODED_PREFIX[column]}_{value}"


def model_features(drop_first: bool = True) -> list[str]:
    """Model feature order: numerics, then per categorical its sorted values (first one dropped)."""
    names = list(NUMERIC)
    for column, values in VOCABULARY.items():
        names += [encoded_name(column, v) for v in sorted(values)[1 if drop_first else 0:]]
    return names


APPLICATION_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in NUMERIC]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL]
)

PREDICTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("application_id", T.LongType()),
    T.StructField("input_features", T.MapType(T.StringType(), T.StringType())),
    T.StructField("risk_level", T.StringType()),
    T.StructField("probability_default", T.DoubleType()),
    T.StructField("binary_prediction", T.IntegerType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("shap_values", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("explanation", T.StringType()),
    T.StructField("key_factors", T.MapType(T.StringType(), T.StringType())),
    T.StructField("remediation_suggestion", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("prediction_time_ms", T.DoubleType()),
    T.StructField("actual_outcome", T.IntegerType()),
    T.StructField("feedback_date", T.TimestampNTZType()),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("model_type", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("auc_roc", T.DoubleType()),
    T.StructField("total_predictions", T.LongType()),
    T.StructField("correct_predictions", T.LongType()),
    T.StructField("false_positives", T.LongType()),
    T.StructField("false_negatives", T.LongType()),
    T.StructField("evaluation_date", T.TimestampNTZType()),
    T.StructField("notes", T.StringType()),
])

REQUEST_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("tokens", T.LongType()),
    T.StructField("session_count", T.LongType()),
])
