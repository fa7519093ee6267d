import pytest

from loanlens import schema as S
from loanlens.operators.drift import drift_check, join_stats
from loanlens.operators.impute import impute, uppercase_categoricals
from loanlens.operators.stats import FillValues, feature_statistics, fit_fill_values, tall

COMPLETE = dict(
    person_age=30, person_income=50000, person_emp_length=24, loan_amnt=10000, loan_int_rate=10.0,
    loan_percent_income=0.20, cb_person_cred_hist_length=5, home_ownership="RENT", loan_intent="PERSONAL",
    loan_grade="B", default_on_file="N",
)
TRAINING = FillValues(means={c: s["mean"] for c, s in S.TRAINING_STATISTICS.items()})


def drifting(df):
    return {d.feature: d.kind for d in drift_check(df).first().drift}


def test_complete_record_needs_nothing(applications):
    row = impute(applications(COMPLETE), TRAINING).first()
    assert row.imputation_log == []
    assert row.person_emp_length == 24


def test_minimal_record(applications):
    row = impute(applications(dict(person_income=60000, loan_amnt=15000)), TRAINING).first()
    assert row.loan_percent_income == 0.25
    assert len(row.imputation_log) == 9
    assert row.imputation_log[0] == "loan_percent_income: derived from loan_amnt/person_income"
    assert row.imputation_log[1] == "person_age: training mean"
    assert row.imputation_log[-1] == "default_on_file: safe default"
    assert row.loan_grade == "C"


def test_fallback_order(applications):
    fill = FillValues(medians={"person_age": 33.0}, means={"person_age": 27.0, "loan_int_rate": 11.0}, modes={"loan_grade": "A"})
    row = impute(applications({"person_income": 1}), fill).first()
    assert (row.person_age, row.loan_int_rate, row.loan_percent_income) == (33.0, 11.0, 0.25)
    assert row.loan_grade == "A" and row.home_ownership == "RENT"
    assert "person_age: historical median" in row.imputation_log
    assert "loan_int_rate: training mean" in row.imputation_log
    assert "loan_percent_income: safe default" in row.imputation_log


@pytest.mark.parametrize("income, expected", [(0, 0.25), (80000, 0.25), (-5, 0.25), (40000, 0.5)])
def test_ratio_only_from_positive_income(applications, income, expected):
    row = impute(applications(dict(person_income=income, loan_amnt=20000)), FillValues()).first()
    assert row.loan_percent_income == expected


def test_progressive_fill(applications):
    first = dict(person_income=60000, loan_amnt=15000)
    second = {**first, "person_age": 40, "loan_grade": "B", "home_ownership": "OWN"}
    counts = [len(r.imputation_log) for r in impute(applications(first, second, COMPLETE), TRAINING).collect()]
    assert counts == sorted(counts, reverse=True) and counts[-1] == 0


def test_targets_never_reach_the_features(spark):
    rows = spark.createDataFrame([(1.0, 1, "x")], "person_income double, loan_status int, outcome string")
    assert not set(impute(rows, TRAINING).columns) & set(S.TARGETS)


def test_uppercase_and_modes_use_canonical_names(applications):
    rows = uppercase_categoricals(applications({"home_ownership": "own"}, {"home_ownership": "Own"}, {"home_ownership": "rent"}))
    assert fit_fill_values(rows).modes == {"home_ownership": "OWN"}


def test_drift_of_literal_cases(applications):
    assert drifting(applications(COMPLETE)) == {"person_emp_length": "sigma"}
    high = dict(COMPLETE, person_emp_length=2, person_age=22, loan_amnt=30000, loan_int_rate=18.5,
                loan_percent_income=1.2, cb_person_cred_hist_length=1)
    assert drifting(applications(high)) == {
        "loan_percent_income": "range", "cb_person_cred_hist_length": "range", "loan_amnt": "sigma",
    }
    low = dict(COMPLETE, person_age=40, person_income=120000, loan_amnt=15000, loan_int_rate=6.5, person_emp_length=120,
               cb_person_cred_hist_length=15, loan_percent_income=0.125)
    assert drifting(applications(low)) == {"person_emp_length": "sigma"}
    edge = dict(COMPLETE, person_emp_length=2, person_age=18, person_income=15000, loan_amnt=50000, loan_int_rate=25.0,
                loan_percent_income=50000 / 15000, cb_person_cred_hist_length=0.5)
    assert set(drifting(applications(edge))) == {
        "person_age", "loan_amnt", "loan_int_rate", "loan_percent_income", "cb_person_cred_hist_length",
    }


def test_join_stats_keeps_every_value(applications):
    rows = applications(COMPLETE, dict(COMPLETE, person_age=50))
    joined = join_stats(tall(rows, S.NUMERIC), feature_statistics(rows, S.NUMERIC))
    assert joined.count() == 14
    assert joined.where("value < min or value > max").count() == 0
