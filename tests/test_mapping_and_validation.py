import pytest
from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.functions.names import normalize_name
from loanlens.functions.text import clean_response
from loanlens.operators import mapping as M
from loanlens.operators import validate as V


def test_header_sanitising(spark):
    rows = spark.createDataFrame([(1, 50000, 10000)], ["credit.policy", "income", "loan_amount"])
    named = M.rename_aliases(M.normalize_columns(rows))
    assert named.columns == ["credit_policy", "person_income", "loan_amnt"]
    assert normalize_name("Loan Amnt-X") == "loan_amnt_x"


def test_mapping_keys_are_normalised_too(spark):
    rows = M.normalize_columns(spark.createDataFrame([(1,)], ["My Age"]))
    assert M.rename_aliases(rows, {"My Age": "person_age"}).columns == ["person_age"]


def test_reserved_words_are_plain_columns(spark):
    table = spark.createDataFrame([(1, 2)], ["default", "order"])
    wider = M.evolve_schema(table, spark.createDataFrame([(3, "x")], ["order", "group"]))
    assert wider.columns == ["default", "order", "group"] and wider.count() == 2


def test_new_columns_keep_values_and_adding_twice_is_harmless(spark):
    table = spark.createDataFrame([(30,)], ["person_age"])
    incoming = spark.createDataFrame([(31, 123.45, "test_value")], ["person_age", "new_dynamic_col", "another_col"])
    once = M.evolve_schema(table, incoming)
    twice = M.evolve_schema(once, incoming)
    assert once.columns == twice.columns
    row = once.where("person_age = 31").first()
    assert (row.new_dynamic_col, row.another_col) == (123.45, "test_value")
    assert M.add_column(M.add_column(table, "test_col"), "test_col").columns == ["person_age", "test_col"]


def test_unsafe_names_are_refused(spark):
    with pytest.raises(ValueError):
        M.add_column(spark.range(1), 'x"; DROP')


def test_dynamic_table_layout(spark):
    made = M.create_dynamic_table(spark.createDataFrame([("a", 5.0)], ["notes", "person_income"]))
    assert made.columns == ["id", "created_at", "updated_at", "application_status", "notes", "person_income"]
    assert made.first().application_status == "pending"
    assert not set(made.columns) & {"person_age", "loan_amnt", "loan_grade"}


@pytest.mark.parametrize("header, column, tier", [
    ("person_age", "person_age", 1), ("Age", "person_age", 4), ("home", "home_ownership", 4),
    ("person_emp", "person_emp_length", 5), ("on-file", "default_on_file", 4), ("zzz", None, None), ("notes", None, None),
    ("hist_len", "cb_person_cred_hist_length", 4), ("cb", "cb_person_cred_hist_length", 5),
])
def test_tiered_header_match(spark, header, column, tier):
    row = M.automap_headers_tiered(spark.createDataFrame([(header,)], ["header"])).first()
    assert (row.mapped_column, row.match_tier) == (column, tier)


def test_plain_header_match_takes_the_first_column(spark):
    rows = spark.createDataFrame([("loan",), ("Income",), ("???",)], ["header"])
    found = {r.header: r.mapped_column for r in M.automap_headers(rows).collect()}
    assert found == {"loan": "loan_amnt", "Income": "person_income", "???": None}


def test_pack_and_unpack(applications):
    rows = applications({"person_age": 30, "loan_grade": "B"})
    packed = M.pack_features(rows, S.CANONICAL)
    assert {r.feature for r in M.feature_keys(packed).collect()} == {"person_age", "loan_grade"}
    back = M.unpack_features(packed.select("input_features"), S.APPLICATION_SCHEMA).first()
    assert (back.person_age, back.loan_grade, back.loan_amnt) == (30.0, "B", None)


def test_only_targets_is_an_error(spark):
    with pytest.raises(ValueError):
        M.drop_targets(spark.createDataFrame([(1,)], ["label"]))


def rules_broken(df, rules):
    return V.validate(df, rules).first().errors


def test_rule_sets(applications):
    from test_impute_and_drift import COMPLETE

    assert rules_broken(applications(COMPLETE), V.STRICT_RULES) == []
    assert rules_broken(applications(COMPLETE), V.FORM_RULES) == []
    assert rules_broken(applications(dict(COMPLETE, person_age=17)), V.RANGE_RULES) == ["person_age: below 18"]
    assert rules_broken(applications(dict(COMPLETE, person_age=110)), V.FORM_RULES) == []
    assert rules_broken(applications(dict(COMPLETE, loan_grade="H")), V.FORM_RULES) == ["loan_grade: not in domain"]
    assert rules_broken(applications(dict(COMPLETE, loan_amnt=500)), V.LEGACY_FORM_RULES) == ["loan_amnt: below 1000"]
    assert rules_broken(applications({"person_income": 1}), V.RANGE_RULES) == []
    assert len(rules_broken(applications({"person_income": 1}), V.STRICT_RULES)) == 10


def test_validation_warnings(applications):
    rows = applications({}, {"person_income": 5}, {"person_income": 5, "loan_amnt": -1, "person_age": 10})
    empty, partial, broken = V.validation_warnings(rows).collect()
    assert (empty.is_valid, partial.is_valid, broken.is_valid) == (False, True, False)
    assert partial.validation_warnings == ["Critical fields missing (will be imputed): loan_amnt"]
    assert broken.validation_warnings == ["person_age (10.0) outside valid range [18, 100]", "loan_amnt is negative: -1.0"]


def test_one_bad_row_does_not_stop_the_others(applications):
    rows = V.quarantine(applications({"person_age": 30}, {"person_age": 130}), V.RANGE_RULES).collect()
    assert [r.status for r in rows] == ["success", "error"]
    assert rows[1].error == "person_age: above 100"


def test_cells(spark):
    rows = spark.createDataFrame(
        [("12.5abc", " rent ", "0", "", "7"), ("abc", "castle", "Yes", "x", None), ("", None, "maybe", None, "-1e2")],
        "loan_amnt string, home_ownership string, default_on_file string, memo string, person_age string",
    )
    got = [tuple(r) for r in V.coerce_cells(rows).collect()]
    assert got == [(12.5, "RENT", "N", None, 7.0), (0.0, None, "Y", "x", None), (None, None, None, None, -100.0)]


def test_blank_rows(spark):
    rows = spark.createDataFrame([("", None), ("a", ""), (None, None)], "x string, y string")
    assert V.drop_blank_rows(rows).count() == 1


def test_clean_response(spark):
    row = spark.range(1).select(clean_response(F.lit("  <s>Hello</s>\n\n\n\n\nyou ")).alias("t")).first()
    assert row.t == "Hello\n\nyou"
