"""Inputs that must not lose rows or values, nor end a job."""

import pytest
from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.functions.risk import outcome_from_columns
from loanlens.operators import encode as E
from loanlens.operators import evaluate as V
from loanlens.operators import joins as J
from loanlens.operators import mapping as M
from loanlens.operators import ordered as O
from loanlens.operators import reports as R
from loanlens.operators import split as P
from loanlens.plans import imports, train
from loanlens.session import scratch_path
from loanlens.sources import files, tables


def test_request_log_keeps_every_json_line(spark):
    path = scratch_path(spark, "log")
    lines = ['{"provider":"a","tokens":1,"success":true}', '{"provider":"b","tokens":12.5,"success":"perhaps"}', '{"provider":"c","tokens":"7"}', '{"provider":"d","to', "[1]", ""]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    log = files.read_request_log(spark, path)
    assert log.count() == log.select("tokens").na.fill(0).count() == len(log.collect()) == len(log.select("provider").collect()) == 3
    assert sorted((r.provider, r.tokens, r.success) for r in log.collect()) == [("a", 1, True), ("b", None, None), ("c", 7, None)]


def test_csv_files_with_other_column_orders_keep_their_columns(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(1.0, 2.0)], "income double, amount double").coalesce(1).write.option("header", True).csv(path)
    spark.createDataFrame([(2.0, 200.0)], "amount double, income double").coalesce(1).write.mode("append").option("header", True).csv(path)
    for read, kind in ((files.read_applications_csv, float), (files.read_text_csv, str)):
        assert {(kind(r.income), kind(r.amount)) for r in read(spark, path).collect()} == {(kind(1.0), kind(2.0)), (kind(200.0), kind(2.0))}


def test_stored_keys_outside_the_application_are_features(spark):
    rows = [(1, '{"person_age":30,"credit_score":"700","branch":"x"}', 1), (2, '{"person_age":40,"credit_score":650}', 0), (3, '{"loan_status":1}', 0)]
    stored = spark.createDataFrame(rows, "id long, input_features string, actual_outcome int")
    original = spark.createDataFrame([("o1", "1", 20.0), ("o2", "good", 30.0)], "row_key string, loan_status string, person_age double")
    got = train.extract_training_data(stored, original)
    assert dict(got.dtypes)["credit_score"] == "double" and dict(got.dtypes)["branch"] == "string"
    assert {r.row_key: (r.credit_score, r.branch, r.loan_status) for r in got.collect()} == {
        "p1": (700.0, "x", 1), "p2": (650.0, None, 0), "p3": (None, None, 0), "o1": (None, None, 1),
    }


def test_keys_and_kinds_of_stored_features_come_from_one_pass(spark):
    wide = ",".join(f'"k{i}":{i}' for i in range(1000))
    texts = [
        '{"nested":{"a":[1,2]},"mixed":1,"quoted":"2.5","none":null,"flag":true,"a.b`c":3}', '{"nested":5,"mixed":"x","quoted":4,"":"e"}',
        f"{{{wide}}}", "[1]", "no json", "", None, '{"person_age":"old"}',
    ]
    stored = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, input_features string, actual_outcome int")
    kinds = {r.feature: r.kind for r in M.feature_kinds(stored).collect()}
    assert {k: kinds[k] for k in ("nested", "mixed", "quoted", "none", "flag", "a.b`c", "")} == {
        "nested": "string", "mixed": "string", "quoted": "double", "none": "double", "flag": "string", "a.b`c": "double", "": "string",
    }
    assert all(kinds[f"k{i}"] == "double" for i in range(1000)) and kinds["person_age"] == "string"
    schema = train.stored_feature_schema(stored)
    assert len(schema) == 11 + 7 + 1000 and schema["k7"].dataType.typeName() == "double"
    rows = {r.row_key: r for r in train.extract_training_data(stored, schema=schema).collect()}
    assert len(rows) == 7  # one for each row that holds a text
    assert rows["p0"]["nested"] == '{"a":[1,2]}' and rows["p0"]["quoted"] == 2.5 and rows["p0"]["a.b`c"] == 3.0
    assert (rows["p1"]["nested"], rows["p1"]["mixed"], rows["p1"]["quoted"], rows["p1"][""]) == ("5", "x", 4.0, "e")
    assert rows["p2"]["k999"] == 999.0 and rows["p7"]["person_age"] is None


def test_null_groups_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 3, 7)], "g string, t int, n int")
    got = {r.t: (r.upto, r.n) for r in O.running_totals(rows, ["g"], ["t"], {"upto": "n"}, 3).collect()}
    assert got == {1: (5, 5), 2: (11, 6), 3: (7, 7)}
    assert {r.t: r.i for r in O.with_group_index(rows, ["g"], ["t"], "i", 3).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_hot_group_is_numbered_across_blocks(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    got = O.with_group_index(rows, ["g"], ["id"], "i", 8)
    assert sorted(r.i for r in got.where("g = 'hot'").collect()) == list(range(1, 4501))
    assert got.where("g <> 'hot' AND i <> 1").isEmpty()


def test_a_text_in_a_number_column_widens_it(spark):
    table = spark.createDataFrame([(1, 2.0)], "id long, income double")
    got = M.evolve_schema(table, spark.createDataFrame([(2, "abc"), (3, "4")], "id long, income string"))
    assert sorted((r.id, r.income) for r in got.collect()) == [(1, "2.0"), (2, "abc"), (3, "4")]
    same = M.evolve_schema(table, spark.createDataFrame([(3, "4")], "id long, income string"))
    assert dict(same.dtypes)["income"] == "double"


def test_an_import_notes_what_does_not_fit(spark):
    apps, preds = (tables.Table(spark, scratch_path(spark, n)) for n in ("apps", "preds"))
    imports.import_into(spark.createDataFrame([(1, 5.0)], "row long, income double"), apps, preds, ["row"])
    imports.import_into(spark.createDataFrame([(2, "abc"), (3, "6")], "row long, income string"), apps, preds, ["row"])
    assert sorted((r.row, r.person_income, r.notes) for r in apps.read().collect()) == [(1.0, 5.0, None), (2.0, None, "person_income=abc"), (3.0, 6.0, None)]


def test_appends_take_the_stored_types(spark):
    table = tables.Table(spark, scratch_path(spark, "t"))
    table.append(spark.createDataFrame([(1, 2.0)], "id long, x double"))
    table.append(spark.createDataFrame([(2, 3)], "id int, x int"))
    assert sorted((r.id, r.x) for r in table.read().collect()) == [(1, 2.0), (2, 3.0)]
    with pytest.raises(ValueError, match="do not fit"):
        table.append(spark.createDataFrame([(3, "abc")], "id long, x string"))


def test_missing_targets_are_no_label(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, None), (4, float("nan")), (5, 2.0)], "id int, t double")
    got = {r.id: (r.label, r.label_unmapped) for r in E.map_target(rows, "t").collect()}
    assert got == {1: (1, False), 2: (0, False), 5: (0, True)}
    assert {r.id for r in E.map_target(rows, "t", on_unmapped="drop").collect()} == {1, 2}
    words = spark.createDataFrame([(1, "Yes"), (2, None), (3, "??")], "id int, t string")
    assert {r.id: r.label for r in E.map_target(words, "t").collect()} == {1: 1, 3: 0}


def test_odd_outcomes(spark):
    rows = spark.createDataFrame([("NaN",), ("99999999999",), ("1.0",), ("yes",), ("no",), (None,)], "v string")
    assert [r.o for r in rows.select(outcome_from_columns(F.col("v")).alias("o")).collect()] == [None, None, 1, 1, 0, None]


def test_null_labels_are_not_split(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "id long, y int")
    got = P.split_stratified(rows, "id", "y").collect()
    assert len(got) == 50 and not any(r.is_test for r in got if r.y is None) and sum(r.is_test for r in got) == 8


def test_rows_without_score_or_label_count_nowhere(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (0, 0.1, 0), (1, None, 1), (0, float("nan"), None), (None, 0.5, 1)], "label int, probability double, prediction int")
    assert V.auc_roc(rows).first().auc_roc == 1.0
    assert {r.threshold for r in V.roc_curve(rows.where("label is not null")).collect()} == {0.9, 0.1}
    assert V.binary_metrics(rows).first().total_predictions == 3


def test_updates_can_set_null(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, note string")
    updates = spark.createDataFrame([(1, None, 5), (1, "old", 4)], "id long, note string, updated_at int")
    assert {r.id: r.note for r in J.apply_updates(table, updates, null_sets=True).collect()} == {1: None, 2: "b"}
    assert {r.id: r.note for r in J.apply_updates(table, updates).collect()} == {1: "a", 2: "b"}


def test_newest_rows_are_ranked_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, None, "c"), (2, 1, "d")], "k int, t int, v string")
    newest = R.latest_per_key(rows, ["k"], ["t"])
    assert {r.k: r.v for r in newest.collect()} == {1: "b", 2: "d"}
    assert "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()


def test_applications_are_hash_aggregated(spark, small):
    from loanlens.catalog import views

    assert "SortAggregate" not in views.applications(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert set(S.CANONICAL) <= set(views.applications(spark, small).columns)


@pytest.mark.parametrize("name", ["join_application_prediction", "split_random", "class_balance", "count_by_status", "application_statistics"])
def test_only_needed_tables_are_read(spark, small, name):
    from loanlens.catalog import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan and "c_custkey" not in plan


def test_drift_texts(spark):
    from loanlens.operators.drift import drift_notes

    kind = "array<struct<feature:string,value:double,kind:string,lower:double,upper:double>>"
    rows = spark.createDataFrame([([("age", 200.0, "range", 20.125, 144.0), ("rate", 30.0, "sigma", 16.5, 25.004)],)], f"d {kind}")
    first, second = rows.select(drift_notes(F.col("d")).alias("n")).first().n
    assert first.endswith("[20.125, 144.0]") and second.endswith("[16.50, 25.00]")


def test_previous_values_cross_blocks_of_a_hot_group(spark):
    rows = [("hot", i, i * i % 11 if i % 13 else None) for i in range(200)] + [(None, 1, 5), (None, 2, None), ("one", 1, 7)]
    table = spark.createDataFrame(rows, "g string, t int, v int")
    got = {(r.g, r.t): r.p for r in O.with_previous(table, ["g"], ["t"], "v", "p", blocks=9).collect()}
    want = {(g, t): next((w for h, u, w in rows if h == g and u == t - 1), None) for g, t, _ in rows}
    assert got == want
