import pytest
from pyspark.sql import functions as F

from loanlens.operators import joins as J
from loanlens.operators import reports as R
from loanlens.plans import imports as P
from loanlens.session import scratch_path
from loanlens.sources import files, tables


def history(spark):
    return spark.createDataFrame(
        [(1, 30.0, 1000.0, "1"), (2, None, 2000.0, "no"), (3, 50.0, None, None)], "row long, Age double, income double, default string"
    )


def test_import_twice_appends_with_new_ids(spark):
    apps, preds = (tables.Table(spark, scratch_path(spark, n)) for n in ("apps", "preds"))
    assert P.import_into(history(spark), apps, preds, ["row"]) == 3
    wider = history(spark).withColumn("zip", F.lit("x"))
    assert P.import_into(wider, apps, preds, ["row"]) == 3
    stored = apps.read()
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3, 4, 5, 6]
    assert stored.where("zip is null").count() == 3
    outcomes = {r.application_id: r.actual_outcome for r in preds.read().collect()}
    assert outcomes == {1: 1, 2: 0, 3: None, 4: 1, 5: 0, 6: None}
    assert {r.application_status for r in stored.collect()} == {"approved"}


def test_outcome_column_order(spark):
    rows = spark.createDataFrame(
        [("0", "1", None), (None, "yes", None), (None, None, "1.0"), (None, None, "bad")], "default string, target string, label string"
    )
    assert [r.actual_outcome for r in P.coerce_outcome(rows).collect()] == [0, 1, 1, 0]


def test_clear_needs_confirmation_and_keeps_columns(spark):
    store = tables.Table(spark, scratch_path(spark, "t"))
    store.append(spark.range(5))
    with pytest.raises(ValueError):
        tables.clear_tables({"t": store})
    assert tables.clear_tables({"t": store}, confirm=True) == {"t": 5, "total_deleted": 5}
    assert store.read().columns == ["id"] and store.read().count() == 0
    store.append(spark.range(2))
    assert store.read().count() == 2


def test_replacing_a_table_from_itself(spark):
    store = tables.Table(spark, scratch_path(spark, "t"))
    store.append(spark.range(5).withColumn("v", F.lit(1)))
    store.replace(store.read().withColumn("v", F.col("v") + F.col("id")))
    assert sorted(r.v for r in store.read().collect()) == [1, 2, 3, 4, 5]


def test_feedback_for_unknown_ids_changes_nothing(spark):
    preds = spark.createDataFrame([(1, None, None), (2, 0, None)], "id long, actual_outcome int, feedback_date string")
    feedback = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (9, 1, "c")], "id long, actual_outcome int, feedback_date string")
    got = {r.id: (r.actual_outcome, r.feedback_date) for r in J.record_feedback(preds, feedback).collect()}
    assert got == {1: (1, "b"), 2: (0, None)}


def test_missing_required_column_fails_before_reading(spark):
    path = files.export_csv(spark.range(3), scratch_path(spark, "csv"))
    with pytest.raises(ValueError, match="person_income"):
        files.read_applications_csv(spark, path, required=["person_income"])


def test_import_file_keeps_nulls(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 100 != 0, 30.0).alias("person_age"), F.when(F.col("id") % 100 != 1, 5.0).alias("person_income")
    )
    path = files.export_csv(rows, scratch_path(spark, "csv"))
    back = files.read_applications_csv(spark, path)
    assert back.agg(F.count("person_age"), F.count("person_income")).first() == (4950, 4950)


def test_row_cap_and_paging(spark):
    rows = spark.range(1000).withColumn("application_status", F.lit("pending"))
    assert R.first_rows(rows, ["id"], 500).count() == 500
    page = R.applications_by_status(rows, "pending", 10, 5).collect()
    assert [r.id for r in page] == [10, 11, 12, 13, 14]
    zero = spark.createDataFrame([(1, 0, "x"), (2, 5, "y")], "id long, application_id long, created_at string")
    assert R.prediction_history(zero, application_id=0).count() == 1


def test_recent_turns_limits_before_the_shuffle(spark):
    turns = spark.range(100).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    out = R.recent_turns(turns, 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("conv_id = 1").first().turns == 3


def test_sliding_windows_count_each_request_once_per_window(spark):
    from loanlens.streaming.jobs import request_counts

    log = spark.range(60).select(
        F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("p").alias("provider")
    )
    tumbling = request_counts(log, "1 hour").agg(F.sum("n")).first()[0]
    sliding = request_counts(log, "1 hour", "30 minutes").agg(F.sum("n")).first()[0]
    assert (tumbling, sliding) == (60, 120)
