import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loanlens.operators import encode as E
from loanlens.operators import evaluate as V
from loanlens.operators import split as P
from loanlens.operators import stats as A
from loanlens.operators.ordered import running_totals, with_group_index, with_row_index


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows share one key."""
    random.seed(7)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", random.randint(0, 20), i % 4) for i in range(600)]
    random.shuffle(rows)
    return spark.createDataFrame(rows, "id long, k string, v int, w int").repartition(5)


def test_row_index_over_many_blocks(hot):
    got = {r.id: r.row_index for r in with_row_index(hot, ["v", "id"], blocks=7).collect()}
    order = sorted((r.v, r.id) for r in hot.collect())
    assert got == {i: n for n, (_, i) in enumerate(order)}


def test_group_index_splits_the_hot_key(hot):
    got = {r.id: r.n for r in with_group_index(hot, ["k"], ["v", "id"], "n", blocks=7).collect()}
    want, seen = {}, {}
    for k, v, i in sorted((r.k, r.v, r.id) for r in hot.collect()):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want


def test_group_index_keeps_null_groups(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, k string")
    assert {r.id: r.n for r in with_group_index(rows, ["k"], ["id"], "n", blocks=3).collect()} == {1: 1, 2: 2, 3: 1}


def test_running_totals_over_many_blocks(hot):
    got = {r.id: r.upto for r in running_totals(hot, ["k"], ["v", "id"], {"upto": "w"}, blocks=7).collect()}
    want, total = {}, {}
    for k, v, i, w in sorted((r.k, r.v, r.id, r.w) for r in hot.collect()):
        total[k] = total.get(k, 0) + w
        want[i] = total[k]
    assert got == want


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=40))
def test_quantiles_equal_linear_interpolation(spark, values):
    rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    known = [float(v) for v in values if v is not None]
    got = A.quantiles(rows, ["x"], {"a": 0.25, "b": 0.5, "c": 0.75}).collect()
    if not known:
        assert got == []
        return
    want = np.quantile(known, [0.25, 0.5, 0.75])
    assert [got[0].a, got[0].b, got[0].c] == pytest.approx(list(want), abs=1e-9)


def test_quantiles_wrong_expectation_fails(spark):
    rows = spark.range(10).select(F.col("id").cast("double").alias("x"))
    assert A.quantiles(rows, ["x"], {"m": 0.5}).first().m != 5.0


def test_approximate_quantiles_are_close(spark):
    rows = spark.range(10000).select(F.col("id").cast("double").alias("x"))
    assert abs(A.quantiles(rows, ["x"], {"m": 0.5}, accuracy=1000).first().m - 5000) < 50


def test_statistics_use_the_sample_deviation(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    row = A.historical_statistics(rows).first()
    assert row.std == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert (row.median, row.q25, row.q75) == (2.0, 1.5, 3.0)
    scaler = E.Scaler.fit(rows, ["x"])
    assert scaler.std["x"] == pytest.approx(np.std([1, 2, 4]))


def test_mode_tie_takes_the_smallest(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "k string")
    assert A.categorical_modes(rows).first().mode == "A"


def test_stratified_split_is_exact(spark):
    rows = spark.range(997).select(F.col("id"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    parts = P.split_stratified(rows, "id", "y").groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")
    ).collect()
    assert {r.y: r.t for r in parts} == {r.y: math.ceil(r.n * 0.2) for r in parts}


def test_split_does_not_depend_on_partitioning(spark):
    rows = spark.range(500)
    a = {r.id for r in P.split_random(rows.repartition(3), "id").where("is_test").collect()}
    b = {r.id for r in P.split_random(rows.coalesce(1), "id").where("is_test").collect()}
    assert a == b and 50 < len(a) < 150


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def test_auc_and_curve_against_all_pairs(spark):
    random.seed(3)
    pairs = [(random.randint(0, 1), random.randint(0, 12) / 12) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "label int, probability double")
    want = brute_auc(pairs)
    assert V.auc_roc(rows).first().auc_roc == pytest.approx(want, abs=1e-12)
    curve = V.roc_curve(rows)
    assert curve.agg(F.sum("area")).first()[0] == pytest.approx(want, abs=1e-12)
    last = curve.orderBy("threshold").first()
    assert (last.fpr, last.tpr) == (1.0, 1.0)


def test_metrics_of_an_empty_class_are_zero(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    row = V.binary_metrics(rows).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (1.0, 0.0, 0.0, 0.0)


def test_readiness(spark):
    rows = spark.range(50).select((F.col("id") % 2).cast("int").alias("actual_outcome"))
    assert V.retraining_readiness(rows, min_samples=10).first().is_ready
    row = V.retraining_readiness(rows, min_samples=100).first()
    assert not row.is_ready and row.samples_needed == 50 and row.feedback_needed == 0
    empty = V.retraining_readiness(None, spark=spark).first()
    assert (empty.is_ready, empty.total_predictions, empty.samples_needed, empty.feedback_needed) == (False, 0, 100, 10)


def test_detect_columns_of_literal_frames(spark):
    five = spark.range(100).select(
        F.when(F.col("id") % 5 < 3, "default").otherwise("no_default").alias("default"),
        *[(F.col("id") % 5 + 1.0).alias(c) for c in ("income", "loan_amount", "credit_score", "employment_years")],
        F.when(F.col("id") % 2 == 0, "RENT").otherwise("OWN").alias("home_ownership"),
    )
    found = E.detect_columns(five)
    assert found["target"] == "default"
    assert found["numeric"] == ["income", "loan_amount", "credit_score", "employment_years"]
    labels = E.map_target(five, "default").groupBy("label").count()
    assert {r.label: r["count"] for r in labels.collect()} == {1: 60, 0: 40}
    two = spark.range(50).select(
        (F.col("id") % 2).alias("loan_status"), F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.71).alias("loan_percent_income"),
        F.col("id").cast("double").alias("loan_amnt"),
    )
    found = E.detect_columns(two)
    assert found["categorical"] == ["loan_percent_income"] and found["numeric"] == ["loan_amnt"]


@pytest.mark.parametrize("name", ["loan_status", "target", "outcome"])
def test_target_names(spark, name):
    rows = spark.createDataFrame([("bad", 1.0), ("good", 2.0)], f"{name} string, x double")
    assert E.detect_columns(rows)["target"] == name
    assert {r.label for r in E.map_target(rows, name).collect()} == {0, 1}


def test_no_target_is_an_error(spark):
    with pytest.raises(ValueError):
        E.detect_columns(spark.range(10).select(F.col("id").alias("a")))


def test_unmapped_targets(spark):
    rows = spark.createDataFrame([("bad",), ("??",)], "t string")
    assert [r.label for r in E.map_target(rows, "t").collect()] == [1, 0]
    assert E.map_target(rows, "t", on_unmapped="drop").count() == 1
    with pytest.raises(Exception, match="unknown target"):
        E.map_target(rows, "t", on_unmapped="error").collect()


def test_quantiles_of_many_rows_use_narrow_brackets(spark, monkeypatch):
    rows = spark.range(50000).select(((F.col("id") * 7919) % 50000 / 3).alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    want = {c: np.quantile([r[c] for r in rows.collect()], [0.1, 0.5]) for c in ("x", "y")}
    for small in (A.SMALL_COUNT, 0):  # by a plain window, and by distributed totals
        monkeypatch.setattr(A, "SMALL_COUNT", small)
        got = {r.feature: [r.a, r.b] for r in A.quantiles(rows, ["x", "y"], {"a": 0.1, "b": 0.5}).collect()}
        assert got == {c: pytest.approx(list(v), abs=1e-9) for c, v in want.items()}


def test_a_bracket_that_misses_is_reported(spark):
    rows = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert A._ranked_values(rows, [("x", "m", 0.5, 100, 0.0, 10.0), ("x", "m", 0.5, 100, 40.0, 60.0)]) == [None, 49.5]
