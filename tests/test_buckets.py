"""Point updates of bucketed tables: results, and what is read and written."""

import pytest
from pyspark.sql import functions as F

from loanlens.operators import joins as J
from loanlens.session import scratch_path
from loanlens.sources.buckets import BucketedTable

SCHEMA = "id long, v int, name string"


def make(spark, rows, buckets=1000):
    frame = spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows
    store = BucketedTable(spark, scratch_path(spark, "b"), frame.schema, "id", buckets)
    store.create(frame)
    return store


def files_of(store):
    return {f.split("bucket__=")[1] for f in store.read().inputFiles()}


def test_ten_updates_touch_ten_buckets_at_most(spark):
    rows = spark.range(6000).select("id", F.lit(0).cast("int").alias("v"), F.lit("a").alias("name"))
    store = make(spark, rows)
    before = files_of(store)
    updates = spark.createDataFrame([(i * 599, i, 1) for i in range(10)], "id int, v long, updated_at int")  # other types than stored
    plan = store.rows_of(updates)[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket__" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.update(updates) <= 10
    changed = {f.split("/")[0] for f in before ^ files_of(store)}
    assert 0 < len(changed) <= 10 and len(before & files_of(store)) >= len(before) - 10
    got = {r.id: (r.v, r.name) for r in store.read().collect()}
    assert got == {i: (i // 599 if i % 599 == 0 and i < 5990 else 0, "a") for i in range(6000)}


def test_updates_equal_the_whole_table_operator(spark):
    rows = [(i % 40, i, f"n{i}") for i in range(120)] + [(None, 5, "x"), (None, None, None), (None, 5, "x")]
    updates = spark.createDataFrame([(3, 1, "a", 1), (3, None, "b", 2), (4, 9, None, 1), (None, 8, "z", 1), (77, 1, "u", 1)], "id long, v int, name string, updated_at int")
    for options in ({}, {"null_sets": True}, {"columns": ["name"]}):
        store = make(spark, rows, 7)
        want = J.apply_updates(store.read(), updates, **options).collect()
        store.update(updates, **options)
        assert sorted(map(str, store.read().collect())) == sorted(map(str, want))


def test_feedback_in_rounds_and_appends(spark):
    preds = spark.createDataFrame([(i, None, None) for i in range(50)], "id long, actual_outcome int, feedback_date string")
    store = make(spark, preds, 16)
    for k in range(3):
        given = spark.createDataFrame([(k, k % 2, f"d{k}"), (k + 1, 1, f"c{k}")], preds.schema)
        store.update(given, J.record_feedback)
    store.append(spark.createDataFrame([(99,)], "id int"))
    got = {r.id: (r.actual_outcome, r.feedback_date) for r in store.read().collect()}
    assert got == {**{i: (None, None) for i in range(50)}, 0: (0, "d0"), 1: (1, "d1"), 2: (0, "d2"), 3: (1, "c2"), 99: (None, None)}


def test_odd_tables_and_updates(spark):
    store = make(spark, [], 4)
    assert store.read().count() == 0 and store.update(spark.createDataFrame([(1, 2, 3)], "id long, v int, updated_at int")) == 1
    assert store.read().count() == 0
    store = make(spark, [(1, 1, "a"), (None, 2, "b")], 4)
    assert store.update(spark.createDataFrame([], "id long, v int, updated_at int")) == 0
    assert store.update(spark.createDataFrame([(None, 7, 1)], "id long, v int, updated_at int")) == 0
    with pytest.raises(ValueError, match="v"):
        store.update(spark.createDataFrame([(1, 1 << 40, 1)], "id long, v long, updated_at int"))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, spark.createDataFrame([(1, 1, "a"), (None, 2, "b")], SCHEMA).collect()))
    with pytest.raises(Exception):
        store.create(store.read())
