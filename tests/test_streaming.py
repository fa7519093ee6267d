"""Streams against the batch operators: several batches, restarts, broken and repeated batches, late rows."""

import pytest
from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.operators import reports as R
from loanlens.operators.stats import FillValues
from loanlens.plans import imports
from loanlens.plans import train as T
from loanlens.plans.score import Scorer
from loanlens.session import scratch_path
from loanlens.streaming import jobs
from loanlens.streaming.journal import Journal

FOREIGN = {"person_age": "Age", "person_income": "annual-income", "home_ownership": "Home"}


@pytest.fixture(scope="module")
def scorer(spark):
    rows = spark.range(200).select(*[(F.rand(i) * 10).alias(f) for i, f in enumerate(S.model_features())], (F.col("id") % 2).alias("label"))
    return Scorer(T.fit_boosted_trees(rows, S.model_features(), "label", {"maxIter": 2, "maxDepth": 2}), S.model_features(), FillValues(), "v1")


@pytest.fixture(scope="module")
def history(spark):
    ages = F.when(F.col("id") % 10 == 3, F.lit(None)).when(F.col("id") % 10 == 4, 150.0).otherwise(30.0 + F.col("id") % 20)
    return spark.range(60).select(
        F.col("id").alias("application_id"), ages.alias("Age"), (F.col("id") * 1000.0).alias("annual-income"), F.lit(5000.0).alias("loan_amnt"),
        F.when(F.col("id") % 2 == 0, "rent").otherwise("OWN").alias("Home"), F.when(F.col("id") % 3 < 2, F.col("id") % 3).cast("int").alias("loan_status"),
        F.concat(F.lit("x"), "id").alias("extra.note"),
    )


def part(rows, i):
    return rows.where(F.floor(F.col("application_id") / 20) == i)


def check_import(journal, rows, scorer, batches):
    """Both tables equal the batch import and batch scoring of each part, ids running on."""
    apps, preds = journal.read("applications").drop("batch"), journal.read("predictions").drop("batch")
    last, want_apps, want_preds = 0, [], []
    for i in range(batches):
        new_apps, history = imports.import_history(part(rows, i), ["application_id"], last_id=last)
        scored = jobs.scored_rows(new_apps, scorer, "id").join(history.select(F.col("application_id").alias("id"), "actual_outcome"), "id")
        want_apps += new_apps.collect()
        want_preds += scored.withColumnRenamed("id", "application_id").collect()
        last += 20
    assert sorted(map(tuple, apps.collect()), key=str) == sorted(map(tuple, want_apps), key=str)
    assert sorted(map(tuple, preds.select(*want_preds[0].__fields__).collect()), key=str) == sorted(map(tuple, want_preds), key=str)
    assert sorted(r.id for r in apps.collect()) == list(range(1, 20 * batches + 1))
    assert {r.status for r in preds.collect()} == {"success", "error"}


def test_import_equals_batch_over_batches_and_restarts(spark, history, scorer):
    source, root = scratch_path(spark, "in"), scratch_path(spark, "imported")
    for i in range(3):
        part(history, i).coalesce(1).write.mode("append").parquet(source)
        if i != 0:  # the second start meets one new file, the first none of its own
            jobs.stream_import_and_score(spark, source, history.schema, scorer, root, ["application_id"], files_per_batch=1).awaitTermination()
    journal = Journal(spark, root)
    assert journal.entries().count() == 3
    check_import(journal, history, scorer, 3)


@pytest.mark.parametrize("broken", ["predictions", "commit"])
def test_a_broken_batch_is_made_good_on_restart(spark, history, scorer, monkeypatch, broken):
    source, root = scratch_path(spark, "in"), scratch_path(spark, "imported")
    part(history, 0).coalesce(1).write.parquet(source)
    jobs.stream_import_and_score(spark, source, history.schema, scorer, root, ["application_id"]).awaitTermination()
    part(history, 1).coalesce(1).write.mode("append").parquet(source)
    with monkeypatch.context() as m:
        write, fail = Journal.write, RuntimeError("lost")

        def writes(self, name, *rest):
            if name == broken:
                raise fail
            write(self, name, *rest)

        def commits(self, *rest):
            raise fail

        m.setattr(Journal, "write", writes)
        if broken == "commit":
            m.setattr(Journal, "commit", commits)
        with pytest.raises(Exception, match="lost"):
            jobs.stream_import_and_score(spark, source, history.schema, scorer, root, ["application_id"]).awaitTermination()
    check_import(Journal(spark, root), history, scorer, 1)  # nothing of the broken batch is seen
    jobs.stream_import_and_score(spark, source, history.schema, scorer, root, ["application_id"]).awaitTermination()
    check_import(Journal(spark, root), history, scorer, 2)


def test_a_repeated_batch_writes_nothing_twice(spark, history, scorer):
    journal = Journal(spark, scratch_path(spark, "imported"))
    for number in (0, 1, 1, 0):
        jobs.import_batch(journal, part(history, number), number, scorer, ["application_id"])
    check_import(journal, history, scorer, 2)
    assert journal.entries().count() == 2


def test_a_journal_without_batches(spark):
    journal = Journal(spark, scratch_path(spark, "none"))
    assert journal.begin(0) == 0 and journal.entries().count() == 0
    with pytest.raises(ValueError, match="no batch"):
        journal.read("applications")


# ---- requests ----


def log_of(spark, minutes, start=0):
    rows = [(start + i, int(m), None if i % 7 == 0 else "p", "m" if i % 2 else None) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "id long, minute long, provider string, model string").select("id", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "provider", "model")


def test_running_numbers_continue(spark):
    source, root = scratch_path(spark, "in"), scratch_path(spark, "numbered")
    parts = [log_of(spark, range(0, 60, 2)), log_of(spark, range(60, 90), 100), log_of(spark, [91, 92], 200)]
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(source)
        jobs.stream_running_counts(spark.readStream.schema(rows.schema).parquet(source), root).awaitTermination()
    want = R.running_request_count(parts[0].union(parts[1]).union(parts[2]))
    got = jobs.running_request_counts(Journal(spark, root)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    late = log_of(spark, [1], 301)  # of a known key, long past: numbered after all that came before
    late.write.mode("append").parquet(source)
    jobs.stream_running_counts(spark.readStream.schema(late.schema).parquet(source), root).awaitTermination()
    again = {r.id: r.session_count for r in jobs.running_request_counts(Journal(spark, root)).collect()}
    assert {r.id: again[r.id] for r in want.collect()} == {r.id: r.session_count for r in want.collect()}
    assert again[301] == 1 + want.where("provider IS NULL AND model IS NULL").count()


@pytest.mark.parametrize("job, batch, keys", [
    (jobs.stream_request_counts, jobs.request_counts, ("window_start", "provider")),
    (jobs.stream_request_sessions, jobs.request_sessions, ("session_start", "provider")),
])
def test_windows_close_over_restarts_and_at_the_end(spark, job, batch, keys):
    source, target, state, closing = (scratch_path(spark, n) for n in ("in", "out", "state", "closing"))
    parts = [log_of(spark, [0, 5, 20, 100]), log_of(spark, [95, 130, 300], 50), log_of(spark, [10, 299, 600], 90)]
    late = parts[2].where("id = 90")  # minute 10, when minute 300 has been seen: left out
    for i, rows in enumerate(parts):
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        job(stream, target, state, closing=closing).awaitTermination()
        if i == 1:
            early = spark.read.parquet(target)
            assert 0 < early.count() < batch(parts[0].union(parts[1])).count()  # the newest windows are open
    jobs.close_windows(spark, closing)
    job(spark.readStream.schema(parts[0].schema).parquet(source), target, state, closing=closing).awaitTermination()
    kept = parts[0].union(parts[1]).union(parts[2]).join(late.select("id"), "id", "left_anti")
    want = batch(kept)
    got = spark.read.parquet(target).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
