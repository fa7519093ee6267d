import itertools
import math
import pickle

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.operators import evaluate as V
from loanlens.operators import explain as X
from loanlens.operators.stats import FillValues
from loanlens.plans import score as P
from loanlens.plans import train as T
from loanlens.session import scratch_path
from loanlens.sources import tables


@pytest.fixture(scope="module")
def frame(spark):
    x = F.rand(1)
    rows = spark.range(600).select(
        "id", x.alias("a"), F.rand(2).alias("b"), (F.rand(3) * 3).cast("int").cast("double").alias("c")
    )
    noisy = F.col("a") + 0.3 * F.col("c") * F.col("b") + 0.2 * F.rand(4)
    return rows.withColumn("label", (noisy > 0.75).cast("int")).cache()


@pytest.fixture(scope="module")
def fitted(frame):
    return T.fit_boosted_trees(frame, ["a", "b", "c"], "label", {"maxIter": 6, "maxDepth": 4})


def expected_value(nodes, known, x):
    """Path-dependent expectation of one tree when only the features in ``known`` are given."""
    def walk(i):
        n = nodes[i]
        if n["leftChild"] < 0:
            return n["prediction"]
        f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return walk(n["leftChild"] if x[f] <= cut else n["rightChild"])
        left, right = nodes[n["leftChild"]], nodes[n["rightChild"]]
        return (left["rawCount"] * walk(n["leftChild"]) + right["rawCount"] * walk(n["rightChild"])) / n["rawCount"]

    return walk(0)


def test_contributions_equal_brute_force_shapley(spark, frame, fitted):
    trees_model = fitted.stages[-1]
    path = scratch_path(spark, "brute")
    trees_model.save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData.asDict(recursive=True)
    scored = P.score(frame.limit(12), fitted)
    rows = X.shap_values(scored, trees_model, ["a", "b", "c"]).withColumn("x", vector_to_array("features")).collect()
    for r in rows:
        want = np.zeros(3)
        for t, weight in enumerate(trees_model.treeWeights):
            for j in range(3):
                others = [k for k in range(3) if k != j]
                for size in range(3):
                    for s in itertools.combinations(others, size):
                        share = math.factorial(size) * math.factorial(2 - size) / 6
                        gain = expected_value(trees[t], {*s, j}, r.x) - expected_value(trees[t], set(s), r.x)
                        want[j] += 2 * weight * share * gain
        assert [r.shap_values[f] for f in "abc"] == pytest.approx(list(want), abs=1e-9)


def test_contributions_add_up(frame, fitted):
    rows = X.shap_values(P.score(frame, fitted), fitted.stages[-1], ["a", "b", "c"]).collect()
    for r in rows:
        p = 1 / (1 + math.exp(-(r.expected_value + sum(r.shap_values.values()))))
        assert p == pytest.approx(r.probability_default, abs=1e-9)


def test_long_paths_give_the_same_result_without_tables(monkeypatch, spark, frame, fitted):
    data = np.array([[r.a, r.b, r.c] for r in frame.limit(50).collect()])
    with_tables = X.contributions(X.model_trees(spark, fitted.stages[-1]), data)
    monkeypatch.setattr(X, "TABLE_BYTES", 100)
    assert np.allclose(with_tables, X.contributions(X.model_trees(spark, fitted.stages[-1]), data))


def test_scores_are_probabilities_and_auc_agrees(frame, fitted):
    scored = fitted.transform(frame)
    pairs = P.score(frame, fitted)
    assert pairs.where("probability_default < 0 or probability_default > 1 or binary_prediction not in (0, 1)").count() == 0
    ours = V.auc_roc(pairs, "label", "probability_default").first().auc_roc
    theirs = BinaryClassificationEvaluator(labelCol="label", numBins=0).evaluate(scored)
    assert ours == pytest.approx(theirs, abs=1e-9) and ours > 0.8


def test_save_load_and_rollback(spark, frame, fitted):
    from datetime import datetime, timezone

    store = tables.ModelStore(spark, scratch_path(spark, "store"))
    with pytest.raises(ValueError):
        store.load()
    first = store.save(fitted, ["a", "b", "c"], {"accuracy": 0.9}, at=datetime(2025, 1, 1, tzinfo=timezone.utc))
    second = store.save(fitted, ["a", "b", "c"], {"accuracy": 0.8}, at=datetime(2025, 1, 2, tzinfo=timezone.utc))
    assert (first, second) == ("v20250101T000000Z", "v20250102T000000Z")
    model, features, version = store.load()
    assert version == second and features == ["a", "b", "c"]
    store.rollback(first)
    assert store.load()[2] == first
    before = {r.id: r.probability_default for r in P.score(frame, fitted).collect()}
    after = {r.id: r.probability_default for r in P.score(frame, model).collect()}
    assert before == after
    assert store.metrics.read().count() == 2


@pytest.fixture(scope="module")
def scorer(spark, small):
    from loanlens.catalog import modeling

    return modeling.scorer(spark, small)


def test_batch_isolates_bad_rows(applications, scorer):
    from test_impute_and_drift import COMPLETE

    rows = applications(COMPLETE, dict(COMPLETE, person_age=150), {"person_income": 60000, "loan_amnt": 15000})
    keyed = rows.withColumn("application_id", F.monotonically_increasing_id())
    got = P.score_batch(keyed, scorer, explain=True).orderBy("application_id").collect()
    assert [r.status for r in got] == ["success", "error", "success"]
    assert got[1].risk_level is None and got[1].error == "person_age: above 100"
    for r in (got[0], got[2]):
        assert 0 <= r.probability_default <= 1 and r.binary_prediction in (0, 1)
        assert r.risk_level in (S.HIGH_RISK, S.BORDERLINE_RISK, S.LOW_RISK)
        assert r.probability_default_percent == pytest.approx(r.probability_default * 100, abs=0.006)
        assert set(r.shap_values) == set(scorer.features)
    assert len(got[2].imputation_log) == 9


def test_extra_columns_do_not_reach_the_features(applications, scorer):
    rows = applications({"person_income": 55000, "loan_amnt": 12000, "loan_grade": "B"}).withColumn("application_id", F.lit(1))
    extra = rows.withColumns({"name": F.lit("x"), "id": F.lit(7), "date": F.lit("2025-01-01"), "loan_status": F.lit(1)})
    a = P.score_batch(rows, scorer).first()
    b = P.score_batch(extra, scorer).first()
    assert a.probability_default == b.probability_default and a.input_features == b.input_features


def test_strict_and_dynamic_agree_on_complete_records(spark, small, scorer):
    from loanlens.catalog import views

    both = P.compare_paths(views.applications(spark, small), scorer)
    assert both.count() > 0 and both.where("not tiers_match").count() == 0


def test_scoring_adds_no_shuffle(spark, scorer, applications):
    rows = applications({"person_income": 1.0}).withColumn("application_id", F.lit(1))
    plan = P.score_batch(rows, scorer)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_retrain_gate_and_run(spark):
    rows = spark.range(120).select(
        "id", F.to_json(F.struct(
            (F.col("id") % 50 + 20.0).alias("person_age"), (F.col("id") * 100.0).alias("person_income"),
            F.when(F.col("id") % 2 == 0, "RENT").otherwise("own").alias("home_ownership"),
        )).alias("input_features"),
        F.when(F.col("id") % 10 != 0, (F.col("id") % 3 == 0).cast("int")).alias("actual_outcome"),
    )
    refused = T.retrain(rows, min_samples=1000)
    assert refused["status"] == "insufficient_data" and refused["readiness"]["samples_needed"] == 880
    store = tables.ModelStore(spark, scratch_path(spark, "store"))
    done = T.retrain(rows, min_samples=10, params={"maxIter": 2, "maxDepth": 2}, store=store)
    assert done["status"] == "success"
    assert done["training_samples"] + done["test_samples"] == 108
    assert {"home_ownership_RENT", "home_ownership_OWN", "person_age"} <= set(done["result"].features)
    assert store.load()[2] == done["model_version"]


def test_fill_values_fall_back(applications):
    from loanlens.operators.impute import impute

    row = impute(applications({}), FillValues()).first()
    assert (row.person_age, row.person_income, row.loan_percent_income) == (35.0, 50000.0, 0.25)


def test_queries_train_at_full_size(spark, small, monkeypatch):
    from loanlens.catalog import modeling

    seen = {}

    def seen_as(name, result=None):
        return lambda *given, **named: seen.update({name: (given, named)}) or result

    monkeypatch.setattr(T, "fit_boosted_trees", seen_as("boosted"))
    monkeypatch.setattr(T, "train_flexible", seen_as("flexible", T.Trained(None, [], {}, 0, 0, {})))
    modeling._trained.__wrapped__("", spark, small)
    modeling.train_flexible(spark, small)
    assert len(seen["boosted"][0]) == 3 and not seen["boosted"][1]  # no parameters: those of the library
    assert set(seen["flexible"][0][0].columns) == {"application_id", *S.CANONICAL, "loan_status"} and "params" not in seen["flexible"][1]
    assert modeling._forest().getStages()[-1].getNumTrees() == T.FOREST["numTrees"]


def random_tree(rng, depth, features):
    """A full tree in the layout of a saved model."""
    nodes = {}

    def grow(level, count):
        i = len(nodes)
        nodes[i] = node = {"rawCount": count, "leftChild": -1, "rightChild": -1, "prediction": float(rng.normal()), "split": None}
        if level < depth:
            node["split"] = {"featureIndex": int(rng.integers(features)), "leftCategoriesOrThreshold": [float(rng.normal())]}
            left = int(count * rng.uniform(0.2, 0.8))
            node["leftChild"] = grow(level + 1, left)
            node["rightChild"] = grow(level + 1, count - left)
        return i

    grow(0, 10**9)
    return nodes


@pytest.mark.parametrize("room", [0, 2000, 64 << 20])
def test_deep_trees_equal_brute_force(monkeypatch, room):
    monkeypatch.setattr(X, "TABLE_BYTES", room)
    rng = np.random.default_rng(6)
    nodes, rows = random_tree(rng, 7, 7), rng.normal(size=(3, 7))
    trees = [X._tree(nodes, 1.0)]
    X._tabulate(trees)
    got = X.contributions(trees, rows)
    for x, mine in zip(rows, got):
        value = {s: expected_value(nodes, set(s), x) for k in range(8) for s in itertools.combinations(range(7), k)}
        want = [
            sum(math.factorial(len(s)) * math.factorial(6 - len(s)) / math.factorial(7) * (value[tuple(sorted({*s, j}))] - v) for s, v in value.items() if j not in s)
            for j in range(7)
        ]
        assert mine == pytest.approx(want, abs=1e-9)


def test_a_model_of_deep_trees_stays_small():
    """A hundred trees of depth 10: what is sent to the executors stays below 300 MB."""
    rng = np.random.default_rng(7)
    trees = [X._tree(random_tree(rng, 10, 22), 1.0) for _ in range(100)]
    X._tabulate(trees)
    assert len(pickle.dumps(trees)) < 300 << 20
    rows = rng.normal(size=(20, 22))
    total = X.contributions(trees[:2], rows).sum(axis=1) + X.expected_value(trees[:2])

    def run(node, x):
        return node.value if isinstance(node, X.Leaf) else run(node.left if x[node.feature] <= node.cut else node.right, x)

    assert total == pytest.approx([sum(run(t, x) for t in trees[:2]) for x in rows])


def test_an_explainer_is_built_once(spark, applications, scorer, monkeypatch):
    built = []
    monkeypatch.setattr(X, "model_trees", lambda *a, read=X.model_trees: built.append(1) or read(*a))
    rows = applications({"person_income": 1.0}).withColumn("application_id", F.lit(1))
    fresh = P.Scorer(scorer.model, scorer.features, scorer.fill)
    values = [P.score_batch(rows, fresh, explain=True).first().shap_values for _ in range(3)]
    assert len(built) == 1 and values[0] == values[1] == values[2]


def test_trees_train_on_even_parts(spark, monkeypatch):
    """Each level of each tree is a job: its tasks follow cores and rows, not the partitions of the raw frame."""
    from loanlens import session

    seen, cores = [], spark.sparkContext.defaultParallelism
    monkeypatch.setattr(T.GBTClassifier, "fit", lambda self, rows: seen.append(rows.rdd.glom().map(len).collect()))
    frame = spark.range(0, 4000, 1, 200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).alias("label"))
    T.fit_boosted_trees(frame, ["a"], "label")
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    T.fit_boosted_trees(frame, ["a"], "label")
    assert [sum(x) for x in seen] == [4000, 4000]
    assert len(seen[0]) == cores and len(seen[1]) == -(-4000 // (cores * 100)) * cores and max(seen[1]) <= 110


def test_folds_of_a_large_frame_run_alone(spark, monkeypatch):
    from loanlens import session

    frame = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), F.lit("x").alias("b"), (F.col("id") % 2).cast("int").alias("label"))
    cores = spark.sparkContext.defaultParallelism
    assert T.folds_at_once(frame, 5) == 5
    monkeypatch.setattr(session, "TASK_ROWS", 100 // cores)  # all cores hold a quarter of the frame
    assert T.folds_at_once(frame, 5) == 1 and T.folds_at_once(frame.limit(0), 5) == 5
    scores, mean = T.kfold_cv(frame, T.forest_pipeline(["a"], ["b"], params={"numTrees": 2}), "id", folds=3)
    assert len(scores) == 3 and mean == pytest.approx(sum(scores) / 3)


def test_forest_query_trains_on_even_parts(spark, small, monkeypatch):
    from loanlens import session
    from loanlens.catalog import modeling

    seen = []

    class Stop(Exception):
        pass

    def fit(self, rows):
        seen.append(max(rows.rdd.glom().map(len).collect()))
        raise Stop

    monkeypatch.setattr(session, "TASK_ROWS", 20)
    monkeypatch.setattr(modeling.M.Pipeline, "fit", fit)
    with pytest.raises(Stop):
        modeling.train_random_forest(spark, small)
    assert seen[0] <= 25


def test_queries_share_one_join(spark, small, monkeypatch):
    """Fill values, training and scoring read applications that were joined and written once, and again only if their folder is gone."""
    import shutil

    from loanlens.catalog import modeling
    from loanlens.catalog import views as W

    made, real = [], W.applications
    monkeypatch.setattr(W, "applications", lambda *a: made.append(a) or real(*a))
    W._written.cache_clear()
    W._fill.cache_clear()
    monkeypatch.setitem(T.BOOSTED, "maxIter", 1)
    fitted = modeling.P.Scorer(modeling._trained.__wrapped__("", spark, small), modeling.FEATURES, W.fill_values(spark, small))
    rows = modeling.P.score(modeling._encoded(spark, small), fitted.model)
    labelled = real(spark, small).where("loan_status IS NOT NULL").count()
    assert rows.count() == labelled and "first_line" not in rows._jdf.queryExecution().toString()
    assert len(made) == 1
    written = W.written_applications(spark, small)
    assert written.exceptAll(real(spark, small)).isEmpty() and real(spark, small).exceptAll(written).isEmpty()
    shutil.rmtree(W._written(spark.sparkContext.applicationId, spark, small)[0])
    assert W.written_applications(spark, small).count() == written.sparkSession.read.parquet(f"{small}/orders.parquet").count()
    assert len(made) == 2


def test_flexible_training_reads_its_frame_once(spark, monkeypatch):
    """Column kinds, medians, categories and split read a written copy: an expensive frame is worked out once."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        read.add(1)
        return float(x % 97)

    rows = spark.range(400).select("id", costly("id").alias("a"), F.concat(F.lit("c"), F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("loan_status"))
    result = T.train_flexible(rows, "id", params={"maxIter": 1})
    assert read.value == 400 and result.train_rows + result.test_rows == 400
    assert result.details["numeric_features"] == ["a"] and result.details["categorical_features"] == ["b"]
    given = {"target": "loan_status", "numeric": ["a"], "categorical": ["b"]}
    assert T.train_flexible(rows, "id", given, params={"maxIter": 1}).metrics == result.metrics


def test_retraining_reads_its_predictions_once(spark):
    """Gate, keys and extraction read a written copy: expensive predictions are worked out once."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def costly(x):
        read.add(1)
        return x % 2 if x >= 40 else None

    texts = F.to_json(F.struct((F.col("id") % 97 + 0.5).alias("person_age"), F.concat(F.lit("c"), F.col("id") % 3).alias("extra")))
    rows = spark.range(400).select("id", texts.alias("input_features"), costly("id").alias("actual_outcome"))
    done = T.retrain(rows, params={"maxIter": 1})
    assert read.value == 400 and done["training_samples"] + done["test_samples"] == 360
    assert (done["readiness"]["total_predictions"], done["readiness"]["feedback_count"]) == (400, 360)
    assert {"person_age", "extra_C0", "extra_C1", "extra_C2"} <= set(done["result"].features)


def test_medians_need_no_frame(spark, monkeypatch):
    from loanlens.operators import impute, stats

    rows = spark.createDataFrame([(1.0, None, None), (2.0, 5.0, None), (4.0, 7.0, None)], "a double, b double, c double")
    want = {r.feature: r.median for r in stats.quantiles(rows, ["a", "b", "c"], {"median": 0.5}).collect()}
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: 1 / 0)
    assert impute.train_medians(rows, ["a", "b", "c"]) == want == {"a": 2.0, "b": 6.0}
    assert stats.fit_fill_values(rows.withColumnsRenamed({"a": "loan_amnt", "b": "person_age"})).medians == {"loan_amnt": 2.0, "person_age": 6.0}
    assert impute.train_medians(rows, ["a"], 100) == {"a": 2.0} and impute.train_medians(rows, []) == {}


def test_small_subtrees_are_looked_up_together(monkeypatch):
    """Leaves share tables, a table a subtree: with any bound the contributions are those of single leaves."""
    rng = np.random.default_rng(9)
    nodes, rows = [random_tree(rng, 6, 5) for _ in range(3)], rng.normal(size=(200, 5))

    def found(block):
        monkeypatch.setattr(X, "BLOCK_BYTES", block)
        trees = [X._tree(n, 1.0) for n in nodes]
        X._tabulate(trees)
        return X.contributions(trees, rows), sum(tables(t) for t in trees)

    def tables(node):
        return 1 if node.table is not None else 0 if isinstance(node, X.Leaf) else tables(node.left) + tables(node.right)

    (alone, none), (some, many), (all_, few) = found(0), found(1 << 10), found(1 << 16)
    assert none == 0 and 0 < few < many < 3 * 64 and few <= 3 * 16
    assert np.allclose(some, alone, atol=1e-12) and np.allclose(all_, alone, atol=1e-12)
