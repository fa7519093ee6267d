"""Categories as one sparse vector: any number, any names, the same trees as with a column per category."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanlens.functions.names import quoted
from loanlens.operators import encode as E
from loanlens.plans import train as T
from loanlens.session import scratch_path
from loanlens.sources import tables

SMALL = {"maxIter": 4, "maxDepth": 3}


@pytest.fixture(scope="module")
def odd(spark):
    """Dots, backticks, blanks and empty strings in names and categories; nulls; a category that decides."""
    names = ["v1.0", "v2.0", "a`b", "", "=", "x y", None]
    rows = [(i, float(i * 7 % 50) if i % 9 else None, names[i % 7], f"r{i % 41}.{i % 7 if i % 2 else 0}", int(i % 7 == 2 or i % 11 == 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, n double, t string, u string, y int")
    return frame.toDF("id", "net. income", "ver`sion.x", "region.", "loan_status")


COLUMNS = {"target": "loan_status", "numeric": ["net. income"], "categorical": ["ver`sion.x", "region."]}


def test_sparse_flags_equal_wide_flags(odd):
    texts = COLUMNS["categorical"]
    values = E.categories(odd, texts)
    assert values["ver`sion.x"] == sorted(["v1.0", "v2.0", "a`b", "", "=", "x y"]) and len(values["region."]) == len({f"{i % 41}.{i % 7 if i % 2 else 0}" for i in range(600)})
    for first in (False, True):
        kept = {c: vs[: 5] if c == "region." else vs for c, vs in values.items()}  # the others are unknown
        sparse = E.one_hot_sparse(odd, kept, drop_first=first)
        assert sparse.columns == ["id", "net. income", "loan_status", "flags"]
        wide = E.one_hot_dynamic(odd, kept, drop_first=first)
        flags = [quoted(c) for c in wide.columns[3:]]
        want = {r[0]: r[1] for r in wide.select("id", F.array(*flags)).collect()}
        got = {r[0]: (r[1], r[2]) for r in sparse.select("id", vector_to_array("flags"), E.set_flags(F.col("flags"))).collect()}
        assert {k: [int(x) for x in v[0]] for k, v in got.items()} == want
        assert all(places == [i for i, x in enumerate(v) if x] for v, places in got.values())


def test_no_categories_and_no_rows(spark, odd):
    assert [r[0] for r in E.one_hot_sparse(odd.limit(2), {"region.": []}).select(vector_to_array("flags")).collect()] == [[], []]
    assert E.categories(odd.limit(0), ["region."]) == {"region.": []}
    with pytest.raises(ValueError, match="no feature"):
        T.fit_boosted_trees(odd, T.Inputs({}, {"region.": []}), "loan_status")


def test_same_predictions_as_a_column_per_category(odd):
    params = SMALL | {"minInstancesPerNode": 4}
    inputs = T.fit_inputs(odd, ["net. income"], COLUMNS["categorical"], least=4)
    every = T.fit_inputs(odd, ["net. income"], COLUMNS["categorical"])
    assert len(every.features) > len(inputs.features)  # rare ones are left out
    sparse = T.fit_boosted_trees(odd, inputs, "loan_status", params).transform(odd)
    known = every.select(odd, ["id", "loan_status"])
    wide = E.one_hot_dynamic(known, {f"t{i}": vs for i, vs in enumerate(every.texts.values())})
    names = [c for c in wide.columns if c not in ("id", "loan_status")]
    positional = wide.toDF("id", "loan_status", *[f"f{i}" for i in range(len(names))])
    model = T.fit_boosted_trees(positional, [f"f{i}" for i in range(len(names))], "loan_status", params)
    want = {r.id: r.p for r in model.transform(positional).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.id: r.p for r in sparse.select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert got == pytest.approx(want) and len(set(want.values())) > 3
    assert sparse.columns[:5] == odd.columns and len(sparse.columns) == 9  # features and the three outputs, no helpers


def test_trains_saves_and_scores_odd_names(spark, odd):
    store = tables.ModelStore(spark, scratch_path(spark, "store"))
    done = T.train_flexible(odd, "id", COLUMNS, params=SMALL, store=store)
    assert {"net. income", "ver`sion.x_", "ver`sion.x_v1.0", "region._r1.0"} <= set(done.features) and done.details["n_samples"] == 600
    again, features, _ = store.load()
    assert features == done.features
    unseen = spark.createDataFrame([(1, None, "new.one", None, 0)], odd.schema)
    for rows in (odd, unseen):
        one, two = (m.transform(rows).select("id", vector_to_array("probability")[1]).collect() for m in (done.model, again))
        assert one == two


def test_names_are_found_not_given(odd):
    done = T.train_flexible(odd, "id", params=SMALL)
    assert done.details["numeric_features"] == ["net. income"] and set(done.details["categorical_features"]) == set(COLUMNS["categorical"])


def test_fifty_thousand_categories(spark):
    many = F.when(F.col("id") % 6 == 0, F.concat(F.lit("common."), (F.col("id") % 4).cast("string"))).otherwise(F.concat(F.lit("rare`"), F.col("id").cast("string")))
    rows = spark.range(60_000).select("id", many.alias("code"), (F.col("id") % 97).alias("n"), ((F.col("id") % 12 == 0) | (F.col("id") % 31 == 0)).cast("int").alias("label"))
    assert len(E.categories(rows, ["code"])["code"]) == 50_002
    flags = E.one_hot_sparse(rows, E.categories(rows, ["code"]))
    assert flags.where(F.size(E.set_flags(F.col("flags"))) == 1).count() == 60_000
    done = T.train_flexible(rows, "id", {"target": "label", "numeric": ["n"], "categorical": ["code"]}, params=SMALL)
    assert done.features == ["n", "code_common.0", "code_common.2"] and done.metrics["accuracy"] > 0.9


def test_retrain_takes_values_with_dots(spark):
    stored = F.to_json(F.struct((F.col("id") % 50 + 20.0).alias("person_age"), F.concat(F.lit("v1."), (F.col("id") % 3).cast("string")).alias("ver")))
    rows = spark.range(120).select("id", stored.alias("input_features"), (F.col("id") % 3 == 0).cast("int").alias("actual_outcome"))
    done = T.retrain(rows, min_samples=10, params=SMALL)
    assert {"ver_V1.0", "ver_V1.1", "person_age"} <= set(done["result"].features) and done["metrics"]["accuracy"] == 1.0
