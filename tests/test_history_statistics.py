"""Statistics that grow with the imports."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loanlens.operators import stats as A
from loanlens.plans import history as H
from loanlens.plans import imports as P
from loanlens.session import scratch_path
from loanlens.sources.tables import Table

ROWS = "a double, b int, empty double, t string, u string"


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(3)

    def rows(n, shift):
        return [
            (rng.choice([None, 0.0, -1.5, 1e-12, rng.gauss(shift, 1e3), rng.gauss(0, 1e-3)]), rng.choice([None, rng.randint(-5, 80)]),
             None, rng.choice(["x", "y", "y ", None]), rng.choice(["p", "q"]))
            for _ in range(n)
        ]

    return [spark.createDataFrame(rows(n, s), ROWS) for n, s in ((700, 0), (1, 5), (900, -4e4), (350, 1e6))]


@pytest.fixture()
def made(spark):
    return H.HistoryStatistics(spark, scratch_path(spark, "statistics"), ["a", "b", "empty"], ["t", "u"])


def _same(got, want):
    assert {r.feature for r in got} == {r.feature for r in want}
    for one, two in zip(sorted(got, key=lambda r: r.feature), sorted(want, key=lambda r: r.feature), strict=True):
        for name in two.asDict():
            assert one[name] == two[name] or one[name] == pytest.approx(two[name], rel=1e-9), (two.feature, name)


def test_every_import_gives_the_statistics_of_all_rows(spark, made, parts):
    whole = None
    for number, part in enumerate(parts, 1):
        assert made.add(part, number)
        whole = part if whole is None else whole.union(part)
        columns = ["a", "b", "empty"]
        _same(made.historical().collect(), A.historical_statistics(whole, columns).collect())
    assert {r.feature: r.mode for r in made.modes().collect()} == {r.feature: r.mode for r in A.categorical_modes(whole, ["t", "u"]).collect()}
    medians = {r.feature: r.median for r in A.quantiles(whole, ["a", "b"], {"median": 0.5}).collect()}
    assert made.fill_values().medians == medians


def test_repeated_and_broken_imports_count_once(spark, made, parts):
    made.add(parts[0], 1)
    first = made.historical().collect()
    assert not made.add(parts[2], 1)
    for name in ("values", "moments", "histogram"):  # a driver lost before the import was listed
        made.journal.write(name, 2, made.journal.read_batch(name, 1))
    _same(made.historical().collect(), first)
    assert made.add(parts[2], 2)
    _same(made.historical().collect(), A.historical_statistics(parts[0].union(parts[2]), ["a", "b", "empty"]).collect())


def test_only_the_buckets_of_the_ranks_are_read(spark, made):
    rows = spark.range(200_000).select((F.rand(5) * 1000 + 1).alias("a"))
    made.add(rows.where("a < 400"), 1)
    made.add(rows.where("a >= 400"), 2)
    places = made._places({"q25": 0.25, "median": 0.5})
    read = made.bracket_values(places)
    assert read.agg(F.sum("n")).first()[0] < 4000
    plan = read._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "/values" in line)
    assert "PushedFilters" in scan and "bucket" in scan.split("PushedFilters")[1]
    want = A.quantiles(rows, ["a"], {"q25": 0.25, "median": 0.5}).first()
    assert made.quantiles({"q25": 0.25, "median": 0.5}).first() == want


def test_a_full_bucket_is_ranked_in_blocks(spark, made, monkeypatch, parts):
    monkeypatch.setattr(H, "SMALL_COUNT", 0)
    made.add(parts[0], 1)
    _same(made.historical().collect(), A.historical_statistics(parts[0], ["a", "b", "empty"]).collect())


def test_buckets_rise_with_the_values(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf]
    values += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(500)]
    near = rng.random() * 2.0**10
    for _ in range(500):
        near = math.nextafter(near, math.inf)
        values.append(near)
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", H.value_bucket(F.col("v")).alias("k")).collect()
    order = [r.k for r in sorted(got, key=lambda r: r.v)]
    assert order == sorted(order)
    assert {r.k for r in got if r.v == 0} == {0}


def test_empty_history_and_nan(spark, made):
    made.add(spark.createDataFrame([], ROWS), 1)
    assert [(r.feature, r.mean, r.median) for r in made.historical().orderBy("feature").collect()] == [(c, None, None) for c in ("a", "b", "empty")]
    assert made.modes().count() == 0 and made.fill_values().medians == {}
    nan = spark.createDataFrame([(1.0,), (math.nan,), (3.0,)], "a double")  # the other columns are absent
    made.add(nan, 2)
    assert made.quantiles({"median": 0.5}).collect() == [("a", 2.0)]
    assert math.isnan(made.moments().where("feature = 'a'").first()["mean"])


def test_imports_keep_the_statistics(spark):
    root = scratch_path(spark, "imports")
    apps, preds = Table(spark, f"{root}/apps"), Table(spark, f"{root}/preds")
    made = H.HistoryStatistics(spark, f"{root}/statistics", ["person_age"], ["loan_grade"])
    for ages in ([20, 30], [40, 50, 60], []):
        rows = spark.createDataFrame([(float(a), "a", 1) for a in ages], "person_age double, loan_grade string, loan_status int")
        assert P.import_into(rows, apps, preds, ["person_age"], statistics=made) == len(ages)
    assert made.quantiles({"median": 0.5}).first()["median"] == 40.0
    assert made.journal.entries().count() == 2
