"""Uploads with headers of their own."""

import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.sources import files


@pytest.fixture
def uploads(tmp_path):
    def write(name, text):
        path = tmp_path / name
        (gzip.open(path, "wt") if name.endswith(".gz") else open(path, "w")).write(text)
        return str(tmp_path)

    return write


def test_two_hundred_files_of_three_layouts(spark, uploads):
    heads = ["row,Age,loan.amount,Home", "Home,row,person_age,loan_amnt", "row,annual-income,home"]
    for i in range(200):
        cells = {"row": i, "Age": i + 0.5, "person_age": i + 0.5, "loan.amount": 10 * i, "loan_amnt": 10 * i, "Home": f"h{i}", "home": f"h{i}", "annual-income": 7 * i}
        head = heads[i % 3]
        folder = uploads(f"f{i:03d}.csv", head + "\n" + ",".join(str(cells[c]) for c in head.split(",")) + "\n")
    rows = files.read_applications_csv(spark, folder, names=files.canonical_names)
    assert set(rows.columns) == {"row", "person_age", "loan_amnt", "home_ownership", "person_income"}
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 3
    got = {r.row: (r.person_age, r.loan_amnt, r.home_ownership, r.person_income) for r in rows.collect()}
    assert got == {i: (i + 0.5, 10 * i, f"h{i}", None) if i % 3 < 2 else (None, None, f"h{i}", 7 * i) for i in range(200)}


def test_odd_headers_and_files(spark, uploads):
    uploads("a.csv", '\ufeff"x, y",b\n1,"two\nlines"\n'.replace("two\nlines", "two lines"))
    uploads("b.csv.gz", 'b,"x, y"\nq,2.5\n')
    uploads("empty.csv", "")
    folder = uploads("only_header.csv", "b,c\n")
    assert set(files.csv_layouts(spark, folder)) == {("x, y", "b"), ("b", "x, y"), ("b", "c")}
    rows = files.read_applications_csv(spark, folder)
    assert {(r["x, y"], r["b"], r["c"]) for r in rows.collect()} == {(1.0, "two lines", None), (2.5, "q", None)}


def test_two_columns_under_one_name_are_coalesced(spark, uploads):
    folder = uploads("a.csv", "income,annual_income\n1,2\n,3\n")
    assert sorted(r.person_income for r in files.read_applications_csv(spark, folder, names=files.canonical_names).collect()) == [1, 3]


def test_refused_headers(spark, uploads, tmp_path):
    with pytest.raises(ValueError, match="no CSV file"):
        files.read_applications_csv(spark, uploads("e.csv", ""))
    uploads("e.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns .'b'. in .*f.csv"):
        files.read_applications_csv(spark, uploads("f.csv", "a,c\n1,2\n"), required=["b"])
    with pytest.raises(ValueError, match="twice"):
        files.csv_layouts(spark, uploads("g.csv", "a,a\n1,2\n"))


def test_types_and_corrupt_lines_over_layouts(spark, uploads):
    uploads("a.csv", "n,t\n1,x\noops,y\n")
    folder = uploads("b.csv", "t,n\nz,2.5\n")
    schema = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("t", T.StringType())])
    rows = files.read_applications_csv(spark, folder, schema).cache()
    assert {(r.n, r.t) for r in rows.where(F.col(files.CORRUPT).isNull()).collect()} == {(1.0, "x"), (2.5, "z")}
    assert [r[files.CORRUPT] for r in rows.where(F.col(files.CORRUPT).isNotNull()).collect()] == ["oops,y"]
    plain = files.read_applications_csv(spark, folder)
    assert dict(plain.dtypes) == {"n": "string", "t": "string"} and os.path.isdir(folder)
