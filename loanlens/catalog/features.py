"""Queries for encoding, scaling, targets and splits."""

from pyspark.sql import functions as F

from loanlens import schema as S
from loanlens.catalog import views as W
from loanlens.catalog.io import _feedback_rows
from loanlens.catalog.registry import query, r6
from loanlens.operators import encode as E
from loanlens.operators import split as P
from loanlens.operators.impute import uppercase_categoricals
from loanlens.plans import imports
from loanlens.plans import train as T


def _flag_sql(c: str, v: str) -> str:
    return f"CAST(COALESCE({c} = '{v}', FALSE) AS INTEGER) AS \"{S.encoded_name(c, v)}\""


_ALL_FLAGS = ", ".join(_flag_sql(c, v) for c, vs in S.VOCABULARY.items() for v in vs)


@query(f"SELECT application_id, {_ALL_FLAGS} FROM upper_apps", "upper_apps")
def one_hot_fixed(spark, sf_dir):
    rows = E.one_hot_fixed(uppercase_categoricals(W.applications(spark, sf_dir)))
    return rows.select("application_id", *E.fixed_flags())


_MODEL = S.model_features()
_BY_NAME = {S.encoded_name(c, v): (c, v) for c, vs in S.VOCABULARY.items() for v in vs}


@query("SELECT application_id, " + ", ".join(
    f"CAST(COALESCE({_BY_NAME[f][0]} = '{_BY_NAME[f][1]}', FALSE) AS DOUBLE) AS \"{f}\"" if f in _BY_NAME
    else f"round({f}, 6) AS {f}" for f in _MODEL) + " FROM imputed", "imputed")
def align_features(spark, sf_dir):
    """Imputed rows as exactly the model's 22 features, in order."""
    encoded = E.align_features(E.one_hot_fixed(W.imputed(spark, sf_dir)), _MODEL, ["application_id"])
    return encoded.select("application_id", *[r6(f).alias(f) for f in _MODEL])


@query("""SELECT ignored_features, count(*) AS n FROM (
    SELECT CAST((home_ownership = 'MORTGAGE')::INT + (loan_intent = 'DEBTCONSOLIDATION')::INT + (loan_grade = 'A')::INT
      + (default_on_file = 'N')::INT AS INTEGER) AS ignored_features FROM imputed) GROUP BY 1""", "imputed")
def ignored_features(spark, sf_dir):
    """Rows by how many of their categories the model has no column for."""
    rows = W.imputed(spark, sf_dir).select(E.ignored_feature_count(_MODEL).alias("ignored_features"))
    return rows.groupBy("ignored_features").agg(F.count(F.lit(1)).alias("n"))


_PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("SELECT p_partkey, " + ", ".join(
    f"CAST(p_type = '{v}' AS INTEGER) AS \"p_type_{v}\"" for v in _PART_TYPES) + " FROM part")
def one_hot_dynamic(spark, sf_dir):
    rows = W.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return E.one_hot_dynamic(rows, E.categories(rows, ["p_type"]))


@query("SELECT p_partkey, " + ", ".join(
    f"CAST(p_type = '{v}' AS INTEGER) AS \"p_type_{v}\"" for v in _PART_TYPES[1:]) + " FROM part")
def one_hot_drop_first(spark, sf_dir):
    rows = W.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return E.one_hot_dynamic(rows, E.categories(rows, ["p_type"]), drop_first=True)


@query("SELECT p_partkey, " + ", ".join(
    f"CAST(p_type = '{v}' AS INTEGER) AS \"p_type_{v}\"" for v in _PART_TYPES if v != "PROMO") + " FROM part")
def one_hot_ignore_unknown(spark, sf_dir):
    """Categories fitted without one value: its rows get all zeros."""
    rows = W.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    known = E.categories(rows.where("p_type <> 'PROMO'"), ["p_type"])
    return E.one_hot_dynamic(rows, known)


@query("""WITH names AS (SELECT 'b' AS k, p_brand AS v, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'n', p_name, count(*) FROM part GROUP BY ALL
              UNION ALL SELECT 't', p_type, count(*) FROM part GROUP BY ALL),
            places AS (SELECT *, row_number() OVER (ORDER BY k, v) - 1 AS place FROM names)
          SELECT p_partkey, p_size, list_sort([b.place, n.place, t.place])::INTEGER[] AS places,
            (SELECT count(*) FROM places) AS n_places, b.n AS brand_parts
          FROM part JOIN places b ON b.k = 'b' AND b.v = p_brand JOIN places n ON n.k = 'n' AND n.v = p_name JOIN places t ON t.k = 't' AND t.v = p_type""")
def one_hot_sparse(spark, sf_dir):
    """All names, brands and types as flags of one sparse vector; counts read back from the flags."""
    columns = ["p_brand", "p_name", "p_type"]
    rows = W.table(spark, sf_dir, "part").select("p_partkey", "p_size", *columns)
    values = E.categories(rows, columns)
    flags = E.one_hot_sparse(rows, values).withColumn("places", E.set_flags(F.col("flags")))
    brands = flags.groupBy(F.element_at("places", 1).alias("place")).agg(F.count(F.lit(1)).alias("brand_parts"))
    n = sum(len(v) for v in values.values())
    out = flags.join(brands, F.element_at("places", 1) == F.col("place"))
    return out.select("p_partkey", "p_size", "places", F.lit(n).cast("long").alias("n_places"), "brand_parts")


_IN_TEST = "substr(md5(application_id || ':42'), 1, 4) < '3333'"
_SCALED = S.NUMERIC


@query("SELECT application_id, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED) + " FROM imputed, (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED) + f" FROM imputed WHERE NOT {_IN_TEST})", "imputed")
def standardize(spark, sf_dir):
    """Scaled by the mean and population deviation of the training part."""
    rows = W.imputed(spark, sf_dir).select("application_id", *_SCALED)
    scaler = E.Scaler.fit(rows.where(~P.in_test("application_id")), _SCALED)
    return scaler.transform(rows).select("application_id", *[r6(c).alias(c) for c in _SCALED])


@query("""SELECT loan_status, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
          FROM apps WHERE loan_status IS NOT NULL GROUP BY loan_status""", "apps")
def class_balance(spark, sf_dir):
    rows = W.applications(spark, sf_dir, ["loan_status"]).where("loan_status IS NOT NULL")
    return E.class_balance(rows, "loan_status").withColumn("share", r6("share"))


def _detected(spark, df):
    found = E.detect_columns(df)
    rows = [(found["target"], "target")]
    rows += [(c, "numeric") for c in found["numeric"]] + [(c, "categorical") for c in found["categorical"]]
    return spark.createDataFrame(rows, "column_name string, kind string")


_DETECT = ["application_id", "person_age", "cb_person_cred_hist_length", "loan_amnt", "loan_grade"]


@query("SELECT 'loan_status' AS column_name, 'target' AS kind FROM apps HAVING count(*) > 0 UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{c}', CASE WHEN {"TRUE" if c in S.CATEGORICAL else "FALSE"} OR (count(DISTINCT {c}) < 10
        AND count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) < 0.05) THEN 'categorical' ELSE 'numeric' END FROM apps"""
    for c in _DETECT), "apps")
def detect_columns(spark, sf_dir):
    """Kinds of the applications' columns; the target goes by its name."""
    return _detected(spark, W.applications(spark, sf_dir).select(*_DETECT, "loan_status"))


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CASE WHEN '{c}' = 'quality' THEN 'target' WHEN count(DISTINCT {c}) < 10
        AND count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) < 0.05 THEN 'categorical' ELSE 'numeric' END AS kind FROM labels"""
    for c in ("doc_id", "quality", "toxic")))
def detect_columns_binary(spark, sf_dir):
    """No known target name: the first column with two values."""
    return _detected(spark, W.table(spark, sf_dir, "labels"))


@query("""SELECT user_id, event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 0
            WHEN 'signup' THEN 1 ELSE 0 END AS label, event_type = 'error' AS label_unmapped, event_id FROM events""")
def map_target(spark, sf_dir):
    """Outcome words of mixed case to 0/1; unknown words count as 0 and are marked."""
    word = (
        F.when(F.col("event_type") == "view", "No_Default").when(F.col("event_type") == "click", "REJECTED")
        .when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "signup", "Yes").otherwise("??")
    )
    rows = W.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", word.alias("word"))
    return E.map_target(rows, "word").drop("word")


@query("""SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN user_id % 2 WHEN event_id % 4 = 1 THEN 1
            WHEN event_id % 4 = 2 THEN 0 END AS INTEGER) AS actual_outcome FROM events""")
def coerce_outcome(spark, sf_dir):
    """First of the target columns that holds a value."""
    key = F.col("event_id") % 4
    rows = W.table(spark, sf_dir, "events").select(
        "event_id", F.when(key == 0, F.col("user_id") % 2).alias("loan_status"),
        F.when(key == 1, "Yes").when(key == 2, "nope").alias("outcome"),
    )
    return imports.coerce_outcome(rows).select("event_id", "actual_outcome")


@query(f"SELECT application_id, {_IN_TEST} AS is_test FROM apps", "apps")
def split_random(spark, sf_dir):
    return P.split_random(W.applications(spark, sf_dir, ["application_id"]), "application_id")


@query("""SELECT application_id, loan_status, row_number() OVER (PARTITION BY loan_status ORDER BY md5(application_id || ':42'))
            <= ceil(count(*) OVER (PARTITION BY loan_status) * 0.2) AS is_test
          FROM apps WHERE loan_status IS NOT NULL""", "apps")
def split_stratified(spark, sf_dir):
    rows = W.applications(spark, sf_dir, ["application_id", "loan_status"]).where("loan_status IS NOT NULL")
    return P.split_stratified(rows, "application_id", "loan_status")


@query("""SELECT fold, count(*) AS n, CAST(sum(loan_status) AS BIGINT) AS defaults FROM (
            SELECT loan_status, CAST(CAST('0x' || substr(md5(application_id || ':42'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold
            FROM apps WHERE loan_status IS NOT NULL) GROUP BY fold""", "apps")
def kfold_assignment(spark, sf_dir):
    rows = W.applications(spark, sf_dir, ["application_id", "loan_status"]).where("loan_status IS NOT NULL")
    return rows.groupBy(P.fold("application_id").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("loan_status").alias("defaults")
    )


@query(f"""SELECT 'p' || application_id AS row_key, {", ".join(S.CANONICAL)}, loan_status FROM apps WHERE loan_status IS NOT NULL
          UNION ALL SELECT 'o' || application_id, {", ".join(f"upper({c})" if c in S.CATEGORICAL else c for c in S.CANONICAL)}, loan_status
          FROM apps WHERE loan_status IS NOT NULL""", "apps")
def extract_training_data(spark, sf_dir):
    """Feedback rows and the original dataset under one set of columns."""
    original = W.raw_dataset(spark, sf_dir).withColumn("row_key", F.concat(F.lit("o"), F.col("application_id").cast("string")))
    rows = T.extract_training_data(_feedback_rows(spark, sf_dir), original.drop("application_id"))
    return rows.select("row_key", *S.CANONICAL, "loan_status")


@query("""SELECT application_id, CAST(NULL AS VARCHAR) AS raw_only, person_age, loan_amnt FROM apps WHERE application_id % 2 = 0
          UNION ALL SELECT application_id, loan_grade, person_age, NULL FROM apps""", "apps")
def union_training_sources(spark, sf_dir):
    apps = W.applications(spark, sf_dir)
    feedback = apps.where("application_id % 2 = 0").select("application_id", "person_age", "loan_amnt")
    original = apps.select("application_id", "person_age", F.col("loan_grade").alias("raw_only"))
    return T.union_training_sources(feedback, original)


#: The values that the categorical columns of the given tables hold.
_HELD = {
    "home_ownership": ("MORTGAGE", "OTHER", "OWN", "RENT", "UNKNOWN"),
    "loan_intent": ("DEBTCONSOLIDATION", "EDUCATION", "HOMEIMPROVEMENT", "MEDICAL", "PERSONAL", "UNKNOWN", "VENTURE"),
    "loan_grade": ("A", "B", "C", "D", "E"), "default_on_file": ("N", "UNKNOWN", "Y"),
}


@query("SELECT application_id, " + ", ".join(f"round(COALESCE({c}, m_{c}), 6) AS {c}" for c in S.NUMERIC) + ", " + ", ".join(
    f"CAST(upper(COALESCE({c}, 'UNKNOWN')) = '{v}' AS INTEGER) AS \"{c}_{v}\"" for c, held in _HELD.items() for v in held)
    + " FROM upper_apps, fills", "upper_apps fills")
def prepare_features(spark, sf_dir):
    rows = W.applications(spark, sf_dir, ["application_id", *S.CANONICAL, "loan_status"])
    prepared, _ = T.prepare_features(rows, ["application_id"])
    return prepared.withColumns({c: r6(c) for c in S.NUMERIC})
