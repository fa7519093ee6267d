"""Queries for readers, writers and stored tables."""

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schema as S
from loanlens.catalog import views as W
from loanlens.catalog.registry import query
from loanlens.functions.risk import probability_percent
from loanlens.operators import mapping as M
from loanlens.operators import reports as R
from loanlens.operators.validate import drop_blank_rows as drop_blanks
from loanlens.plans import imports as P
from loanlens.plans.train import extract_training_data
from loanlens.session import materialize, scratch_path
from loanlens.sources import files, tables

NOW = datetime(2025, 1, 1)
RAW_COLUMNS = """application_id, person_age, person_income, person_emp_length, loan_amnt, loan_int_rate,
    loan_percent_income, cb_person_cred_hist_length, home_ownership AS person_home_ownership, loan_intent, loan_grade,
    default_on_file AS cb_person_default_on_file, loan_status"""
RAW_SCHEMA = T.StructType([
    T.StructField("application_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in S.NUMERIC],
    T.StructField("loan_status", T.IntegerType()),
])


def _csv(spark, sf_dir):
    return files.export_csv(W.raw_dataset(spark, sf_dir), scratch_path(spark, "csv"))


@query(f"SELECT {RAW_COLUMNS} FROM apps", "apps")
def read_applications_csv(spark, sf_dir):
    """Applications written as CSV and read back with stated types and required columns."""
    read = files.read_applications_csv(spark, _csv(spark, sf_dir), RAW_SCHEMA, ["person_income", "loan_amnt"])
    return read.where(F.col(files.CORRUPT).isNull()).drop(files.CORRUPT)


@query(f"SELECT {RAW_COLUMNS} FROM apps", "apps")
def read_csv_chunked(spark, sf_dir):
    """The same file with types inferred from the whole input, read in splits."""
    read = files.read_applications_csv(spark, _csv(spark, sf_dir))
    return read.withColumn("application_id", F.col("application_id").cast("bigint"))


@query("""SELECT application_id, CASE WHEN application_id % 3 < 2 THEN person_age END AS person_age, person_income, loan_amnt, home_ownership,
            loan_grade, default_on_file, loan_status FROM apps""", "apps")
def read_csv_layouts(spark, sf_dir):
    """Uploads with three headers (other order, other names, a column less) as one table."""
    apps, folder = W.applications(spark, sf_dir), scratch_path(spark, "uploads")
    columns = ["application_id", *HISTORY_ALIASES, "loan_grade"]
    apps = apps.select(*columns)
    layouts = [apps.select(*reversed(columns)), apps.withColumnsRenamed(HISTORY_ALIASES), apps.drop("person_age")]
    for i, rows in enumerate(layouts):
        rows.where(F.col("application_id") % 3 == i).write.option("header", True).mode("append").csv(folder)
    return files.read_applications_csv(spark, folder, names=files.canonical_names).withColumn("application_id", F.col("application_id").cast("bigint"))


@query("""SELECT application_id, person_income, person_emp_length, loan_amnt FROM apps
          WHERE person_income IS NOT NULL OR person_emp_length IS NOT NULL OR loan_amnt IS NOT NULL""", "apps")
def drop_blank_rows(spark, sf_dir):
    cells = ["person_income", "person_emp_length", "loan_amnt"]
    return drop_blanks(W.applications(spark, sf_dir).select("application_id", *cells), cells)


@query("""SELECT person_age, person_income, person_emp_length, loan_amnt, loan_int_rate, loan_percent_income,
                 cb_person_cred_hist_length, home_ownership, loan_intent, loan_grade, default_on_file FROM apps""", "apps")
def read_applications_json(spark, sf_dir):
    """Batches of partial applications, one JSON array per line."""
    item = F.to_json(F.struct(*S.CANONICAL))
    batches = W.applications(spark, sf_dir).groupBy(F.floor(F.col("application_id") / 100)).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value")
    )
    path = scratch_path(spark, "json")
    batches.select("value").write.text(path)
    return files.read_applications_json(spark, path, multi_line=False)


@query("""SELECT provider, model, endpoint, success, tokens FROM reqlog WHERE tokens % 10 <> 0""", "reqlog")
def read_request_log(spark, sf_dir):
    """A JSON-lines log in which a tenth of the lines is cut off."""
    log = W.request_log(spark, sf_dir)
    line = F.to_json(F.struct("provider", "model", "endpoint", "success", "tokens"))
    path = scratch_path(spark, "log")
    log.select(F.when(F.col("tokens") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return files.read_request_log(spark, path).select("provider", "model", "endpoint", "success", "tokens")


@query("SELECT * FROM orders")
def scan_table(spark, sf_dir):
    return W.table(spark, sf_dir, "orders")


@query("SELECT id, person_age, loan_amnt, application_status FROM stored_apps ORDER BY id LIMIT 5", "stored_apps")
def sample_rows(spark, sf_dir):
    rows = W.stored_applications(spark, sf_dir, ["id", "person_age", "loan_amnt", "application_status"])
    return R.first_rows(rows, ["id"], 5)


@query("SELECT * FROM supplier")
def export_table_csv(spark, sf_dir):
    """A table written as CSV, read back with its own types."""
    source = W.table(spark, sf_dir, "supplier")
    path = files.export_csv(source, scratch_path(spark, "export"))
    return files.read_applications_csv(spark, path, source.schema).drop(files.CORRUPT)


def _feedback_rows(spark, sf_dir):
    """Predictions as the import writes them, one per application."""
    apps = W.applications(spark, sf_dir)
    packed = M.pack_features(apps, S.CANONICAL)
    return packed.select(
        F.col("application_id").alias("id"), "input_features", F.col("loan_status").alias("actual_outcome"), "created_at"
    )


@query("""SELECT loan_status, count(*) AS n, count(person_income) AS incomes, count(loan_intent) AS intents
          FROM apps WHERE loan_status IS NOT NULL GROUP BY loan_status""", "apps")
def export_training_csv(spark, sf_dir):
    """Training rows written as CSV; counted after reading them back."""
    rows = extract_training_data(_feedback_rows(spark, sf_dir)).withColumnRenamed("loan_status", "outcome")
    path = files.export_training_csv(rows, "outcome", scratch_path(spark, "training-csv"))
    return files.read_applications_csv(spark, path).groupBy("loan_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("person_income").alias("incomes"), F.count("loan_intent").alias("intents")
    )


@query("""SELECT id + 1 AS "Row",
            CASE WHEN ok THEN risk_level ELSE 'N/A' END AS "Risk Level",
            CASE WHEN ok THEN CAST(round(probability_default * 100, 2) AS VARCHAR) ELSE 'N/A' END AS "Probability %",
            CASE WHEN ok THEN CAST(binary_prediction AS VARCHAR) ELSE 'N/A' END AS "Prediction",
            CASE WHEN ok THEN 'success' ELSE 'error' END AS "Status"
          FROM (SELECT *, model_type <> 'error' AS ok FROM preds)""", "preds")
def export_batch_results(spark, sf_dir):
    ok = F.col("model_type") != "error"
    rows = W.predictions(spark, sf_dir).select(
        F.col("id").alias("row_index"), F.when(ok, F.col("risk_level")).alias("risk_level"),
        F.when(ok, probability_percent(F.col("probability_default"))).alias("probability_default_percent"),
        F.when(ok, F.col("binary_prediction")).alias("binary_prediction"),
        F.when(ok, "success").otherwise("error").alias("status"),
    )
    return files.batch_result_rows(rows)


_KEPT = ["id", *[c for c in S.CANONICAL if c != "person_age"], "loan_status"]


@query(f"""SELECT {", ".join(_KEPT)},
            CASE WHEN id % 2 = 1 THEN person_age END AS credit_score,
            CASE WHEN id % 2 = 1 THEN 'approved' ELSE application_status END AS application_status
          FROM stored_apps""", "stored_apps")
def insert_applications(spark, sf_dir):
    """Half of the applications appended to a stored table that lacks one of their columns."""
    apps = W.stored_applications(spark, sf_dir, [*_KEPT, "application_status", "person_age"])
    store = tables.Table(spark, scratch_path(spark, "applications"))
    store.append(apps.where("id % 2 = 0").drop("person_age"))
    incoming = apps.where("id % 2 = 1").withColumnRenamed("person_age", "credit_score")
    incoming = incoming.withColumn("application_status", F.lit("approved"))
    empty = store.read().limit(0)
    store.append(M.evolve_schema(empty, incoming))
    return store.read()


@query("""SELECT id, risk_level, actual_outcome, TIMESTAMP '2025-01-01' AS created_at,
            CASE WHEN actual_outcome IS NOT NULL THEN TIMESTAMP '2025-01-01' END AS feedback_date FROM preds""", "preds")
def insert_predictions(spark, sf_dir):
    """Scored rows appended in two batches with their timestamps."""
    rows = W.predictions(spark, sf_dir).select("id", "risk_level", "actual_outcome")
    store = tables.Table(spark, scratch_path(spark, "predictions"))
    for part in (0, 1):
        store.append(tables.insert_predictions(rows.where(F.col("id") % 2 == part), NOW))
    return store.read()


HISTORY_ALIASES = {
    "person_age": "Age", "person_income": "annual-income", "loan_amnt": "loan.amount", "home_ownership": "Home",
    "default_on_file": "default history", "loan_status": "loan_status",
}


@query(f"""SELECT row_number() OVER (ORDER BY application_id) AS application_id, application_id AS source_id,
            {", ".join(S.CANONICAL)}, actual_outcome, COALESCE(actual_outcome, 0) AS binary_prediction,
            'Historical' AS risk_level, CAST(0 AS DOUBLE) AS probability_default, 'historical_import' AS model_type,
            CASE WHEN actual_outcome IS NOT NULL THEN TIMESTAMP '2025-01-01' END AS feedback_date,
            'approved' AS application_status
          FROM (SELECT *, loan_status AS actual_outcome FROM apps)""", "apps")
def import_history(spark, sf_dir):
    """A history file with foreign headers, as linked application and prediction rows."""
    columns = ["application_id", *S.CANONICAL, "loan_status"]
    source = W.applications(spark, sf_dir).select(*columns).withColumnsRenamed(HISTORY_ALIASES)
    apps, preds = P.import_history(source, ["application_id"], now=NOW)
    features = T.StructType([T.StructField("application_id", T.LongType()), *S.APPLICATION_SCHEMA.fields])
    preds = preds.withColumn("f", F.from_json("input_features", features)).select(
        "application_id", F.col("f.application_id").alias("source_id"), *[f"f.{c}" for c in S.CANONICAL],
        "actual_outcome", "binary_prediction", "risk_level", "probability_default", "model_type", "feedback_date",
    )
    return preds.join(apps.select(F.col("id").alias("application_id"), "application_status"), "application_id")


@query(f"""SELECT {", ".join(S.CANONICAL)}, 'Unknown' AS risk_level,
            CAST(0.5 AS DOUBLE) AS probability_default, COALESCE(loan_status, 0) AS binary_prediction,
            'imported_data' AS model_type, loan_status AS actual_outcome,
            CAST((person_age IS NOT NULL)::INT + (person_income IS NOT NULL)::INT + (person_emp_length IS NOT NULL)::INT
              + (loan_amnt IS NOT NULL)::INT + (loan_int_rate IS NOT NULL)::INT + (loan_percent_income IS NOT NULL)::INT
              + (cb_person_cred_hist_length IS NOT NULL)::INT + (home_ownership IS NOT NULL)::INT
              + (loan_intent IS NOT NULL)::INT + (loan_grade IS NOT NULL)::INT + (default_on_file IS NOT NULL)::INT
              AS INTEGER) AS features
          FROM apps""", "apps")
def import_history_minimal(spark, sf_dir):
    rows = P.import_history_minimal(W.raw_dataset(spark, sf_dir))
    return rows.withColumns({
        "f": F.from_json("input_features", S.APPLICATION_SCHEMA), "features": F.size(F.json_object_keys("input_features")),
    }).select(
        "f.*", "risk_level", "probability_default", "binary_prediction", "model_type", "actual_outcome", "features"
    )


@query("SELECT model_type, model_version, total_predictions, correct_predictions, evaluation_date FROM metrics", "metrics")
def insert_metrics(spark, sf_dir):
    rows = W.model_metrics(spark, sf_dir).select(
        "model_type", "model_version", "total_predictions", "correct_predictions", "evaluation_date"
    )
    store = tables.Table(spark, scratch_path(spark, "metrics"))
    store.append(rows.where("model_type = 'error'"))
    store.append(rows.where("model_type <> 'error'"))
    return store.read()


@query("""SELECT 'predictions' AS table_name, count(*) AS deleted, CAST(0 AS BIGINT) AS rows_left FROM events
          UNION ALL SELECT 'loan_applications', count(*), 0 FROM orders
          UNION ALL SELECT 'model_metrics', count(*), 0 FROM metrics
          UNION ALL SELECT 'total_deleted', (SELECT count(*) FROM events) + (SELECT count(*) FROM orders)
            + (SELECT count(*) FROM metrics), NULL""", "metrics")
def clear_tables(spark, sf_dir):
    """Three stored tables, emptied: deleted rows of each and in total, and what is left."""
    contents = {
        "predictions": W.predictions(spark, sf_dir).select("id", "risk_level"),
        "loan_applications": W.stored_applications(spark, sf_dir, ["id", "application_status"]),
        "model_metrics": W.model_metrics(spark, sf_dir),
    }
    stores = {}
    for name, rows in contents.items():
        stores[name] = tables.Table(spark, scratch_path(spark, name))
        stores[name].append(rows)
    deleted = tables.clear_tables(stores, confirm=True)
    left = {name: t.read().count() for name, t in stores.items()}
    return spark.createDataFrame(
        [(k, v, left.get(k)) for k, v in deleted.items()], "table_name string, deleted bigint, rows_left bigint"
    )


@query("""SELECT model_type, model_version AS version, evaluation_date AS timestamp FROM (
            SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY evaluation_date DESC, model_version DESC) AS rn
            FROM metrics) WHERE rn = 1""", "metrics")
def latest_model(spark, sf_dir):
    """The active manifest entry of each model type."""
    manifest = W.model_metrics(spark, sf_dir).select(
        "model_type", F.col("model_version").alias("version"), F.col("evaluation_date").alias("timestamp")
    )
    return tables.latest_versions(manifest)
