"""Queries for training, scoring, explanation and streaming."""

from datetime import datetime
from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schema as S
from loanlens.catalog import views as W
from loanlens.catalog.io import HISTORY_ALIASES, _feedback_rows
from loanlens.catalog.registry import query, r6
from loanlens.functions import text as X
from loanlens.functions.risk import risk_tier
from loanlens.operators import encode as E
from loanlens.operators import explain
from loanlens.operators.split import in_test
from loanlens.plans import score as P
from loanlens.plans import train as M
from loanlens.session import in_even_parts, materialize, outgrows_cores, scratch_path
from loanlens.sources import tables
from loanlens.streaming import jobs
from loanlens.streaming.journal import Journal

FEATURES = S.model_features()
NOW = datetime(2025, 1, 1)


def _encoded(spark, sf_dir):
    rows = W.imputed(spark, sf_dir, written=True)
    return E.encode_for_model(rows, FEATURES, ["application_id", "loan_status"]).where("loan_status IS NOT NULL")


@lru_cache(maxsize=8)
def _trained(app_id, spark, sf_dir):
    # read by the scaler and by the trees, encoded once
    train = materialize(_encoded(spark, sf_dir).where(~in_test("application_id")), "training")
    return M.fit_boosted_trees(train, FEATURES, "loan_status")


@lru_cache(maxsize=8)
def _scorer(app_id, spark, sf_dir):
    return P.Scorer(_trained(app_id, spark, sf_dir), FEATURES, W.fill_values(spark, sf_dir), "v1")


def scorer(spark, sf_dir) -> P.Scorer:
    """A model fitted once per session and data set."""
    return _scorer(spark.sparkContext.applicationId, spark, sf_dir)


def _metric_rows(spark, metrics: dict):
    return spark.createDataFrame([(k, float(v)) for k, v in metrics.items() if v is not None], "metric string, value double")


@query()
def train_boosted_trees(spark, sf_dir):
    """Test metrics of boosted trees on the applications."""
    test = _encoded(spark, sf_dir).where(in_test("application_id"))
    return _metric_rows(spark, M.evaluate_model(scorer(spark, sf_dir).model.transform(test), "loan_status"))


def _forest():
    return M.forest_pipeline(S.NUMERIC, S.CATEGORICAL, "loan_status")


@query()
def train_random_forest(spark, sf_dir):
    rows = W.imputed(spark, sf_dir).where("loan_status IS NOT NULL").select("application_id", *S.CANONICAL, "loan_status")
    train = rows.where(~in_test("application_id"))
    if outgrows_cores(train):  # a forest keeps a count per tree and row, so a task's memory follows its rows
        train = in_even_parts(materialize(train, "training"))
    model = _forest().fit(train)
    return _metric_rows(spark, M.evaluate_model(model.transform(rows.where(in_test("application_id"))), "loan_status"))


@query()
def kfold_cv(spark, sf_dir):
    """Accuracy of the forest per fold and on average."""
    rows = W.imputed(spark, sf_dir).where("loan_status IS NOT NULL").select("application_id", *S.CANONICAL, "loan_status")
    scores, mean = M.kfold_cv(rows, _forest(), "application_id", "loan_status")
    return _metric_rows(spark, {**{f"fold_{i}": s for i, s in enumerate(scores)}, "mean": mean})


@query()
def train_flexible(spark, sf_dir):
    """Training on a frame of unknown columns."""
    rows = W.applications(spark, sf_dir).where("loan_status IS NOT NULL").select("application_id", *S.CANONICAL, "loan_status")
    result = M.train_flexible(rows, "application_id")
    return _metric_rows(spark, {**result.metrics, "n_features": len(result.features), "n_train": result.train_rows})


@query()
def retrain(spark, sf_dir):
    """Retraining from feedback with a saved, versioned model; the stored metrics row."""
    store = tables.ModelStore(spark, scratch_path(spark, "models"))
    M.retrain(_feedback_rows(spark, sf_dir), store=store)
    return store.metrics.read()


@query()
def score(spark, sf_dir):
    scored = P.score(_encoded(spark, sf_dir), scorer(spark, sf_dir).model)
    return scored.select("application_id", "probability_default", "binary_prediction")


@query()
def score_batch(spark, sf_dir):
    """The whole path from raw applications to tiers, notes and per-row status."""
    rows = P.score_batch(W.written_applications(spark, sf_dir), scorer(spark, sf_dir))
    return rows.select(
        "application_id", "status", "error", "risk_level", "probability_default_percent", "binary_prediction",
        F.size("imputation_log").alias("imputed_fields"), "operational_notes",
    )


@query("""SELECT CASE WHEN person_age > 100 OR person_age < 18 OR loan_percent_income > 1 OR loan_amnt < 0 THEN 'error'
            ELSE 'success' END AS status, count(*) AS n, count(loan_amnt) AS amounts FROM apps GROUP BY 1""", "apps")
def score_batch_status(spark, sf_dir):
    """How many rows were scored and how many set aside."""
    rows = P.score_batch(W.written_applications(spark, sf_dir), scorer(spark, sf_dir))
    amounts = W.applications(spark, sf_dir, ["application_id", "loan_amnt"])
    return rows.select("application_id", "status").join(amounts, "application_id").groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count("loan_amnt").alias("amounts")
    )


@query()
def score_batch_strict(spark, sf_dir):
    rows = P.score_batch(W.written_applications(spark, sf_dir), scorer(spark, sf_dir), mode="strict")
    return rows.select("application_id", "status", "error", "risk_level", "probability_default_percent")


@query("""SELECT TRUE AS tiers_match, count(*) AS n FROM apps WHERE person_age BETWEEN 18 AND 100
            AND person_income IS NOT NULL AND person_emp_length IS NOT NULL AND loan_amnt IS NOT NULL
            AND loan_int_rate IS NOT NULL AND loan_percent_income <= 1 AND cb_person_cred_hist_length IS NOT NULL
            AND home_ownership IS NOT NULL AND loan_intent IS NOT NULL AND loan_grade IS NOT NULL
            AND default_on_file IS NOT NULL""", "apps")
def compare_paths(spark, sf_dir):
    """Complete records by both modes: rows by whether the tiers agree."""
    both = P.compare_paths(W.written_applications(spark, sf_dir), scorer(spark, sf_dir))
    return both.groupBy("tiers_match").agg(F.count(F.lit(1)).alias("n"))


@query()
def shap_values(spark, sf_dir):
    """Per application: sum of contributions plus base, and the model's own log-odds."""
    fitted = scorer(spark, sf_dir)
    rows = P.score(_encoded(spark, sf_dir), fitted.model)
    explained = fitted.explainer(spark).explain(rows, FEATURES)
    total = F.aggregate(F.map_values("shap_values"), F.col("expected_value"), lambda a, v: a + v)
    odds = F.log(F.col("probability_default") / (1 - F.col("probability_default")))
    return explained.select("application_id", r6(total).alias("explained_log_odds"), r6(odds).alias("model_log_odds"))


@query("SELECT application_id, TRUE AS adds_up, 22 AS features FROM apps WHERE loan_status IS NOT NULL", "apps")
def shap_additivity(spark, sf_dir):
    """Contributions plus base equal the model's log-odds in every row."""
    rows = shap_values(spark, sf_dir)
    close = F.abs(F.col("explained_log_odds") - F.col("model_log_odds")) < 1e-5
    return rows.select("application_id", close.alias("adds_up"), F.lit(len(FEATURES)).alias("features"))


@query("""SELECT application_id, TRUE AS in_range, TRUE AS label_follows, TRUE AS tier_follows FROM apps
          WHERE loan_status IS NOT NULL""", "apps")
def score_invariants(spark, sf_dir):
    """Scores lie in [0, 1]; label and tier follow from them."""
    p = F.col("probability_default")
    tier = F.when(p > 0.6, S.HIGH_RISK).when(p > 0.4, S.BORDERLINE_RISK).otherwise(S.LOW_RISK)
    return score(spark, sf_dir).select(
        "application_id", p.between(0, 1).alias("in_range"),
        ((p > 0.5).cast("int") == F.col("binary_prediction")).alias("label_follows"),
        (risk_tier(p) == tier).alias("tier_follows"),
    )


@query("""SELECT a.application_id, CASE WHEN a.person_age < 18 OR a.person_age > 100 OR COALESCE(a.loan_percent_income > 1, FALSE)
            THEN 'error' ELSE 'success' END AS status, CAST(len(i.imputation_log) AS INTEGER) AS imputed_fields
          FROM apps a JOIN imputed i ON i.application_id = a.application_id""", "imputed")
def score_batch_rows(spark, sf_dir):
    """The model-independent columns of batch scoring."""
    rows = P.score_batch(W.written_applications(spark, sf_dir), scorer(spark, sf_dir))
    return rows.select("application_id", "status", F.size("imputation_log").alias("imputed_fields"))


def _explained(spark, sf_dir):
    """Every labelled application with the model's own contributions of all features."""
    fitted = scorer(spark, sf_dir)
    rows = W.imputed(spark, sf_dir, written=True).where("loan_status IS NOT NULL").withColumn("applicant", F.struct(*S.CANONICAL))
    encoded = E.encode_for_model(rows, FEATURES, ["application_id", "applicant"])
    return fitted.explainer(spark).explain(P.score(encoded, fitted.model), FEATURES)


def _sizes():
    return F.transform(F.map_values("shap_values"), lambda v: F.abs(v))


@query("""SELECT application_id, unnest(range(1, 6))::INTEGER AS place, TRUE AS of_model, TRUE AS as_explained, TRUE AS in_place FROM apps
          WHERE loan_status IS NOT NULL""", "apps")
def top_contributors(spark, sf_dir):
    """The five strongest contributions, with checks: a feature of the model, its own value, and as many stronger ones as its place says."""
    rows = _explained(spark, sf_dir)
    top = rows.select("application_id", "shap_values", F.posexplode(explain.top_contributors(F.col("shap_values"), 5)).alias("at", "e"))
    size = F.abs("e.value")
    before = F.filter(
        F.map_entries("shap_values"), lambda x: (F.abs(x["value"]) > size) | ((F.abs(x["value"]) == size) & (x["key"] < F.col("e.feature")))
    )
    return top.select(
        "application_id", (F.col("at") + 1).alias("place"), F.col("e.feature").isin(FEATURES).alias("of_model"),
        (F.element_at("shap_values", F.col("e.feature")) == F.col("e.value")).alias("as_explained"), (F.size(before) == F.col("at")).alias("in_place"),
    )


@query("SELECT application_id, 22 AS features, TRUE AS adds_up, TRUE AS top_adds_up, TRUE AS greatest FROM apps WHERE loan_status IS NOT NULL", "apps")
def contribution_totals(spark, sf_dir):
    """Totals over all features make the model's log-odds; those over the six strongest hold the six largest sizes."""
    rows = _explained(spark, sf_dir)
    p = F.col("probability_default")
    odds = F.log(p / (1 - p))
    largest = F.slice(F.sort_array(_sizes(), asc=False), 1, 6)
    # sorted once for all totals over them
    entries = {name: explain.top_contributors(F.col("shap_values"), k) for name, k in (("all", len(FEATURES)), ("strongest", 6))}
    rows = rows.select("application_id", F.size("shap_values").alias("features"), "expected_value", odds.alias("odds"), largest.alias("largest"), *[e.alias(c) for c, e in entries.items()])
    six = F.aggregate("largest", F.lit(0.0), lambda a, v: a + v)
    every, top = (explain.contribution_totals(F.col(c)) for c in entries)
    out = rows.select("application_id", "features", "expected_value", "odds", "largest", six.alias("six"), every.alias("every"), top.alias("top"))
    return out.select(
        "application_id", "features", (F.abs(F.col("every.positive") - F.col("every.negative") + F.col("expected_value") - F.col("odds")) < 1e-5).alias("adds_up"),
        (F.abs(F.col("top.positive") + F.col("top.negative") - F.col("six")) < 1e-9).alias("top_adds_up"),
        ((F.col("top.max_abs") == F.element_at("largest", 1)) & (F.col("every.max_abs") == F.col("top.max_abs"))).alias("greatest"),
    )


_APPLICANT_SQL = " || ', ' || ".join(
    f"'{c}: ' || " + (f"CAST(CAST(floor({c} * 100) / 100 AS DECIMAL(18, 2)) AS VARCHAR)" if c in S.NUMERIC else c) for c in S.CANONICAL
)


@query(f"""SELECT application_id, 'Explain this loan decision to the applicant in one short paragraph.' AS request, TRUE AS decided, TRUE AS strongest,
             {_APPLICANT_SQL} AS applicant FROM imputed WHERE loan_status IS NOT NULL""", "imputed")
def explanation_prompt(spark, sf_dir):
    """The parts of the request text: decision by the score, the five strongest features, the whole applicant record. No call is made."""
    rows = _explained(spark, sf_dir)
    fields = [
        F.concat(F.lit(f"{c}: "), ((F.floor(F.col(f"applicant.{c}") * 100) / 100).cast("decimal(18,2)") if c in S.NUMERIC else F.col(f"applicant.{c}")).cast("string")) for c in S.CANONICAL
    ]
    names = F.array_join(F.transform(explain.top_contributors(F.col("shap_values"), 5), lambda e: e["feature"]), ", ")
    tier = risk_tier(F.col("probability_default"))
    prompt = X.explanation_prompt(tier, names, F.concat_ws(", ", *fields))
    lines = rows.select("application_id", tier.alias("tier"), "shap_values", F.split(prompt, "\n").alias("line"))
    sizes = F.sort_array(_sizes(), asc=False)
    told = F.split(F.regexp_replace(F.element_at("line", 3), "^Strongest contributions: ", ""), ", ")
    found = F.transform(told, lambda f: F.abs(F.element_at("shap_values", f)))
    return lines.select(
        "application_id", F.element_at("line", 1).alias("request"), (F.element_at("line", 2) == F.concat(F.lit("Decision: "), "tier")).alias("decided"),
        (found == F.slice(sizes, 1, 5)).alias("strongest"), F.regexp_replace(F.element_at("line", 4), "^Applicant: ", "").alias("applicant"),
    )


@query("""SELECT application_id, 'dynamic' AS model_type, 'v1' AS model_version, TIMESTAMP '2025-01-01' AS created_at
          FROM apps WHERE person_age <= 100 AND person_age >= 18 AND NOT COALESCE(loan_percent_income > 1, FALSE)""", "apps")
def log_predictions(spark, sf_dir):
    """Scored rows appended to a prediction table."""
    scored = P.score_batch(W.written_applications(spark, sf_dir), scorer(spark, sf_dir))
    store = tables.Table(spark, scratch_path(spark, "predictions"))
    store.append(P.prediction_rows(scored, "v1", now=NOW))
    return store.read().select("application_id", "model_type", "model_version", "created_at")


@query("SELECT application_id, TRUE AS same_score FROM apps WHERE loan_status IS NOT NULL", "apps")
def model_round_trip(spark, sf_dir):
    """Whether a saved and re-loaded pipeline gives every row the same score."""
    fitted = scorer(spark, sf_dir)
    store = tables.ModelStore(spark, scratch_path(spark, "models"))
    store.save(fitted.model, FEATURES, {"accuracy": 0.0})
    model, _, _ = store.load()
    before = P.score(_encoded(spark, sf_dir), fitted.model).withColumnRenamed("probability_default", "before")
    again = P.score(before.drop("features", "binary_prediction"), model)
    return again.select("application_id", (F.col("before") == F.col("probability_default")).alias("same_score"))


@query("""SELECT row_number() OVER (ORDER BY application_id % 2, application_id) AS application_id, application_id AS source_id, person_age,
            loan_amnt, home_ownership, 'approved' AS application_status, loan_status AS actual_outcome, application_id % 2 AS batch,
            CASE WHEN person_age > 100 OR person_age < 18 OR COALESCE(loan_percent_income > 1, FALSE) THEN 'error' ELSE 'success' END AS status
          FROM apps""", "apps")
def stream_import_and_score(spark, sf_dir):
    """History files with foreign headers, imported and scored in two starts of one stream: both tables, joined by id."""
    source, root = scratch_path(spark, "incoming"), scratch_path(spark, "imported")
    rows = W.written_applications(spark, sf_dir).withColumnsRenamed(HISTORY_ALIASES)
    for part in (0, 1):
        rows.where(F.col("application_id") % 2 == part).write.mode("append").parquet(source)
        job = jobs.stream_import_and_score(spark, source, rows.schema, scorer(spark, sf_dir), root, ["application_id"])
        job.awaitTermination()
    journal = Journal(spark, root)
    columns = ["person_age", "loan_amnt", "home_ownership", "application_status"]
    stored = journal.read("applications").select("id", F.col("application_id").cast("long").alias("source_id"), *columns)
    scored = journal.read("predictions").select(F.col("application_id").alias("id"), "status", "actual_outcome", "batch")
    return stored.join(scored, "id").withColumnRenamed("id", "application_id")


def _request_stream(spark, sf_dir):
    schema = W.table(spark, sf_dir, "events").schema
    # a pattern, because a stream source takes folders and patterns but no single file
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("provider"))


def _closed(spark, start, *times):
    """Run a window job on what is there, then once more with the log closed."""
    target, state, closing = (scratch_path(spark, n) for n in ("counts", "state", "closing"))
    for end in (False, True):
        if end:
            jobs.close_windows(spark, closing)
        start(target, state, closing).awaitTermination()
    return spark.read.parquet(target).withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query("""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, provider, count(*) AS n
          FROM reqlog GROUP BY ALL""", "reqlog")
def stream_all_request_counts(spark, sf_dir):
    """Hourly counts of a log that has ended: every window, those still open before included."""
    log = _request_stream(spark, sf_dir)
    return _closed(spark, lambda *to: jobs.stream_request_counts(log, *to[:2], closing=to[2]), "window_start", "window_end")


@query("""WITH starts AS (SELECT provider, ts, coalesce(ts - lag(ts) OVER (PARTITION BY provider ORDER BY ts) >= INTERVAL 30 MINUTE, TRUE) AS first FROM reqlog),
            sessions AS (SELECT provider, ts, sum(first::INTEGER) OVER (PARTITION BY provider ORDER BY ts) AS session FROM starts)
          SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, provider, count(*) AS n FROM sessions GROUP BY provider, session""", "reqlog")
def stream_request_sessions(spark, sf_dir):
    """Sessions of a log that has ended: requests of a provider less than half an hour apart."""
    log = _request_stream(spark, sf_dir)
    return _closed(spark, lambda *to: jobs.stream_request_sessions(log, *to[:2], closing=to[2]), "session_start", "session_end")


@query("""SELECT id, provider, model, row_number() OVER (PARTITION BY provider, model ORDER BY ts, id) AS session_count FROM reqlog""", "reqlog")
def stream_running_request_count(spark, sf_dir):
    """Running numbers of a log that arrives in two parts, numbered by two starts of one stream."""
    source, root = scratch_path(spark, "incoming"), scratch_path(spark, "numbered")
    rows = W.request_log(spark, sf_dir).select("id", "ts", "provider", "model")
    middle = rows.agg(((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2).cast("long").alias("m")).first().m
    first = F.unix_micros(F.col("ts").cast("timestamp")) <= middle
    for part in (first, ~first):
        rows.where(part).write.mode("append").parquet(source)
        jobs.stream_running_counts(spark.readStream.schema(rows.schema).parquet(source), root).awaitTermination()
    return jobs.running_request_counts(Journal(spark, root)).drop("ts")


@query("""SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, provider, count(*) AS n FROM (
            SELECT *, date_trunc('hour', ts) AS window_start FROM reqlog)
          WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM reqlog)
          GROUP BY ALL""", "reqlog")
def stream_request_counts(spark, sf_dir):
    """Hourly counts of the request log as a stream; windows the watermark has closed."""
    log = _request_stream(spark, sf_dir)
    target, state = scratch_path(spark, "counts"), scratch_path(spark, "state")
    jobs.stream_request_counts(log, target, state).awaitTermination()
    counts = spark.read.parquet(target)
    return counts.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
