"""Queries for filters, reports, top rows, joins and updates."""

from pyspark.sql import functions as F

from loanlens.catalog import views as W
from loanlens.catalog.registry import query, r6
from loanlens.functions import risk as K
from loanlens.operators import encode as E
from loanlens.operators import evaluate as V
from loanlens.operators import joins as J
from loanlens.operators import reports as R
from loanlens.operators import validate as Q
from loanlens.session import scratch_path
from loanlens.sources.buckets import BucketedTable

_PRED = "id, application_id, risk_level, probability_default, model_type, created_at"
_PRED_COLUMNS = [c.strip() for c in _PRED.split(",")]
_APP = "id, person_age, loan_amnt, application_status"
_APP_COLUMNS = [c.strip() for c in _APP.split(",")]


def _preds(spark, sf_dir):
    return W.predictions(spark, sf_dir).select(*_PRED_COLUMNS)


def _apps(spark, sf_dir):
    return W.stored_applications(spark, sf_dir, _APP_COLUMNS)


@query(f"SELECT {_APP} FROM stored_apps WHERE id = 77", "stored_apps")
def application_by_id(spark, sf_dir):
    return R.by_id(_apps(spark, sf_dir), 77)


@query(f"SELECT {_PRED} FROM preds WHERE id = 77", "preds")
def prediction_by_id(spark, sf_dir):
    return R.by_id(_preds(spark, sf_dir), 77)


@query(f"SELECT {_APP} FROM stored_apps WHERE application_status = 'approved' ORDER BY id LIMIT 50 OFFSET 20", "stored_apps")
def applications_by_status(spark, sf_dir):
    return R.applications_by_status(_apps(spark, sf_dir), "approved", 20, 50)


@query(f"SELECT {_PRED} FROM preds WHERE model_type = 'click' ORDER BY created_at DESC, id DESC LIMIT 30 OFFSET 10", "preds")
def prediction_history(spark, sf_dir):
    return R.prediction_history(_preds(spark, sf_dir), "click", None, 10, 30)


@query(f"SELECT {_PRED} FROM preds WHERE application_id = 8 ORDER BY created_at DESC, id DESC LIMIT 100", "preds")
def prediction_history_of_application(spark, sf_dir):
    return R.prediction_history(_preds(spark, sf_dir), None, 8)


@query("SELECT id, actual_outcome, risk_level FROM preds WHERE actual_outcome IS NOT NULL", "preds")
def with_feedback(spark, sf_dir):
    return R.with_feedback(W.predictions(spark, sf_dir)).select("id", "actual_outcome", "risk_level")


@query("SELECT id, risk_level FROM preds WHERE risk_level LIKE '%High Risk%'", "preds")
def risk_like(spark, sf_dir):
    return R.risk_like(W.predictions(spark, sf_dir)).select("id", "risk_level")


@query("SELECT application_id, person_emp_length FROM apps WHERE person_emp_length IS NOT NULL", "apps")
def drop_missing(spark, sf_dir):
    return R.drop_missing(W.applications(spark, sf_dir, ["application_id", "person_emp_length"]), ["person_emp_length"])


@query("SELECT id, created_at FROM preds ORDER BY created_at DESC, id DESC LIMIT 500", "preds")
def row_cap(spark, sf_dir):
    """The newest 500 rows, the feature being the cap itself."""
    return R.recent_predictions(W.predictions(spark, sf_dir).select("id", "created_at"), 500)


@query("SELECT id, risk_level, round(probability_default * 100, 2) AS probability_percent, CASE binary_prediction WHEN 1 THEN 'Rejected' ELSE 'Approved' END AS decision FROM preds", "preds")
def risk_tier(spark, sf_dir):
    p = F.col("probability_default")
    return W.predictions(spark, sf_dir).select(
        "id", K.risk_tier(p).alias("risk_level"), K.probability_percent(p).alias("probability_percent"),
        K.decision_label(F.col("binary_prediction")).alias("decision"),
    )


@query("SELECT id, round(probability_default * 100, 2) AS probability_percent FROM preds", "preds")
def probability_percent(spark, sf_dir):
    return W.predictions(spark, sf_dir).select("id", K.probability_percent(F.col("probability_default")).alias("probability_percent"))


@query("SELECT decision, count(*) AS n FROM (SELECT CASE binary_prediction WHEN 1 THEN 'Rejected' ELSE 'Approved' END AS decision FROM preds) GROUP BY decision", "preds")
def decision_label(spark, sf_dir):
    rows = W.predictions(spark, sf_dir).select(K.decision_label(F.col("binary_prediction")).alias("decision"))
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS total_predictions, count(CASE WHEN risk_level LIKE '%High Risk%' THEN 1 END) AS high_risk_count,
            count(CASE WHEN risk_level LIKE '%Borderline Risk%' THEN 1 END) AS borderline_risk_count,
            count(CASE WHEN risk_level LIKE '%Low Risk%' THEN 1 END) AS low_risk_count,
            round(count(CASE WHEN risk_level LIKE '%High Risk%' THEN 1 END) * CAST(100 AS DOUBLE) / count(*), 6)
              AS high_risk_percentage FROM preds""", "preds")
def prediction_statistics(spark, sf_dir):
    rows = R.prediction_statistics(W.predictions(spark, sf_dir))
    return rows.withColumn("high_risk_percentage", r6("high_risk_percentage"))


@query("""SELECT count(*) AS total_applications, count(CASE application_status WHEN 'pending' THEN 1 END) AS pending,
            count(CASE application_status WHEN 'approved' THEN 1 END) AS approved,
            count(CASE application_status WHEN 'rejected' THEN 1 END) AS rejected FROM stored_apps""", "stored_apps")
def application_statistics(spark, sf_dir):
    return R.application_statistics(W.stored_applications(spark, sf_dir, ["application_status"]))


@query("""SELECT 'predictions' AS table_name, count(*) AS record_count FROM events
          UNION ALL SELECT 'loan_applications', count(*) FROM orders
          UNION ALL SELECT 'model_metrics', count(*) FROM metrics
          UNION ALL SELECT 'total', (SELECT count(*) FROM events) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM metrics)""",
       "metrics")
def record_counts(spark, sf_dir):
    return R.record_counts({
        "predictions": W.predictions(spark, sf_dir), "loan_applications": W.table(spark, sf_dir, "orders"),
        "model_metrics": W.model_metrics(spark, sf_dir),
    })


def _share_sql(key: str, where: str = "") -> str:
    return f"""SELECT {key}, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 4) AS percentage
               FROM preds {where} GROUP BY {key}"""


def _shares(rows):
    return rows.withColumn("percentage", F.round("percentage", 4))


@query(_share_sql("risk_level"), "preds")
def by_risk_level(spark, sf_dir):
    return _shares(R.count_and_percent(W.predictions(spark, sf_dir), "risk_level"))


@query(_share_sql("model_type"), "preds")
def by_model_type(spark, sf_dir):
    return _shares(R.count_and_percent(W.predictions(spark, sf_dir), "model_type"))


@query("SELECT *, CASE actual_outcome WHEN 1 THEN 'Default' ELSE 'No Default' END AS outcome_label FROM (" + _share_sql(
    "actual_outcome", "WHERE actual_outcome IS NOT NULL") + ")", "preds")
def by_outcome(spark, sf_dir):
    return _shares(R.by_outcome(W.predictions(spark, sf_dir)))


@query("""SELECT count(*) AS total, count(actual_outcome) AS with_feedback,
            round(count(actual_outcome) * CAST(100 AS DOUBLE) / count(*), 4) AS feedback_pct FROM preds""", "preds")
def feedback_rate(spark, sf_dir):
    return R.feedback_rate(W.predictions(spark, sf_dir)).withColumn("feedback_pct", F.round("feedback_pct", 4))


@query("""SELECT 'records' AS section, 'predictions' AS item, CAST(count(*) AS DOUBLE) AS value FROM preds
          UNION ALL SELECT 'records', 'applications', count(*) FROM orders
          UNION ALL SELECT 'risk', 'high_pct', round(count(CASE WHEN risk_level LIKE '%High%' THEN 1 END) * CAST(100 AS DOUBLE) / count(*), 4) FROM preds
          UNION ALL SELECT 'risk', 'low_pct', round(count(CASE WHEN risk_level LIKE '%Low%' THEN 1 END) * CAST(100 AS DOUBLE) / count(*), 4) FROM preds
          UNION ALL SELECT 'feedback', 'with_outcome', count(actual_outcome) FROM preds
          UNION ALL SELECT 'recent', CAST(id AS VARCHAR), round(probability_default, 4) FROM (
            SELECT * FROM preds ORDER BY created_at DESC, id DESC LIMIT 5)""", "preds")
def quick_check(spark, sf_dir):
    report = R.quick_check(W.predictions(spark, sf_dir), W.table(spark, sf_dir, "orders"))
    return report.withColumn("value", F.round("value", 4))


@query("""SELECT count(*) AS total, count(CASE WHEN model_type <> 'error' THEN 1 END) AS success,
            count(CASE WHEN model_type = 'error' THEN 1 END) AS error FROM preds""", "preds")
def batch_summary(spark, sf_dir):
    status = F.when(F.col("model_type") == "error", "error").otherwise("success")
    return R.batch_summary(W.predictions(spark, sf_dir).select(status.alias("status")))


@query("""SELECT *, round(successful * CAST(100 AS DOUBLE) / total, 4) AS success_pct, round(failed * CAST(100 AS DOUBLE) / total, 4) AS failure_pct
          FROM (SELECT count(*) AS total, count(CASE WHEN success THEN 1 END) AS successful,
                  count(CASE WHEN NOT success THEN 1 END) AS failed FROM reqlog)""", "reqlog")
def request_log_stats(spark, sf_dir):
    rows = R.request_log_stats(W.request_log(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 4) for c in ("success_pct", "failure_pct")})


@query(" UNION ALL ".join(
    f"SELECT '{d}' AS dimension, COALESCE({d}, 'Unknown') AS key, count(*) AS n FROM reqlog GROUP BY 2"
    for d in ("provider", "model", "endpoint")), "reqlog")
def request_log_breakdown(spark, sf_dir):
    return R.request_log_breakdown(W.request_log(spark, sf_dir))


@query("""SELECT n AS total_requests, round(s, 6) AS duration_seconds, round(n / s * 60, 6) AS requests_per_minute FROM (
            SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS s FROM reqlog)""", "reqlog")
def request_rate(spark, sf_dir):
    rows = R.request_rate(W.request_log(spark, sf_dir))
    return rows.withColumns({c: r6(c) for c in ("duration_seconds", "requests_per_minute")})


@query("SELECT provider || ':' || model AS source, count(*) AS n FROM reqlog GROUP BY 1", "reqlog")
def requests_by_source(spark, sf_dir):
    return R.requests_by_source(W.request_log(spark, sf_dir))


@query("""SELECT id, provider, model, row_number() OVER (PARTITION BY provider, model ORDER BY ts, id) AS session_count
          FROM reqlog""", "reqlog")
def running_request_count(spark, sf_dir):
    rows = W.request_log(spark, sf_dir).select("id", "ts", "provider", "model")
    return R.running_request_count(rows).drop("ts")


@query("""SELECT id, strftime(ts, '%H:%M:%S') AS time, provider, substr(model, 1, 30) AS model, success FROM reqlog
          ORDER BY ts DESC, id DESC LIMIT 10""", "reqlog")
def recent_requests(spark, sf_dir):
    return R.recent_requests(W.request_log(spark, sf_dir))


@query("""SELECT CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * w, 6) AS low, round(lo + bin * w, 6) AS high, n FROM (
            SELECT least(CAST(floor((person_age - lo) / w) AS BIGINT) + 1, 30) AS bin, lo, w, count(*) AS n
            FROM apps, (SELECT min(person_age) AS lo, (max(person_age) - min(person_age)) / 30 AS w FROM apps)
            GROUP BY ALL)""", "apps")
def histogram(spark, sf_dir):
    rows = R.histogram(W.applications(spark, sf_dir), "person_age", 30)
    return rows.select("bin", r6("low").alias("low"), r6("high").alias("high"), "n")


@query("""SELECT CAST(least(floor((person_income - xl) / xw) + 1, 20) AS INTEGER) AS x_bin,
            CAST(least(floor((loan_amnt - yl) / yw) + 1, 20) AS INTEGER) AS y_bin, loan_status, count(*) AS n
          FROM apps, (SELECT min(person_income) AS xl, (max(person_income) - min(person_income)) / 20 AS xw,
                        min(loan_amnt) AS yl, (max(loan_amnt) - min(loan_amnt)) / 20 AS yw FROM apps)
          WHERE person_income IS NOT NULL AND loan_amnt IS NOT NULL GROUP BY 1, 2, 3""", "apps")
def income_amount_grid(spark, sf_dir):
    return R.grid_counts(W.applications(spark, sf_dir), "person_income", "loan_amnt", "loan_status")


@query("""SELECT loan_grade, count(CASE WHEN loan_status = 0 THEN 1 END) AS loan_status_0,
            count(CASE WHEN loan_status = 1 THEN 1 END) AS loan_status_1 FROM apps GROUP BY loan_grade""", "apps")
def crosstab_grade_status(spark, sf_dir):
    return R.crosstab(W.applications(spark, sf_dir), "loan_grade", "loan_status", [0, 1])


@query("SELECT loan_status, count(*) AS n FROM apps GROUP BY loan_status", "apps")
def count_by_status(spark, sf_dir):
    return W.applications(spark, sf_dir, ["loan_status"]).groupBy("loan_status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT total, approved, rejected, round(approved * CAST(100 AS DOUBLE) / total, 4) AS approved_pct,
            round(rejected * CAST(100 AS DOUBLE) / total, 4) AS rejected_pct FROM (
            SELECT count(*) AS total, count(CASE loan_status WHEN 0 THEN 1 END) AS approved,
              count(CASE loan_status WHEN 1 THEN 1 END) AS rejected FROM apps)""", "apps")
def business_insights(spark, sf_dir):
    rows = R.business_insights(W.applications(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 4) for c in ("approved_pct", "rejected_pct")})


@query(f"SELECT {_PRED} FROM preds ORDER BY created_at DESC, id DESC LIMIT 10", "preds")
def recent_predictions(spark, sf_dir):
    return R.recent_predictions(_preds(spark, sf_dir), 10)


@query("""SELECT model_type, model_version, round(accuracy, 6) AS accuracy, evaluation_date FROM metrics
          WHERE model_type = 'click' ORDER BY evaluation_date DESC, model_version DESC LIMIT 10""", "metrics")
def metrics_history(spark, sf_dir):
    rows = R.metrics_history(W.model_metrics(spark, sf_dir), "click")
    return rows.select("model_type", "model_version", r6("accuracy").alias("accuracy"), "evaluation_date")


@query("""SELECT model_type, model_version, round(accuracy, 6) AS accuracy, total_predictions, evaluation_date FROM (
            SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY evaluation_date DESC) AS rn FROM metrics) WHERE rn = 1""",
       "metrics")
def latest_metrics(spark, sf_dir):
    rows = R.latest_per_key(W.model_metrics(spark, sf_dir), ["model_type"], ["evaluation_date"])
    return rows.select("model_type", "model_version", r6("accuracy").alias("accuracy"), "total_predictions", "evaluation_date")


@query("""SELECT model_type, model_version, round(accuracy, 6) AS accuracy, round(accuracy_change, 6) AS accuracy_change,
            COALESCE(accuracy_change < 0, FALSE) AS accuracy_dropped, auc_roc < 0.75 AS auc_alarm,
            accuracy > 0.85 AND auc_roc > 0.85 AS meets_target FROM (
            SELECT *, accuracy - lag(accuracy) OVER (PARTITION BY model_type ORDER BY evaluation_date) AS accuracy_change
            FROM metrics)""", "metrics")
def metrics_gate(spark, sf_dir):
    rows = V.metrics_gate(W.model_metrics(spark, sf_dir))
    return rows.select(
        "model_type", "model_version", r6("accuracy").alias("accuracy"), r6("accuracy_change").alias("accuracy_change"),
        "accuracy_dropped", "auc_alarm", "meets_target",
    )


@query("""SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
          WHERE rn <= 5 GROUP BY conv_id""")
def recent_turns(spark, sf_dir):
    return R.recent_turns(W.table(spark, sf_dir, "conversations"), 5)


@query("""SELECT event_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY event_type""")
def share_of_total(spark, sf_dir):
    counts = W.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return E.share_of_total(counts).withColumn("share", r6("share"))


@query("""SELECT p.id, p.application_id, p.risk_level, a.loan_amnt AS application_loan_amnt, a.application_status AS application_application_status
          FROM preds p LEFT JOIN stored_apps a ON a.id = p.application_id""", "preds stored_apps")
def join_application_prediction(spark, sf_dir):
    preds = W.predictions(spark, sf_dir).select("id", "application_id", "risk_level")
    apps = W.stored_applications(spark, sf_dir, ["id", "loan_amnt", "application_status"])
    return J.join_application_prediction(preds, apps)


@query(f"SELECT {_APP} FROM stored_apps WHERE id NOT IN (SELECT application_id FROM preds)", "stored_apps preds")
def unscored_applications(spark, sf_dir):
    return J.unscored_applications(_apps(spark, sf_dir), W.predictions(spark, sf_dir))


_FEEDBACK = """feedback AS (SELECT event_id * 2 AS id, CAST(user_id % 2 AS INTEGER) AS actual_outcome, ts AS feedback_date FROM events
      UNION ALL SELECT event_id * 2, 1, ts - INTERVAL 1 DAY FROM events)"""


def _feedback(spark, sf_dir):
    events = W.table(spark, sf_dir, "events")
    rows = events.select(
        (F.col("event_id") * 2).alias("id"), (F.col("user_id") % 2).cast("int").alias("actual_outcome"), F.col("ts").alias("feedback_date")
    )
    older = events.select(
        (F.col("event_id") * 2).alias("id"), F.lit(1).alias("actual_outcome"),
        (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("feedback_date"),
    )
    return rows.union(older)


_RECORDED = f"""WITH {_FEEDBACK},
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY feedback_date DESC, actual_outcome DESC) AS rn
                              FROM feedback) WHERE rn = 1)
    SELECT p.id, COALESCE(n.actual_outcome, p.actual_outcome) AS actual_outcome, n.feedback_date, p.risk_level
    FROM preds p LEFT JOIN newest n ON n.id = p.id"""


@query(_RECORDED, "preds")
def record_feedback(spark, sf_dir):
    """Newest feedback per prediction; feedback for unknown ids changes nothing."""
    preds = W.predictions(spark, sf_dir).select(
        "id", "actual_outcome", F.lit(None).cast("timestamp_ntz").alias("feedback_date"), "risk_level"
    )
    return J.record_feedback(preds, _feedback(spark, sf_dir))


@query(_RECORDED.replace("SELECT p.id, COALESCE", "SELECT p.id, p.actual_outcome AS old_outcome, COALESCE"), "preds")
def join_feedback(spark, sf_dir):
    """Predictions beside their newest feedback."""
    preds = W.predictions(spark, sf_dir).select(
        "id", "actual_outcome", F.col("actual_outcome").alias("old_outcome"),
        F.lit(None).cast("timestamp_ntz").alias("feedback_date"), "risk_level",
    )
    return J.record_feedback(preds, _feedback(spark, sf_dir))


@query("""SELECT id, person_age, CASE WHEN id % 10 = 0 THEN 1 + person_age ELSE loan_amnt END AS loan_amnt,
            CASE WHEN id % 10 = 0 THEN 'rejected' ELSE application_status END AS application_status FROM stored_apps""", "stored_apps")
def update_application(spark, sf_dir):
    """Two columns set for every tenth application."""
    apps = _apps(spark, sf_dir)
    updates = apps.where("id % 10 = 0").select(
        "id", (F.col("person_age") + 1).alias("loan_amnt"), F.lit("rejected").alias("application_status"), F.lit(1).alias("updated_at")
    )
    return J.apply_updates(apps, updates)


def _stored(spark, rows, buckets=16):
    """``rows`` as a bucketed table of their own."""
    store = BucketedTable(spark, scratch_path(spark, "buckets"), rows.schema, "id", buckets)
    store.create(rows)
    return store


@query(_RECORDED, "preds")
def record_feedback_in_place(spark, sf_dir):
    """Feedback laid over a stored table: only buckets that hold ids of the feedback are read and written."""
    store = _stored(spark, W.predictions(spark, sf_dir).select(
        "id", "actual_outcome", F.lit(None).cast("timestamp_ntz").alias("feedback_date"), "risk_level"
    ))
    store.update(_feedback(spark, sf_dir), J.record_feedback)
    return store.read()


@query("""SELECT id, CASE WHEN id <= 40 AND id % 10 = 0 THEN 1 + person_age ELSE person_age END AS person_age, loan_amnt,
            CASE WHEN id <= 40 AND id % 10 = 0 THEN 'rejected' ELSE application_status END AS application_status FROM stored_apps""", "stored_apps")
def update_application_in_place(spark, sf_dir):
    """Two columns of a few applications of a stored table."""
    apps = _apps(spark, sf_dir)
    store = _stored(spark, apps)
    store.update(apps.where("id <= 40 AND id % 10 = 0").select(
        "id", (F.col("person_age") + 1).alias("person_age"), F.lit("rejected").alias("application_status"), F.lit(1).alias("updated_at")
    ))
    return store.read()


@query("""SELECT application_id, CASE WHEN bad THEN 'error' ELSE 'success' END AS status,
            CASE WHEN NOT bad THEN loan_amnt END AS loan_amnt, CASE WHEN bad THEN 'person_age: above 100' END AS error
          FROM (SELECT *, person_age > 100 AS bad FROM apps WHERE person_age >= 18)""", "apps")
def union_batch_status(spark, sf_dir):
    rows = W.applications(spark, sf_dir).where("person_age >= 18").select("application_id", "person_age", "loan_amnt")
    good, bad = Q.split_valid(rows, [Q.Rule("person_age", 18, 100)])
    errors = bad.select("application_id", F.array_join("errors", "; ").alias("error"))
    return J.union_batch_status(good.select("application_id", "loan_amnt"), errors)


@query("""SELECT count(*) AS total_predictions, count(CASE WHEN label = prediction THEN 1 END) AS correct_predictions,
            round(count(CASE WHEN label = prediction THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS accuracy,
            count(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS false_positives,
            count(CASE WHEN label = 1 AND prediction = 0 THEN 1 END) AS false_negatives,
            round(count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) / CAST(sum(prediction) AS DOUBLE), 6) AS precision,
            round(count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) / CAST(sum(label) AS DOUBLE), 6) AS recall,
            round(2 * count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) / CAST(sum(label) + sum(prediction) AS DOUBLE), 6) AS f1_score
          FROM pairs""", "pairs")
def binary_metrics(spark, sf_dir):
    rows = V.binary_metrics(W.scored_pairs(spark, sf_dir))
    return rows.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1_score")})


@query("""SELECT round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2) / (p * n), 6) AS auc_roc FROM (
            SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / CAST(2 AS DOUBLE) AS r,
              CAST(count(CASE label WHEN 1 THEN 1 END) OVER () AS DOUBLE) AS p, CAST(count(CASE label WHEN 0 THEN 1 END) OVER () AS DOUBLE) AS n
            FROM pairs) GROUP BY p, n""", "pairs")
def auc_roc(spark, sf_dir):
    return V.auc_roc(W.scored_pairs(spark, sf_dir)).select(r6("auc_roc").alias("auc_roc"))


@query("""WITH c AS (SELECT probability AS s, count(CASE label WHEN 1 THEN 1 END) AS pos, count(CASE label WHEN 0 THEN 1 END) AS neg
                     FROM pairs GROUP BY 1),
               t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c
                     WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
          SELECT s AS threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr,
            round(neg / CAST(n AS DOUBLE) * ((tp - pos / CAST(2 AS DOUBLE)) / p), 8) AS area FROM t""", "pairs")
def roc_curve(spark, sf_dir):
    rows = V.roc_curve(W.scored_pairs(spark, sf_dir))
    return rows.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"), F.round("area", 8).alias("area"))


@query("""SELECT label, count(CASE prediction WHEN 0 THEN 1 END) AS predicted_0, count(CASE prediction WHEN 1 THEN 1 END) AS predicted_1
          FROM pairs GROUP BY label""", "pairs")
def confusion_matrix(spark, sf_dir):
    return V.confusion_matrix(W.scored_pairs(spark, sf_dir))


@query("""WITH k AS (SELECT CAST(v AS INTEGER) AS k FROM (VALUES (0), (1)) AS t(v)),
    per AS (SELECT k, count(CASE WHEN label = k AND prediction = k THEN 1 END) AS hit, count(CASE WHEN prediction = k THEN 1 END) AS said,
              count(CASE WHEN label = k THEN 1 END) AS support FROM pairs, k GROUP BY k),
    m AS (SELECT k, support, hit, hit / CAST(said AS DOUBLE) AS p, hit / CAST(support AS DOUBLE) AS r,
            2 * hit / CAST(said + support AS DOUBLE) AS f FROM per)
    SELECT CAST(k AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support FROM m
    UNION ALL SELECT 'accuracy', round(sum(hit) / CAST(sum(support) AS DOUBLE), 6), round(sum(hit) / CAST(sum(support) AS DOUBLE), 6),
      round(sum(hit) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
      round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""", "pairs")
def classification_report(spark, sf_dir):
    rows = V.classification_report(W.scored_pairs(spark, sf_dir))
    return rows.withColumns({c: r6(c) for c in ("precision", "recall", "f1_score")})


@query("""SELECT count(actual_outcome) AS with_feedback, count(CASE WHEN binary_prediction = actual_outcome THEN 1 END) AS correct,
            round(count(CASE WHEN binary_prediction = actual_outcome THEN 1 END) * CAST(100 AS DOUBLE) / count(actual_outcome), 4) AS accuracy_pct
          FROM preds""", "preds")
def live_accuracy(spark, sf_dir):
    return V.live_accuracy(W.predictions(spark, sf_dir)).withColumn("accuracy_pct", F.round("accuracy_pct", 4))


@query("""SELECT n >= 100 AND f / CAST(n AS DOUBLE) >= 0.1 AS is_ready, n AS total_predictions, f AS feedback_count,
            round(f / CAST(n AS DOUBLE), 6) AS feedback_ratio, greatest(0, 100 - n) AS samples_needed,
            greatest(0, 10 - f) AS feedback_needed FROM (SELECT count(*) AS n, count(actual_outcome) AS f FROM preds)""", "preds")
def retraining_readiness(spark, sf_dir):
    rows = V.retraining_readiness(W.predictions(spark, sf_dir))
    return rows.withColumn("feedback_ratio", r6("feedback_ratio"))
