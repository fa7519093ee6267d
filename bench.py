"""Wall time of the headline jobs; prints one JSON line.

``BENCH_SF_DIR`` names the data set, ``BENCH_CPUS`` the local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from loanlens import schema as S  # noqa: E402
from loanlens.catalog import QUERIES, views  # noqa: E402
from loanlens.operators import encode as E  # noqa: E402
from loanlens.operators.split import in_test  # noqa: E402
from loanlens.plans import score as P  # noqa: E402
from loanlens.plans import train as T  # noqa: E402
from loanlens.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

REPORTS = [
    "read_applications_csv", "import_history", "insert_applications", "historical_stats", "categorical_modes",
    "impute_application", "imputation_and_drift", "validate_form", "align_features", "standardize", "split_stratified",
    "prediction_statistics", "by_risk_level", "running_request_count", "recent_turns", "auc_roc", "roc_curve",
    "join_application_prediction", "record_feedback", "stream_request_counts",
]


def timed(fn) -> float:
    start = time.perf_counter()
    out = fn()
    if out is not None:
        out.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = get_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    times["fit_fill_values"] = timed(lambda: views.fill_values(spark, SF_DIR) and None)
    for name in REPORTS:
        times[name] = timed(lambda: QUERIES[name](spark, SF_DIR))

    features = S.model_features()
    encoded = E.encode_for_model(views.imputed(spark, SF_DIR), features, ["application_id", "loan_status"])
    train = encoded.where(F.col("loan_status").isNotNull() & ~in_test("application_id"))
    fitted = {}

    def fit():
        fitted["model"] = T.fit_boosted_trees(train, features, "loan_status")

    times["train_100_trees"] = timed(fit)
    scorer = P.Scorer(fitted["model"], features, views.fill_values(spark, SF_DIR))
    times["score_batch"] = timed(lambda: P.score_batch(views.applications(spark, SF_DIR), scorer))
    one = spark.createDataFrame(views.applications(spark, SF_DIR).limit(1).collect(), views.applications(spark, SF_DIR).schema)
    times["predict_one_explained"] = timed(lambda: P.score_batch(one, scorer, explain=True))
    times["score_batch_explained"] = timed(lambda: P.score_batch(views.applications(spark, SF_DIR), scorer, explain=True))

    rows = views.table(spark, SF_DIR, "orders").count()
    print(json.dumps({
        "metric": "total wall time of the headline jobs", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
        "applications": rows,
        "rows_per_sec": {
            k: round(rows / times[k]) for k in ("import_history", "impute_application", "score_batch", "score_batch_explained")
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
