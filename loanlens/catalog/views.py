"""Loan-domain views over the given tables, once as DataFrames and once as SQL text.

The given tables hold no loans, so each view is a fixed rule over them: orders stand for
applications, events for the prediction and request logs, labelled documents for scored pairs, parts
for file headers. Both forms must agree row by row.
"""

from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loanlens import schema as S
from loanlens.functions.risk import risk_tier
from loanlens.operators.impute import impute, uppercase_categoricals
from loanlens.operators.stats import FillValues, fit_fill_values
from loanlens.session import scratch_path, spread

# How codes of the given tables stand for loan categories.
HOME = {"AUTOMOBILE": "rent", "BUILDING": "MORTGAGE", "FURNITURE": "OWN", "HOUSEHOLD": "OTHER"}
INTENT = {
    "ECONOMY": "PERSONAL", "STANDARD": "EDUCATION", "MEDIUM": "MEDICAL", "PROMO": "VENTURE",
    "SMALL": "homeimprovement", "LARGE": "DEBTCONSOLIDATION",
}
GRADE = {"1": "A", "2": "B", "3": "C", "4": "D", "5": "E"}
STATUS = {"F": 1, "O": 0}
HEADERS = [
    "Age", "age", "person_age", "Annual Income", "income", "Person-Income", "emp_length", "Employment Length",
    "loan.amount", "LoanAmnt", "Interest Rate", "int_rate", "percent_income", "home", "Home Ownership", "purpose",
    "loan_intent", "Grade", "credit history", "cred_hist_length", "default", "default_history", "loan_status",
    "credit.policy", "notes", "zip code",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(code, values: dict):
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), code)


#: Columns of the view that need a table beside orders.
_OF_LINES = {"loan_int_rate", "default_on_file", "loan_intent"}
_OF_CUSTOMER = {"person_income", "home_ownership", "loan_percent_income"}
_OF_PART = {"loan_intent"}


def applications(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """One application per order, with missing and out-of-range values as the tables give them.

    Only the tables that ``columns`` (default: all) need are read and joined.
    """
    columns = columns or ["application_id", *S.CANONICAL, "loan_status", "created_at"]
    joined = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    if _OF_LINES & set(columns):
        line = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
        lines = line.groupBy("l_orderkey").agg(
            F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tax_cents"),
            F.count(F.lit(1)).alias("line_count"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"),
            # one number hash-aggregates; a line number over 2^23 or a part key over 2^40 would fail, not mix
            F.min(F.col("l_linenumber").cast("long") * (1 << 40) + F.col("l_partkey")).alias("first_line"),
        )
        joined = joined.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if _OF_CUSTOMER & set(columns):
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
        joined = joined.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    if _OF_PART & set(columns):
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
        joined = joined.join(part, F.col("first_line") % (1 << 40) == F.col("p_partkey"), "left")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    income, amount = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") * 12), F.when(key % 50 != 0, F.col("o_totalprice") / 10)
    values = {
        "application_id": key,
        "person_age": (F.lit(16) + F.pmod(cust, F.lit(90))).cast("double"),
        "person_income": income,
        "person_emp_length": F.when(cust % 10 != 0, (cust % 41).cast("double")),
        "loan_amnt": amount,
        "loan_int_rate": F.lit(5.0) + F.lit(1.5) * F.col("tax_cents") / F.col("line_count"),
        "cb_person_cred_hist_length": (F.lit(2001) - F.year("o_orderdate")).cast("double"),
        "home_ownership": _lookup(F.col("c_mktsegment"), HOME),
        "loan_intent": _lookup(F.col("p_type"), INTENT),
        "loan_grade": _lookup(F.substring("o_orderpriority", 1, 1), GRADE),
        "default_on_file": F.when(F.col("returned") == 1, "Y").when(F.col("returned") == 0, "N"),
        "loan_status": _lookup(F.col("o_orderstatus"), STATUS),
        "created_at": F.col("o_orderdate"),
        "loan_percent_income": F.when(key % 2 != 0, F.try_divide(amount, income)),
    }
    return joined.select(*(values[c].alias(c) for c in columns))


def raw_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applications under the raw dataset's names."""
    return applications(spark, sf_dir).drop("created_at").withColumnsRenamed(
        {v: k for k, v in S.RAW_NAMES.items()}
    )


def stored_applications(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    key = F.col("id") % 3
    status = F.when(key == 0, "pending").when(key == 1, "approved").otherwise("rejected")
    wanted = [c for c in columns if c not in ("id", "application_status")] if columns else None
    rows = applications(spark, sf_dir, ["application_id", *wanted] if columns else None)
    stored = rows.withColumnRenamed("application_id", "id").withColumn("application_status", status)
    return stored.select(*columns) if columns else stored


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged prediction per event."""
    p = F.least(F.col("value") / 100, F.lit(1.0))
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("application_id"), risk_tier(p).alias("risk_level"),
        p.alias("probability_default"), (p > 0.5).cast("int").alias("binary_prediction"),
        F.col("event_type").alias("model_type"), F.when(k % 3 < 2, k % 3).alias("actual_outcome"),
        F.col("ts").alias("created_at"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("provider"),
        F.concat(F.lit("a-rather-long-model-name/version-"), (F.col("user_id") % 7).cast("string")).alias("model"),
        F.when(k % 4 == 0, "predict").when(k % 4 == 1, "explain").when(k % 4 == 2, "chat").alias("endpoint"),
        (F.col("event_type") != "error").alias("success"), k.alias("tokens"),
    )


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, 0/1 prediction and score per labelled document."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("prediction"),
        (F.col("n_chars") % 5000 / 5000.0).alias("probability"),
    )


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics row per event type and hour."""
    value = F.col("value")
    return table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("model_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("evaluation_date")
    ).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(value < 80).alias("correct_predictions"), F.count_if(value < 90).alias("_won"),
    ).select(
        "model_type", F.concat(F.lit("v"), F.date_format("evaluation_date", "yyyyMMddHH")).alias("model_version"),
        (F.col("correct_predictions") / F.col("total_predictions")).alias("accuracy"),
        (F.col("_won") / F.col("total_predictions")).alias("auc_roc"),
        "total_predictions", "correct_predictions", "evaluation_date",
    )


def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, header)``: two headers per part, one a known spelling, one the part's name."""
    part = table(spark, sf_dir, "part")
    known = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (F.col("p_partkey") % len(HEADERS)).cast("int") + 1)
    return part.select(
        F.floor(F.col("p_partkey") / 10).alias("file"), F.explode(F.array(known, F.col("p_name"))).alias("header")
    ).distinct()


@lru_cache(maxsize=32)
def _written(app_id: str, spark: SparkSession, sf_dir: str) -> tuple[str, StructType]:
    rows, path = applications(spark, sf_dir), scratch_path(spark, "applications")
    rows.write.parquet(path)
    return path, rows.schema


def written_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``applications``, joined and written once per session (again if its folder was cleaned), for plans that read them several times."""
    def read() -> DataFrame:
        path, schema = _written(spark.sparkContext.applicationId, spark, sf_dir)
        return spark.read.schema(schema).parquet(path)

    try:
        return read()
    except AnalysisException:
        _written.cache_clear()
        return read()


@lru_cache(maxsize=32)
def _fill(app_id: str, spark: SparkSession, sf_dir: str) -> FillValues:
    return fit_fill_values(uppercase_categoricals(written_applications(spark, sf_dir)).select(*S.CANONICAL))


def fill_values(spark: SparkSession, sf_dir: str) -> FillValues:
    """Medians and modes of the applications (one value per column), fitted once per session."""
    return _fill(spark.sparkContext.applicationId, spark, sf_dir)


def imputed(spark: SparkSession, sf_dir: str, written: bool = False) -> DataFrame:
    """The applications with every gap filled, their log, and the outcome; read from ``written_applications`` if asked."""
    rows = (written_applications if written else applications)(spark, sf_dir)
    rows = uppercase_categoricals(rows).withColumnRenamed("loan_status", "_status")
    return impute(rows, fill_values(spark, sf_dir)).withColumnRenamed("_status", "loan_status")


# ---------------------------------------------------------------------------
# The same views as SQL.
# ---------------------------------------------------------------------------

def _case(expr: str, values: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + " END"


def risk_sql(p: str) -> str:
    return (
        f"CASE WHEN {p} > {S.HIGH_THRESHOLD} THEN '{S.HIGH_RISK}' WHEN {p} > {S.BORDERLINE_THRESHOLD} "
        f"THEN '{S.BORDERLINE_RISK}' WHEN {p} IS NOT NULL THEN '{S.LOW_RISK}' END"
    )


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_TEXT = "'" + "','".join(HEADERS) + "'"
_DEFAULT_RATIO = "loan_amnt / NULLIF(person_income, 0)"


VIEWS: dict[str, tuple[list[str], str]] = {
    "apps": ([], f"""
        SELECT application_id, person_age, person_income, person_emp_length, loan_amnt, loan_int_rate,
               CASE WHEN application_id % 2 <> 0 THEN {_DEFAULT_RATIO} END AS loan_percent_income,
               cb_person_cred_hist_length, home_ownership, loan_intent, loan_grade, default_on_file,
               loan_status, created_at
        FROM (
          SELECT o_orderkey AS application_id,
                 CAST(16 + o_custkey % 90 AS DOUBLE) AS person_age,
                 CASE WHEN c_acctbal >= 0 THEN c_acctbal * 12 END AS person_income,
                 CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey % 41 AS DOUBLE) END AS person_emp_length,
                 CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice / 10 END AS loan_amnt,
                 CAST(5 AS DOUBLE) + CAST(1.5 AS DOUBLE) * tax_cents / line_count AS loan_int_rate,
                 CAST(2001 - year(o_orderdate) AS DOUBLE) AS cb_person_cred_hist_length,
                 {_case("c_mktsegment", HOME)} AS home_ownership,
                 {_case("p_type", INTENT)} AS loan_intent,
                 {_case("substr(o_orderpriority, 1, 1)", GRADE)} AS loan_grade,
                 CASE returned WHEN 1 THEN 'Y' WHEN 0 THEN 'N' END AS default_on_file,
                 {_case("o_orderstatus", STATUS)} AS loan_status,
                 o_orderdate AS created_at
          FROM orders
          LEFT JOIN (
            SELECT l_orderkey, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax_cents,
                   count(*) AS line_count, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
            FROM lineitem GROUP BY l_orderkey
          ) AS t ON t.l_orderkey = o_orderkey
          LEFT JOIN (
            SELECT l_orderkey, l_partkey FROM (
              SELECT l_orderkey, l_partkey, row_number() OVER (
                PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
              FROM lineitem) WHERE rn = 1
          ) AS f ON f.l_orderkey = o_orderkey
          LEFT JOIN customer ON c_custkey = o_custkey
          LEFT JOIN part ON p_partkey = f.l_partkey
        )"""),
    "upper_apps": (["apps"], """
        SELECT * REPLACE (upper(home_ownership) AS home_ownership, upper(loan_intent) AS loan_intent,
                          upper(loan_grade) AS loan_grade, upper(default_on_file) AS default_on_file)
        FROM apps"""),
    "stored_apps": (["apps"], """
        SELECT application_id AS id, * EXCLUDE (application_id),
               CASE application_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END
                 AS application_status
        FROM apps"""),
    "preds": ([], f"""
        SELECT event_id AS id, user_id AS application_id, {risk_sql("p")} AS risk_level,
               p AS probability_default, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS binary_prediction,
               event_type AS model_type, CAST(CASE WHEN k % 3 < 2 THEN k % 3 END AS INTEGER) AS actual_outcome,
               ts AS created_at
        FROM (SELECT *, least(value / 100, CAST(1 AS DOUBLE)) AS p, {_K} AS k FROM events)"""),
    "reqlog": ([], f"""
        SELECT event_id AS id, ts, event_type AS provider,
               'a-rather-long-model-name/version-' || CAST(user_id % 7 AS VARCHAR) AS model,
               CASE k % 4 WHEN 0 THEN 'predict' WHEN 1 THEN 'explain' WHEN 2 THEN 'chat' END AS endpoint,
               event_type <> 'error' AS success, k AS tokens
        FROM (SELECT *, {_K} AS k FROM events)"""),
    "pairs": ([], """
        SELECT doc_id, quality AS label, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS prediction,
               n_chars % 5000 / CAST(5000 AS DOUBLE) AS probability
        FROM labels JOIN documents USING (doc_id)"""),
    "metrics": ([], """
        SELECT event_type AS model_type, 'v' || strftime(h, '%Y%m%d%H') AS model_version,
               correct / CAST(total AS DOUBLE) AS accuracy, won / CAST(total AS DOUBLE) AS auc_roc,
               total AS total_predictions, correct AS correct_predictions, h AS evaluation_date
        FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS total,
                     count(CASE WHEN value < 80 THEN 1 END) AS correct,
                     count(CASE WHEN value < 90 THEN 1 END) AS won
              FROM events GROUP BY ALL)"""),
    "headers": ([], f"""
        SELECT DISTINCT p_partkey // 10 AS file, header FROM (
          SELECT p_partkey, [{_TEXT}][p_partkey % {len(HEADERS)} + 1] AS header FROM part
          UNION ALL SELECT p_partkey, p_name FROM part)"""),
    "fills": (["upper_apps"], "SELECT " + ", ".join(
        [f"quantile_cont({c}, 0.5) AS m_{c}" for c in S.NUMERIC]
    ) + " FROM upper_apps"),
    "modes": (["upper_apps"], "SELECT " + ", ".join(
        f"(SELECT {c} FROM upper_apps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS m_{c}"
        for c in S.CATEGORICAL
    )),
    "imputed": (["upper_apps", "fills", "modes"], "SELECT application_id, " + ", ".join(
        [
            f"COALESCE({c}, " + (
                "CASE WHEN person_income > 0 THEN loan_amnt / person_income END, " if c == "loan_percent_income" else ""
            ) + f"m_{c}) AS {c}" for c in S.NUMERIC
        ] + [f"COALESCE({c}, m_{c}) AS {c}" for c in S.CATEGORICAL]
    ) + ", loan_status, created_at, list_filter([" + ", ".join(
        ["CASE WHEN loan_percent_income IS NULL AND loan_amnt IS NOT NULL AND person_income > 0 "
         "THEN 'loan_percent_income: derived from loan_amnt/person_income' END"]
        + [
            f"CASE WHEN {c} IS NULL" + (
                " AND NOT COALESCE(loan_amnt IS NOT NULL AND person_income > 0, FALSE)" if c == "loan_percent_income" else ""
            ) + f" THEN '{c}: historical median' END" for c in S.NUMERIC
        ]
        + [f"CASE WHEN {c} IS NULL THEN '{c}: historical mode' END" for c in S.CATEGORICAL]
    ) + "], lambda x: x IS NOT NULL) AS imputation_log FROM upper_apps, fills, modes"),
}


def with_views(names: list[str], body: str) -> str:
    """``body`` preceded by the definitions of the views it uses."""
    order: list[str] = []

    def add(name: str):
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    if not order:
        return body.strip()
    heads = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"
