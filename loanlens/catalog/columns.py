"""Queries for projections, header matching, schema evolution and scalar functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import schema as S
from loanlens.catalog import views as W
from loanlens.catalog.io import _csv, _feedback_rows
from loanlens.catalog.registry import query
from loanlens.functions import names as N
from loanlens.functions import text as X
from loanlens.operators import mapping as M
from loanlens.operators.drift import drift_check
from loanlens.operators.ordered import with_row_index
from loanlens.plans import imports as P
from loanlens.sources import files

ODD_NAMES = ["Application.ID", "Person Age", "LOAN-AMNT", "loan.grade"]


@query("""SELECT application_id, person_age, loan_amnt, loan_grade FROM apps""", "apps")
def normalize_columns(spark, sf_dir):
    rows = W.applications(spark, sf_dir, ["application_id", "person_age", "loan_amnt", "loan_grade"])
    return M.normalize_columns(rows.toDF(*ODD_NAMES))


@query("""SELECT application_id, person_age, COALESCE(CASE WHEN application_id % 3 = 0 THEN person_income END,
            loan_amnt) AS person_income, home_ownership, default_on_file, loan_intent FROM apps""", "apps")
def rename_aliases(spark, sf_dir):
    """Known aliases; two headers for the income are coalesced."""
    rows = W.applications(spark, sf_dir).select(
        "application_id", F.col("person_age").alias("age"),
        F.when(F.col("application_id") % 3 == 0, F.col("person_income")).alias("income"),
        F.col("loan_amnt").alias("annual_income"), F.col("home_ownership").alias("home"),
        F.col("default_on_file").alias("default_history"), F.col("loan_intent").alias("purpose"),
    )
    return M.rename_aliases(rows)


def _sql_columns(filler: str) -> str:
    return ", ".join(f"({i}, '{c}', '{N.compact_name(c, filler)}')" for i, c in enumerate(S.CANONICAL))


PLAIN_MATCHES = f"""WITH canon(pos, col, ck) AS (VALUES {_sql_columns(N.PLAIN_FILLER)}),
    keyed AS (SELECT *, regexp_replace(lower(header), '[_ ]', '', 'g') AS k FROM headers),
    hits AS (SELECT file, header, pos, col, row_number() OVER (PARTITION BY file, header ORDER BY pos) AS rn
             FROM keyed JOIN canon ON k <> '' AND (contains(k, ck) OR contains(ck, k)))"""


@query(PLAIN_MATCHES + """ SELECT h.file, h.header, col AS mapped_column FROM headers h
       LEFT JOIN hits ON hits.file = h.file AND hits.header = h.header AND rn = 1""", "headers")
def automap_headers(spark, sf_dir):
    return M.automap_headers(W.file_headers(spark, sf_dir))


@query(PLAIN_MATCHES + """ SELECT file, header, CAST(rn - 1 AS INTEGER) AS match_position, col AS mapped_column
       FROM hits""", "headers")
def join_headers_fuzzy(spark, sf_dir):
    return M.join_headers_fuzzy(W.file_headers(spark, sf_dir))


_ALIAS_ROWS = ", ".join(f"({i}, '{N.compact_name(p)}', '{c}')" for i, (p, c) in enumerate(S.FORM_ALIASES))


@query(rf"""WITH canon(pos, col, ck) AS (VALUES {_sql_columns(N.TIERED_FILLER)}), alias(pos, pat, col) AS (VALUES {_ALIAS_ROWS}),
    keyed AS (SELECT *, regexp_replace(lower(header), '[_\s-]', '', 'g') AS k FROM headers),
    hits AS (
      SELECT file, header, 1 AS tier, pos, col FROM keyed JOIN canon ON header = col
      UNION ALL SELECT file, header, 3, pos, col FROM keyed JOIN canon ON k = col
      UNION ALL SELECT file, header, 4, pos, col FROM keyed JOIN alias ON k <> '' AND (contains(k, pat) OR contains(pat, k))
      UNION ALL SELECT file, header, 5, pos, col FROM keyed JOIN canon ON k <> '' AND (contains(k, ck) OR contains(ck, k))),
    best AS (SELECT *, row_number() OVER (PARTITION BY file, header ORDER BY tier, pos) AS rn FROM hits)
    SELECT h.file, h.header, col AS mapped_column, tier AS match_tier FROM headers h
    LEFT JOIN best ON best.file = h.file AND best.header = h.header AND rn = 1""", "headers")
def automap_headers_tiered(spark, sf_dir):
    return M.automap_headers_tiered(W.file_headers(spark, sf_dir))


@query("""SELECT application_id, person_age, loan_amnt, NULL::DOUBLE AS credit_policy, NULL::VARCHAR AS region FROM apps
          WHERE application_id % 2 = 0
          UNION ALL SELECT application_id, NULL, loan_amnt, person_age, loan_grade FROM apps
          WHERE application_id % 2 = 1""", "apps")
def evolve_schema(spark, sf_dir):
    """A table widened by the columns of later rows."""
    apps = W.applications(spark, sf_dir)
    table = apps.where("application_id % 2 = 0").select("application_id", "person_age", "loan_amnt")
    incoming = apps.where("application_id % 2 = 1").select(
        "application_id", "loan_amnt", F.col("person_age").alias("credit_policy"), F.col("loan_grade").alias("region")
    )
    return M.evolve_schema(table, incoming)


@query("""SELECT application_id AS id, created_at, NULL::TIMESTAMP AS updated_at, 'pending' AS application_status,
            NULL::VARCHAR AS notes, CAST(person_age AS DOUBLE) AS person_age, loan_grade, CAST(loan_status AS DOUBLE) AS loan_status
          FROM apps""", "apps")
def create_dynamic_table(spark, sf_dir):
    rows = W.applications(spark, sf_dir).select(
        F.col("application_id").alias("id"), "created_at", F.col("person_age").cast("int").alias("person_age"),
        "loan_grade", "loan_status",
    )
    return M.create_dynamic_table(rows)


INFERRED = ["application_id", *S.CANONICAL, "loan_status"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CASE WHEN count({c}) = count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE))
        THEN 'double' ELSE 'string' END AS inferred_type FROM apps""" for c in INFERRED), "apps")
def infer_column_type(spark, sf_dir):
    """Types of a text-only file."""
    text = files.read_text_csv(spark, _csv(spark, sf_dir)).withColumnsRenamed(S.RAW_NAMES)
    return M.infer_column_types(text, INFERRED)


@query("SELECT * EXCLUDE (loan_status) FROM apps", "apps")
def drop_targets(spark, sf_dir):
    return M.drop_targets(W.applications(spark, sf_dir))


@query("""SELECT application_id, CASE WHEN application_id % 7 <> 0 THEN person_age END AS person_age, loan_amnt
          FROM apps""", "apps")
def nan_to_null(spark, sf_dir):
    rows = W.applications(spark, sf_dir).select(
        "application_id",
        F.when(F.col("application_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("person_age")).alias("person_age"),
        "loan_amnt",
    )
    return M.nan_to_null(rows)


@query("""SELECT application_id, home_ownership, loan_grade, loan_amnt, CAST(
            (home_ownership IS NOT NULL)::INT + (loan_grade IS NOT NULL)::INT + (loan_amnt IS NOT NULL)::INT
            AS INTEGER) AS entries FROM apps""", "apps")
def pack_features(spark, sf_dir):
    """Features folded into JSON, without nulls and without the target."""
    rows = W.applications(spark, sf_dir)
    packed = M.pack_features(rows, ["home_ownership", "loan_grade", "loan_amnt", "loan_status"])
    f = F.col("input_features")
    return packed.select(
        "application_id", F.get_json_object(f, "$.home_ownership").alias("home_ownership"),
        F.get_json_object(f, "$.loan_grade").alias("loan_grade"),
        F.get_json_object(f, "$.loan_amnt").cast("double").alias("loan_amnt"),
        F.size(F.json_object_keys(f)).alias("entries"),
    )


@query("""SELECT application_id AS id, person_age, person_income, person_emp_length, loan_amnt, loan_int_rate,
            loan_percent_income, cb_person_cred_hist_length, home_ownership, loan_intent, loan_grade, default_on_file,
            CAST(NULL AS DOUBLE) AS never_seen FROM apps""", "apps")
def unpack_features(spark, sf_dir):
    """JSON features spread over columns; a key that never occurs is null."""
    packed = _feedback_rows(spark, sf_dir).select("id", "input_features")
    wider = T.StructType([*S.APPLICATION_SCHEMA.fields, T.StructField("never_seen", T.DoubleType())])
    return M.unpack_features(packed, wider)


@query("""SELECT feature FROM (
            SELECT unnest(['person_age', 'person_income', 'person_emp_length', 'loan_amnt', 'loan_int_rate',
              'loan_percent_income', 'cb_person_cred_hist_length', 'home_ownership', 'loan_intent', 'loan_grade',
              'default_on_file']) AS feature) WHERE (SELECT count(*) FROM apps) > 0""", "apps")
def feature_keys(spark, sf_dir):
    """Union of the keys that occur in the packed features."""
    return M.feature_keys(_feedback_rows(spark, sf_dir))


@query("SELECT application_id, 1000 + row_number() OVER (ORDER BY application_id) AS id FROM apps", "apps")
def link_ids(spark, sf_dir):
    """Ids after 1000, in source order."""
    return P.link_ids(W.applications(spark, sf_dir, ["application_id"]), ["application_id"], 1000)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events")
def row_index(spark, sf_dir):
    return with_row_index(W.table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query("""SELECT application_id, person_age, person_income, person_emp_length, loan_amnt, loan_int_rate,
            loan_percent_income, cb_person_cred_hist_length, upper(home_ownership) AS home_ownership,
            upper(loan_intent) AS loan_intent, upper(loan_grade) AS loan_grade,
            upper(default_on_file) AS default_on_file, loan_status FROM apps""", "apps")
def rename_original_dataset(spark, sf_dir):
    return M.rename_original_dataset(W.raw_dataset(spark, sf_dir))


_DRIFT_SQL = ", ".join(
    f"CASE WHEN {f} < {s['min']} OR {f} > {s['max']} THEN '{f} range' "
    f"WHEN {f} < {s['mean'] - 3 * s['std']!r} OR {f} > {s['mean'] + 3 * s['std']!r} THEN '{f} sigma' END"
    for f, s in S.TRAINING_STATISTICS.items()
)


@query(f"""WITH n AS (
      SELECT application_id, imputation_log AS i, list_filter([
          CASE WHEN person_age > 100 THEN 'person_age' END, CASE WHEN loan_percent_income > 1 THEN 'loan_percent_income' END
        ], lambda x: x IS NOT NULL) AS w, list_filter([{_DRIFT_SQL}], lambda x: x IS NOT NULL) AS d FROM imputed)
    SELECT application_id, concat_ws(' | ',
      CASE WHEN len(i) > 0 THEN 'Imputed ' || len(i) || ' fields: ' || array_to_string(i[1:5], ', ') END,
      CASE WHEN len(w) > 0 THEN 'Validation warnings: ' || array_to_string(w, '; ') END,
      CASE WHEN len(d) > 0 THEN 'Data drift detected: ' || array_to_string(d[1:3], '; ') END) AS operational_notes
    FROM n""", "imputed")
def operational_notes(spark, sf_dir):
    rows = drift_check(W.imputed(spark, sf_dir))
    warnings = F.array_compact(F.array(
        F.when(F.col("person_age") > 100, "person_age"), F.when(F.col("loan_percent_income") > 1, "loan_percent_income")
    ))
    drift = F.transform("drift", lambda d: F.concat_ws(" ", d["feature"], d["kind"]))
    return rows.select("application_id", X.operational_notes(F.col("imputation_log"), warnings, drift).alias("operational_notes"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace('<s>' || text || E'\n\n\n\n' || role || '</s>  ',
             '</?s>', '', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM conversations""")
def clean_response_text(spark, sf_dir):
    raw = F.concat(F.lit("<s>"), F.col("text"), F.lit("\n\n\n\n"), F.col("role"), F.lit("</s>  "))
    return W.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.clean_response(raw).alias("cleaned"))


@query(f"""SELECT column_name, count(*) AS files FROM (
      SELECT file, translate(lower(header), ' -.', '___') AS column_name FROM headers)
    WHERE column_name NOT IN ({", ".join(repr(c) for c in S.CANONICAL + S.TARGETS)}) GROUP BY column_name""", "headers")
def schema_diff_new_columns(spark, sf_dir):
    """Unknown columns over all files and how many files have them."""
    rows = W.file_headers(spark, sf_dir).withColumn("column_name", N.normalized(F.col("header")))
    new = M.schema_diff(rows, S.CANONICAL).where(F.col("status") == "new")
    return new.groupBy("column_name").agg(F.count(F.lit(1)).alias("files"))


@query(f"""SELECT file, header, column_name, CASE WHEN column_name IN ({", ".join(repr(c) for c in S.TARGETS)}) THEN 'forbidden'
      WHEN column_name IN ({", ".join(repr(c) for c in S.CANONICAL)}) THEN 'existing' ELSE 'new' END AS status
    FROM (SELECT file, header, translate(lower(header), ' -.', '___') AS column_name FROM headers)""", "headers")
def schema_diff(spark, sf_dir):
    rows = W.file_headers(spark, sf_dir).withColumn("column_name", N.normalized(F.col("header")))
    return M.schema_diff(rows, S.CANONICAL)
