"""Filters, paging, top rows and aggregate reports over the stored tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.risk import outcome_label, percent, ratio_or_zero
from loanlens.operators.encode import share_of_total
from loanlens.operators.ordered import with_group_index


# -- filters and paging -----------------------------------------------------

def by_id(df: DataFrame, value: int, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def applications_by_status(df: DataFrame, status: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of applications in id order."""
    if status:
        df = df.where(F.col("application_status") == status)
    return df.orderBy("id").offset(skip).limit(limit)


def prediction_history(df: DataFrame, model_type: str | None = None, application_id: int | None = None,
                       skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of predictions, newest first."""
    if model_type is not None:
        df = df.where(F.col("model_type") == model_type)
    if application_id is not None:
        df = df.where(F.col("application_id") == application_id)
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(limit)


def with_feedback(df: DataFrame) -> DataFrame:
    return df.where(F.col("actual_outcome").isNotNull())


def risk_like(df: DataFrame, pattern: str = "%High Risk%") -> DataFrame:
    return df.where(F.col("risk_level").like(pattern))


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of an order (samples, previews, caps)."""
    return df.orderBy(*order).limit(n)


def recent_predictions(df: DataFrame, n: int = 10) -> DataFrame:
    return first_rows(df, [F.desc("created_at"), F.desc("id")], n)


def metrics_history(metrics: DataFrame, model_type: str | None = None, limit: int = 10) -> DataFrame:
    if model_type is not None:
        metrics = metrics.where(F.col("model_type") == model_type)
    return first_rows(metrics, [F.desc("evaluation_date"), F.desc("model_version")], limit)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; the rank filter keeps one row per key and partition before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


# -- aggregate reports ------------------------------------------------------

def prediction_statistics(df: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    counted = df.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(level.like("%High Risk%")).alias("high_risk_count"),
        F.count_if(level.like("%Borderline Risk%")).alias("borderline_risk_count"),
        F.count_if(level.like("%Low Risk%")).alias("low_risk_count"),
    )
    share = percent(F.col("high_risk_count"), F.col("total_predictions"))
    return counted.withColumn("high_risk_percentage", share)


def application_statistics(df: DataFrame) -> DataFrame:
    status = F.col("application_status")
    return df.agg(
        F.count(F.lit(1)).alias("total_applications"),
        *[F.count_if(status == s).alias(s) for s in ("pending", "approved", "rejected")],
    )


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and the total."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("table_name"), "n") for k, t in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return union.rollup("table_name").agg(F.sum("n").alias("record_count")).select(
        F.coalesce("table_name", F.lit("total")).alias("table_name"), "record_count"
    )


def count_and_percent(df: DataFrame, key: str) -> DataFrame:
    """``(key, n, percentage)`` per value."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(counts).select(key, "n", (F.col("share") * 100).alias("percentage"))


def by_outcome(predictions: DataFrame) -> DataFrame:
    known = with_feedback(predictions)
    return count_and_percent(known, "actual_outcome").withColumn("outcome_label", outcome_label(F.col("actual_outcome")))


def feedback_rate(predictions: DataFrame) -> DataFrame:
    counted = predictions.agg(F.count(F.lit(1)).alias("total"), F.count("actual_outcome").alias("with_feedback"))
    return counted.withColumn("feedback_pct", percent(F.col("with_feedback"), F.col("total")))


def quick_check(predictions: DataFrame, applications: DataFrame, newest: int = 5) -> DataFrame:
    """``(section, item, value)``: counts, risk shares, feedback, and the newest predictions' scores."""
    level = F.col("risk_level")
    numbers = predictions.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(level.like("%High%")).alias("high"),
        F.count_if(level.like("%Low%")).alias("low"), F.count("actual_outcome").alias("known"),
    )

    def line(section: str, item: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), value.cast("double").alias("value"))

    report = numbers.select(F.inline(F.array(
        line("records", "predictions", F.col("total")),
        line("risk", "high_pct", percent(F.col("high"), F.col("total"))),
        line("risk", "low_pct", percent(F.col("low"), F.col("total"))),
        line("feedback", "with_outcome", F.col("known")),
    )))
    apps = applications.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(line("records", "applications", F.col("n")))))
    recent = recent_predictions(predictions, newest).select(
        F.lit("recent").alias("section"), F.col("id").cast("string").alias("item"),
        F.col("probability_default").cast("double").alias("value"),
    )
    return report.unionByName(apps).unionByName(recent)


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "error").alias("error"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``(bin, low, high, n)``: equal-width bins over the column's range, the maximum in the last one."""
    ends = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if ends[0] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    low, width = ends[0], (ends[1] - ends[0]) / bins or 1.0
    place = F.least(F.floor((F.col(column) - low) / width).cast("int") + 1, F.lit(bins))
    return (
        df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (low + (F.col("bin") - 1) * F.lit(width)).alias("low"),
                (low + F.col("bin") * F.lit(width)).alias("high"), "n")
    )


def grid_counts(df: DataFrame, x: str, y: str, key: str, bins: int = 20) -> DataFrame:
    """Counts per x bin, y bin and key: the binned form of a scatter plot."""
    row = df.agg(*[f(c).cast("double") for c in (x, y) for f in (F.min, F.max)]).first()

    def place(c: str, low: float | None, high: float | None) -> Column:
        if low is None:
            return F.lit(None).cast("int")
        width = (high - low) / bins or 1.0
        return F.least(F.floor((F.col(c) - low) / width).cast("int") + 1, F.lit(bins))

    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(place(x, row[0], row[1]).alias("x_bin"), place(y, row[2], row[3]).alias("y_bin"), key)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``row`` x ``column`` over a stated value list."""
    pivoted = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    return pivoted.withColumnsRenamed({str(v): f"{column}_{v}" for v in values})


def business_insights(df: DataFrame, label: str = "loan_status") -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == 0).alias("approved"),
        F.count_if(F.col(label) == 1).alias("rejected"),
    )
    return counted.withColumns({
        "approved_pct": percent(F.col("approved"), F.col("total")),
        "rejected_pct": percent(F.col("rejected"), F.col("total")),
    })


# -- request log ------------------------------------------------------------

def request_log_stats(log: DataFrame) -> DataFrame:
    good = F.coalesce(F.col("success"), F.lit(False))
    counted = log.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"))
    return counted.withColumns({
        "success_pct": percent(F.col("successful"), F.col("total")),
        "failure_pct": percent(F.col("failed"), F.col("total")),
    })


def request_log_breakdown(log: DataFrame) -> DataFrame:
    """``(dimension, key, n)`` by provider, model and endpoint; missing keys count as Unknown."""
    dims = ["provider", "model", "endpoint"]
    filled = log.select(*[F.coalesce(d, F.lit("Unknown")).alias(d) for d in dims])
    return filled.groupingSets([[d] for d in dims], *dims).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")).select(
        F.when(F.col("g") == 3, "provider").when(F.col("g") == 5, "model").otherwise("endpoint").alias("dimension"),
        F.coalesce(*dims).alias("key"), "n",
    )


def request_rate(log: DataFrame) -> DataFrame:
    """One row: requests, seconds between the first and the last, requests per minute."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return log.agg(F.count(F.lit(1)).alias("total_requests"), span.alias("duration_seconds")).withColumn(
        "requests_per_minute", ratio_or_zero(F.col("total_requests"), F.col("duration_seconds")) * 60
    )


def requests_by_source(log: DataFrame) -> DataFrame:
    return log.groupBy(F.concat_ws(":", "provider", "model").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def running_request_count(log: DataFrame, blocks: int | None = None) -> DataFrame:
    """Add ``session_count``: the request's number within its provider and model, in arrival order."""
    return with_group_index(log, ["provider", "model"], ["ts", "id"], "session_count", blocks)


def recent_requests(log: DataFrame, n: int = 10) -> DataFrame:
    newest = first_rows(log, [F.desc("ts"), F.desc("id")], n)
    return newest.select(
        "id", F.date_format("ts", "HH:mm:ss").alias("time"), "provider",
        F.substring("model", 1, 30).alias("model"), "success",
    )


# -- chat history -----------------------------------------------------------

def recent_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` turns of each conversation, oldest first, as ``role: text`` lines.

    The rank filter lets Spark keep ``n`` rows per conversation and partition before the shuffle.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= n)
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda t: F.concat(t["role"], F.lit(": "), t["text"]),
    )
    return kept.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.array_join(lines, "\n").alias("history")
    )
