"""Structured Streaming jobs: import with scoring, running numbers, and request counts by window and session.

Each job ends when all files present are done; started again with the same folders it goes on with the next ones.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loanlens.operators import reports as R
from loanlens.operators.mapping import create_dynamic_table
from loanlens.plans import imports
from loanlens.plans.score import Scorer, score_batch
from loanlens.streaming.journal import Journal


def scored_rows(rows: DataFrame, scorer: Scorer, key: str = "application_id") -> DataFrame:
    """The scored columns that a table can hold."""
    return score_batch(rows, scorer, key).select(
        key, "status", "error", "risk_level", "probability_default", "binary_prediction",
        F.size("imputation_log").alias("imputed_fields"),
    )


def import_batch(journal: Journal, batch: DataFrame, number: int, scorer: Scorer, order: list[str], mapping: dict | None = None) -> None:
    """One batch of history rows into ``applications`` and ``predictions``.

    Columns are mapped, rows numbered in ``order`` after those of earlier batches, and scored. A batch that comes
    again gets the same ids and replaces its own attempt, or is skipped if it was finished.
    """
    last = journal.begin(number)
    if last is None:
        return
    stored = imports.stored_history(batch, order, mapping, last)
    journal.write("applications", number, create_dynamic_table(stored))
    # the outcome travels with the id, so that nothing is joined
    linked = imports.coerce_outcome(stored).withColumn("link", F.struct("id", "actual_outcome"))
    scored = scored_rows(linked, scorer, "link")
    journal.write("predictions", number, scored.select("link.id", *[c for c in scored.columns if c != "link"], "link.actual_outcome").withColumnRenamed("id", "application_id"))
    rows = journal.read_batch("applications", number).count()
    journal.commit(number, last + rows, rows)


def stream_import_and_score(spark: SparkSession, source: str, schema: T.StructType, scorer: Scorer, root: str, order: list[str],
                            mapping: dict | None = None, file_format: str = "parquet", files_per_batch: int = 1000, **options) -> StreamingQuery:
    """Import and score every file that arrives under ``source``, exactly once, into the tables of ``Journal(root)``.

    ``schema`` has the files' own headers; ``order`` names columns, after mapping, that order the rows of a batch. Ids
    are unique over batches and restarts. A row that breaks a rule keeps its application and gets status ``error``.
    """
    journal = Journal(spark, root)
    rows = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).load(source)

    def take(batch: DataFrame, number: int) -> None:
        import_batch(journal, batch, number, scorer, order, mapping)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", journal.checkpoint).trigger(availableNow=True).start()


def number_batch(journal: Journal, batch: DataFrame, number: int) -> None:
    """Running number of each request within its provider and model, continued from earlier batches.

    Inside a batch rows are numbered by time and id; the key of most rows spans many tasks. What is kept of earlier batches
    is one count per key and batch. A late row is numbered when it arrives, after all rows of earlier batches.
    """
    last = journal.begin(number)
    if last is None:
        return
    journal.write("requests", number, R.running_request_count(batch).withColumnRenamed("session_count", "in_batch"))
    keys = ["provider", "model"]
    rows = journal.read_batch("requests", number)
    journal.write("counts", number, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    n = rows.count()
    journal.commit(number, last + n, n)


def running_request_counts(journal: Journal) -> DataFrame:
    """Requests numbered so far, with ``session_count`` over all batches."""
    keys = ["provider", "model"]
    # what each batch starts from: one row per key and batch
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    starts = journal.read("counts").select(F.col("batch").alias("_batch"), *[F.col(k).alias(f"_{k}") for k in keys], before.alias("earlier"))
    same = (F.col("batch") == F.col("_batch")) & F.col("provider").eqNullSafe(F.col("_provider")) & F.col("model").eqNullSafe(F.col("_model"))
    rows = journal.read("requests").join(starts, same).drop("_batch", "_provider", "_model")
    return rows.withColumn("session_count", F.col("in_batch") + F.coalesce("earlier", F.lit(0))).drop("in_batch", "earlier", "batch")


def stream_running_counts(log: DataFrame, root: str) -> StreamingQuery:
    """Number the requests of a stream (``id, ts, provider, model``) into the tables of ``Journal(root)``."""
    journal = Journal(log.sparkSession, root)

    def take(batch: DataFrame, number: int) -> None:
        number_batch(journal, batch, number)

    return log.writeStream.foreachBatch(take).option("checkpointLocation", journal.checkpoint).trigger(availableNow=True).start()


# ---- windows ----

_CLOSING = T.StructType([T.StructField("ts", T.TimestampType())])


def request_counts(log: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Requests per time window and provider; a sliding window if ``slide`` is given."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = log.groupBy(window.alias("w"), "provider").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "provider", "n")


def request_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Requests per session: a provider's requests no more than ``gap`` apart."""
    counted = log.groupBy(F.session_window("ts", gap).alias("w"), "provider").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "provider", "n")


def with_closing(log: DataFrame, closing: str, late: str) -> DataFrame:
    """``log`` under a watermark that the times in the folder ``closing`` move as well; they are no requests."""
    spark = log.sparkSession
    try:
        spark.read.schema(_CLOSING).parquet(closing)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], _CLOSING).write.parquet(closing)  # a stream source needs its folder
    marks = spark.readStream.schema(_CLOSING).parquet(closing).withColumn("_mark", F.lit(True))
    both = log.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True).withWatermark("ts", late)
    # names ts, so that the filter is not moved below the watermark
    return both.where(~F.col("_mark") | F.col("ts").isNull()).drop("_mark")


def close_windows(spark: SparkSession, closing: str, after: str = "9000-01-01") -> None:
    """End the log: the next start of a job that reads ``closing`` emits every window still open. Later requests are late."""
    spark.sql(f"SELECT timestamp '{after}' AS ts").coalesce(1).write.mode("append").parquet(closing)


def _append(counts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    writer = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(target)


def stream_request_counts(log: DataFrame, target: str, checkpoint: str, size: str = "1 hour",
                          slide: str | None = None, late: str = "10 minutes", closing: str | None = None) -> StreamingQuery:
    """Append each window's counts once the watermark has passed it.

    ``log`` is a streaming frame with ``ts`` (timestamp) and ``provider``. Requests later than ``late`` behind the newest one are
    left out and counted in the query's progress. With a folder ``closing``, windows open at the end come with
    ``close_windows``.
    """
    marked = with_closing(log, closing, late) if closing else log.withWatermark("ts", late)
    return _append(request_counts(marked, size, slide), target, checkpoint)


def stream_request_sessions(log: DataFrame, target: str, checkpoint: str, gap: str = "30 minutes", late: str = "10 minutes",
                            closing: str | None = None) -> StreamingQuery:
    """Append each session once the watermark has passed its end; late requests and ``closing`` as for windows."""
    marked = with_closing(log, closing, late) if closing else log.withWatermark("ts", late)
    return _append(request_sessions(marked, gap), target, checkpoint)
