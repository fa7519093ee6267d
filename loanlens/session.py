"""Session set-up and the shared work folder."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Work folder of a single-process session that sets none.
LOCAL_WORK = os.path.join(tempfile.gettempdir(), "loanlens-work")


def get_session(app: str = "loanlens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, a single-process session (``local`` or ``local[...]``) uses ``LOCAL_WORK``; a
    cluster, where a local folder would be wrong, is refused.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = LOCAL_WORK
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage so that a lost executor costs a re-read, and fixes values such as partition
    ids that would change if the plan ran again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a table scan that has fewer splits than cores (or shuffle partitions), else leave it alone.

    Meant for a few large files ahead of heavy per-row work; with many splits it adds no shuffle.
    With ``keys`` the rows are placed so that grouping by them needs no second shuffle.
    """
    spark = df.sparkSession
    tasks = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *keys)


#: Most rows of a training frame in one task.
TASK_ROWS = 250_000


def outgrows_cores(df: DataFrame) -> bool:
    """Whether a task would hold more than ``TASK_ROWS`` rows if there were one for each core."""
    return df.count() > df.sparkSession.sparkContext.defaultParallelism * TASK_ROWS


def in_even_parts(written: DataFrame) -> DataFrame:
    """A written table dealt evenly over as many tasks as there are cores, or more: about ``TASK_ROWS`` rows each at most.

    Meant for frames that many small jobs read: their time grows with the tasks if those are many and small, and a task's
    memory with its rows if they are few and large.
    """
    cores = written.sparkSession.sparkContext.defaultParallelism
    waves = -(-written.count() // (cores * TASK_ROWS))
    return written.repartition(cores * max(waves, 1))


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
