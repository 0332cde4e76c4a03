"""One commit for everything that a batch of a collection brings: counts, health, and the cursor to resume from.

A batch's tables are written first, each into a folder of its own; the marker that names them is written last, in one file.
Readers take only what a marker names, so a batch is there as a whole or not at all, whenever the writer dies.  A batch that is
written again before its marker replaces what was left; after it, nothing happens.

Runs are rows that are only added: one when a run starts, one when it ends.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import IntegrityError, duplicates, held, remove, shared_folder

MARKERS, RUNS = "_commits", "_runs"
MARKER = "batch_id long, run_id string, endpoint string, cursor_us long, windows long, first_event_us long, last_event_us long"
RUN = "run_id string, what string, at_us long, endpoint string, version string, width int, planned_end_us long, resume_cursor_us long, reason string"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def markers(spark: SparkSession, root: str) -> DataFrame:
    """What has been committed, a row for each batch."""
    return _rows(spark, f"{root}/{MARKERS}", MARKER)


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's rows of the batches that have a marker."""
    return spark.read.parquet(f"{root}/{name}").join(F.broadcast(markers(spark, root).select("batch_id")), "batch_id", "left_semi")  # a row a batch


def cursor(spark: SparkSession, root: str, endpoint: str) -> int | None:
    """The greatest event time whose contribution is committed for an endpoint; null before the first."""
    return markers(spark, root).where(F.col("endpoint") == endpoint).agg(F.max("cursor_us")).first()[0]


def commit(windows: DataFrame, root: str, batch: int, run_id: str, endpoint: str, cursor_us: int | None = None) -> bool:
    """Commits the closed windows of a batch (as ``window_stream`` gives them); false if the batch is committed already.

    cursor_us: where to resume from; by default the greatest event time in the windows.  Refused: a cursor beyond that, or one
    without any window; windows that repeat, or that an earlier batch of the run has; the same number for another run's batch.
    """
    spark = windows.sparkSession
    known = markers(spark, root).where(F.col("batch_id") == batch).first()
    if known:
        if (known.run_id, known.endpoint) != (run_id, endpoint):
            raise IntegrityError(f"batch {batch} is another run's")
        return False
    scratch = shared_folder(spark)
    try:
        rows = held(windows.withColumnRenamed("source", "run_source").withColumn("run_id", F.lit(run_id)), scratch)
        counts = rows.where("metric IS NOT NULL").select("run_id", "run_source", "bucket_start", "bucket_width", "metric", "count")
        health = rows.drop("metric", "count").dropDuplicates(["run_source", "bucket_start"])
        n, first, last = health.agg(F.count(F.lit(1)), F.min("first_event_us"), F.max("last_event_us")).first()
        cursor_us = last if cursor_us is None else cursor_us
        if cursor_us is not None and (last is None or cursor_us > last):
            raise IntegrityError(f"the cursor {cursor_us} is beyond the greatest committed time {last}")
        keys = ["run_id", "run_source", "bucket_start"]
        if duplicates(rows, [*keys, "metric"]).limit(1).count():
            raise IntegrityError(f"a window twice in batch {batch}")
        if n and markers(spark, root).where(F.col("run_id") == run_id).limit(1).count():
            earlier = committed(spark, root, "window_health").where(F.col("run_id") == run_id)
            if earlier.join(health.select(*keys), keys, "left_semi").limit(1).count():
                raise IntegrityError(f"a window of batch {batch} is committed already")
        for table, df in (("bucket", counts), ("window_health", health)):
            df.write.mode("overwrite").parquet(f"{root}/{table}/batch_id={batch}")
        marker = spark.createDataFrame([(batch, run_id, endpoint, cursor_us, n, first, last)], MARKER)
        marker.coalesce(1).write.mode("append").parquet(f"{root}/{MARKERS}")
    finally:
        remove(spark, scratch)
    return True


def start_run(spark: SparkSession, root: str, run_id: str, endpoint: str, width: int, at_us: int, *, version: str = "", planned_end_us: int | None = None) -> int | None:
    """Adds the row of a run that begins; the cursor that it resumes from."""
    if _rows(spark, f"{root}/{RUNS}", RUN).where(F.col("run_id") == run_id).limit(1).count():
        raise IntegrityError(f"run {run_id} exists")
    resumed = cursor(spark, root, endpoint)
    spark.createDataFrame([(run_id, "started", at_us, endpoint, version, width, planned_end_us, resumed, None)], RUN).coalesce(1).write.mode("append").parquet(f"{root}/{RUNS}")
    return resumed


def end_run(spark: SparkSession, root: str, run_id: str, at_us: int, reason: str) -> None:
    """Adds the row of a run that ends."""
    spark.createDataFrame([(run_id, "ended", at_us, None, None, None, None, None, reason)], RUN).coalesce(1).write.mode("append").parquet(f"{root}/{RUNS}")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, endpoint, version, width, started_us, ended_us, planned_end_us, resume_cursor_us, first_event_us, last_event_us,
    windows, state, reason): a row for each run.

    The first end of a run counts.  A run without one is ``open``, or ``interrupted`` if a later one began at its endpoint.
    """
    rows = _rows(spark, f"{root}/{RUNS}", RUN)
    started, ended = F.col("what") == "started", F.col("what") == "ended"
    of = lambda c: F.max(F.when(started, F.col(c))).alias(c)
    found = rows.groupBy("run_id").agg(of("endpoint"), of("version"), of("width"), F.max(F.when(started, F.col("at_us"))).alias("started_us"), F.min(F.when(ended, F.col("at_us"))).alias("ended_us"), of("planned_end_us"), of("resume_cursor_us"), F.min_by("reason", F.when(ended, F.col("at_us"))).alias("reason"))
    newest = found.groupBy(F.col("endpoint").alias("at")).agg(F.max("started_us").alias("newest"))
    seen = markers(spark, root).groupBy("run_id").agg(F.min("first_event_us").alias("first_event_us"), F.max("last_event_us").alias("last_event_us"), F.sum("windows").alias("windows"))
    found = found.join(newest, found["endpoint"] == newest["at"], "left").join(seen, "run_id", "left").fillna(0, ["windows"])
    state = F.when(F.col("ended_us").isNotNull(), "ended").when(F.col("started_us") < F.col("newest"), "interrupted").otherwise("open")
    return found.select("run_id", "endpoint", "version", "width", "started_us", "ended_us", "planned_end_us", "resume_cursor_us", "first_event_us", "last_event_us", "windows", state.alias("state"), "reason")
