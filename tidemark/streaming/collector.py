"""A collection run: files of JSON lines in, counts and window health out, edges beside them.

Both lanes read the same folder; each has a checkpoint of its own, so a run that is started again goes on where its last
committed batch ended and repeats nothing.  Counts, health and cursor of a batch are one commit; a run's rows say when it began,
from which cursor, and how it ended.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import commits, feed
from . import windows


def lane(lines: DataFrame, source: str) -> DataFrame:
    """(source, arrival, us, metrics, outcome) of raw lines; lines without a time keep their place in the order of arrival."""
    rows = ingest.classified(lines)
    more = [c for c in ("wall_us", "signal", "gap_us", "gap_end_us", "seam", "reconnect") if c in lines.columns]
    return rows.select(F.lit(source).alias("source"), "arrival", F.col("time_us").alias("us"), F.coalesce("metrics", F.array().cast("array<string>")).alias("metrics"), "outcome", *more)


def collect(spark: SparkSession, config: feed.Feed, root: str, *, edges: bool = True, lines: DataFrame | None = None) -> str:
    """Runs until the feed's files are used up, and gives the run's name.

    lines: a stream (value, arrival[, wall_us, signal, …]) to read in place of the folder's files, such as ``feed.frames``.
    A batch that was committed when the writer died is not committed again; one that was not is written anew.  The marker's
    batch is numbered by the stream's checkpoint, so the numbers go on from run to run, and a batch that an earlier run left
    without a marker is this one's.
    """
    run = uuid.uuid4().hex
    now = lambda: int(time.time() * 1e6)
    commits.start_run(spark, root, run, config.endpoint, config.width, now())
    # Recorded frames are read a file a task, each in order, and no file reaches into another.
    ordered = lines is not None and "position_us" in lines.columns
    closed = windows.window_stream(lane(lines if lines is not None else feed.line_stream(spark, config.folder), config.endpoint), config.width, ordered)

    def save(batch: DataFrame, number: int) -> None:
        if not commits.markers(spark, root).where(F.col("batch_id") == number).limit(1).count():
            commits.commit(batch, root, number, run, config.endpoint)

    queries = [closed.writeStream.foreachBatch(save).option("checkpointLocation", f"{root}/_checkpoints/windows").trigger(availableNow=True).start()]
    if edges and lines is None:
        found = ingest.extracted(feed.line_stream(spark, config.folder))
        queries.append(found.writeStream.format("parquet").option("path", f"{root}/lanes").option("checkpointLocation", f"{root}/_checkpoints/lanes").partitionBy("lane").trigger(availableNow=True).start())
    try:
        for q in queries:
            q.awaitTermination()
    except Exception as e:
        for q in queries:
            q.stop()
        commits.end_run(spark, root, run, now(), f"failed: {type(e).__name__}")
        raise
    commits.end_run(spark, root, run, now(), "completed")
    return run


def skips(lanes: DataFrame) -> DataFrame:
    """Lines that went into no lane, by reason."""
    return lanes.where("lane = 'skipped'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
