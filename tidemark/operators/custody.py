"""What the edge lane holds: scans, counts of what was taken and left out, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import ingest


def edges_between(edges: DataFrame, collection: str, since_us: int, until_us: int, op: str = "create") -> DataFrame:
    """Edges of one collection and operation observed in [since_us, until_us); order them where they are shown."""
    return edges.where((F.col("collection") == collection) & (F.col("op") == op) & (F.col("observed_us") >= since_us) & (F.col("observed_us") < until_us))


def skips(rows: DataFrame) -> DataFrame:
    """(lane, reason, n) of extracted messages."""
    return rows.groupBy("lane", "reason").agg(F.count(F.lit(1)).alias("n"))


def counts(rows: DataFrame) -> DataFrame:
    """(what, name, n, first_us, last_us): edges by collection and operation, status changes by status, and all that was seen."""
    name = F.when(F.col("lane") == "edge", F.concat_ws(".", "collection", "op")).when(F.col("lane") == "status", F.col("status")).otherwise(F.col("reason"))
    seen = rows.select(F.explode(F.array(F.struct(F.col("lane").alias("what"), name.alias("name")), F.struct(F.lit("seen").alias("what"), F.lit("all").alias("name")))).alias("x"), "observed_us")
    return seen.groupBy("x.what", "x.name").agg(F.count(F.lit(1)).alias("n"), F.min("observed_us").alias("first_us"), F.max("observed_us").alias("last_us"))


def flush_totals(health: DataFrame) -> DataFrame:
    """Per run the last state of the sink's cumulative counters (run_id, flush_seq, seen, stored_edges, stored_status,
    dropped, first_event_us, last_event_us): they only grow, so the greatest is the last."""
    most = ["flush_seq", "seen", "stored_edges", "stored_status", "dropped"]
    return health.groupBy("run_id").agg(*[F.max(c).alias(c) for c in most], F.min("first_event_us").alias("first_event_us"), F.max("last_event_us").alias("last_event_us"))


def status_receipt() -> Column:
    """Content address of a status change."""
    return scalars.receipt(scalars.stable_json(actor=F.col("actor"), observed_us=F.col("observed_us"), active=F.col("active"), status=F.col("status")))


def window_receipt() -> Column:
    """Content address of a metric's window."""
    fields = ("run_id", "bucket_start", "bucket_width", "metric", "count", "observed_duration_us", "coverage_state")
    return scalars.receipt(scalars.stable_json(**{c: F.col(c) for c in fields}))


def receipts_of(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(actor, receipt) of the edges of some actors."""
    return edges.join(members.select("actor"), "actor", "left_semi").select("actor", ingest.event_receipt(edges).alias("receipt"))
