"""Runs: summaries, status, and which of them may be added up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, vocab
from .windows import NotSummable


def aggregates(health: DataFrame) -> DataFrame:
    """Per run: windows of each kind, events, durations and losses."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    whole = ~F.col("partial") & (F.col("gap_us") == 0) & (F.col("parse_errors") == 0) & (F.col("rejected_no_time_us") == 0) & (F.col("late_events") == 0)
    reasons = F.coalesce("gate_reasons", F.array().cast("array<string>"))
    late_only = whole & (F.size(F.array_except(reasons, F.array(*map(F.lit, vocab.LATENCY_REASONS)))) == 0)
    degraded = F.col("coverage_state") == "degraded"
    return health.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("partial").alias("partial_windows"), F.count_if(F.col("events_seen") == 0).alias("empty_windows"),
        F.count_if(degraded & ~late_only).alias("degraded_windows"), F.count_if(degraded & late_only).alias("lagged_windows"), F.count_if("resume_seam").alias("seam_windows"),
        F.count_if(F.col("gap_us") > 0).alias("gap_windows"), n("events_seen").alias("events"), n("observed_duration_us").alias("observed_duration_us"),
        (n("bucket_width") * scalars.MICROS).alias("nominal_duration_us"), n("gap_us").alias("gap_us"), n("reconnects").alias("reconnects"), n("parse_errors").alias("parse_errors"),
        n("unclassified").alias("unclassified"), n("rejected_no_time_us").alias("rejected_no_time_us"), n("late_events").alias("late_events"),
        F.max("lag_ewma_s").alias("lag_ewma_max_s"), F.max("lag_max_s").alias("lag_max_s"),
    )


def summaries(runs: DataFrame, health: DataFrame, newest: int | None = None) -> DataFrame:
    """A row for each run (only the newest so many, if asked): its own columns, aggregates, status, spans, coverage ratio."""
    if newest is not None:
        runs = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(newest)
    out = runs.join(aggregates(health), "run_id", "left").fillna(0, ["windows", "gap_windows", "degraded_windows", "events"])
    status = (
        F.when(F.col("ended_at").isNull(), "open").when(~F.coalesce(F.col("stop_reason").isin(*vocab.NORMAL_STOPS), F.lit(False)), "interrupted")
        .when((F.col("gap_windows") > 0) | (F.col("degraded_windows") > 0), "partial").otherwise("complete")
    )
    return out.withColumns({
        "status": status, "wall_duration_s": (F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(1e6), "data_span_s": (F.col("last_event_us") - F.col("first_event_us")) / F.lit(1e6),
        "coverage_ratio": scalars.ratio(F.col("observed_duration_us"), F.col("nominal_duration_us")), "replayed": F.col("resume_cursor_at_start").isNotNull(),
    })


def spans(runs: DataFrame, health: DataFrame) -> DataFrame:
    """(run_id, endpoint, start_us, end_us); a run without bounds of its own takes those of its windows."""
    seen = health.groupBy("run_id").agg(F.min(F.col("bucket_start") * scalars.MICROS).alias("lo"), F.max((F.col("bucket_start") + F.col("bucket_width")) * F.lit(scalars.MICROS).cast("long")).alias("hi"))
    joined = runs.join(seen, "run_id", "left")
    return joined.select("run_id", F.col("source_endpoint").alias("endpoint"), F.coalesce("first_event_us", "lo").alias("start_us"), F.coalesce("last_event_us", "hi").alias("end_us"))


def conflicts(runs: DataFrame, health: DataFrame) -> DataFrame:
    """(endpoint, run_id, other): runs of an endpoint that begin before an earlier one has ended."""
    order = Window.partitionBy("endpoint").orderBy("start_us", "run_id")
    dated = spans(runs, health).where("start_us is not null and end_us is not null")
    before = dated.withColumns({"other": F.lag("run_id").over(order), "until": F.lag("end_us").over(order)})
    return before.where("start_us < until").select("endpoint", "run_id", "other")


def assert_summable(runs: DataFrame, health: DataFrame) -> None:
    """Refuses runs of several endpoints and runs whose intervals overlap: a sum would count a stream twice."""
    if runs.select("source_endpoint").distinct().limit(2).count() > 1:
        raise NotSummable("runs of different endpoints are different observations")
    if clash := conflicts(runs, health).first():
        raise NotSummable(f"runs {clash.other} and {clash.run_id} overlap")


def compatible(runs: DataFrame, health: DataFrame, endpoint: str, limit: int = 50) -> DataFrame:
    """The newest runs of an endpoint that can be added up: from the newest back to the first that overlaps its successor."""
    newest = spans(runs.where(F.col("source_endpoint") == endpoint).orderBy(F.desc("started_at")).limit(limit), health)
    order = Window.partitionBy("endpoint").orderBy(F.desc("start_us"), F.desc("run_id"))
    checked = newest.withColumn("clash", F.coalesce((F.col("end_us") > F.lag("start_us").over(order)).cast("int"), F.lit(0)))
    kept = checked.withColumn("cut", F.sum("clash").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.where("cut = 0").select("run_id", "endpoint", "start_us", "end_us")


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each endpoint."""
    return runs.groupBy(F.col("source_endpoint").alias("endpoint")).agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def totals(bucket: DataFrame, by_run: bool = False) -> DataFrame:
    return bucket.groupBy(*(["run_id"] if by_run else []), "metric").agg(F.sum("count").alias("total"))


def coverage(health: DataFrame) -> DataFrame:
    return health.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("events_seen").alias("events"), F.sum("observed_duration_us").alias("observed_us"), F.sum("gap_us").alias("gap_us"), F.count_if("partial").alias("partial_windows"),
        F.min("bucket_start").alias("first_start"), F.max("bucket_start").alias("last_start"),
    )


def merged_markers(markers: DataFrame) -> DataFrame:
    """Runs from markers that are only ever appended: a run's ``start`` (what it is to do) and, once it closes, its ``end``.

    markers: (run_id, mark, source_endpoint, bucket_width, started_at, resume_cursor_at_start, ended_at, stop_reason,
    first_event_us, last_event_us), with nulls for what the other marker says.  A run without an end is open; one whose end
    is there twice has the later; one without a start is not a run.
    """
    begun = ["source_endpoint", "bucket_width", "started_at", "resume_cursor_at_start"]
    closed = ["ended_at", "stop_reason", "first_event_us", "last_event_us"]
    start, end = F.col("mark") == "start", F.col("mark") == "end"
    found = markers.groupBy("run_id").agg(
        F.max_by(F.struct(*begun), F.when(start, F.col("started_at"))).alias("s"), F.max_by(F.struct(*closed), F.when(end, F.col("ended_at"))).alias("e"), F.count_if(start).alias("starts")
    )
    return found.where("starts > 0").select("run_id", "s.*", "e.*")


def narrowest_width(runs: DataFrame, default: int = 60) -> DataFrame:
    """One row: the least width of the runs' windows."""
    return runs.agg(F.coalesce(F.min("bucket_width"), F.lit(default)).alias("bucket_width"))


def aligned_bounds(since_us: int | None, until_us: int | None, width: int) -> tuple[int | None, int | None]:
    """Bounds in microseconds as starts of windows in seconds, the end excluded: the last window is the one that holds the last
    microsecond asked for."""
    low = lambda us: us // scalars.MICROS // width * width
    return None if since_us is None else low(since_us), None if until_us is None else low(until_us - 1) + width


def lookup(runs: DataFrame, run_id: str) -> DataFrame:
    """The run of that name: one row, or none."""
    return runs.where(F.col("run_id") == run_id)


def history(runs: DataFrame, assigned_s: int | None = None) -> DataFrame:
    """One row (begins_s, origin): where a store's history begins.  It is ``created`` with the first run; a beginning that was
    assigned later than that is the one that counts."""
    first = F.unix_seconds(F.min("started_at"))
    given = F.lit(assigned_s).cast("long")
    later = F.coalesce(given > first, given.isNotNull())
    return runs.agg(F.when(later, given).otherwise(first).alias("begins_s"), F.when(later, "assigned").when(first.isNotNull(), "created").alias("origin"))
