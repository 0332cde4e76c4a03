"""Windows of counts and of observation quality.

Two tables carry everything: ``bucket`` (run_id, bucket_start, bucket_width, metric, count) holds counts, sparse; ``health``
holds a row for each window that was observed.  No health row means not observed (null); a health row without a bucket row
means observed and none seen (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, vocab

MAX_POINTS = 200_000


class QueryTooLarge(ValueError):
    """The grid asked for has too many windows; cutting it short would make an incomplete series look complete."""


class NotSummable(ValueError):
    """The runs are not pieces of one observation."""


def count_windows(events: DataFrame, width: int) -> DataFrame:
    """``bucket`` from (run_id, us, metric)."""
    return events.groupBy("run_id", scalars.bucket_start(F.col("us"), width).alias("bucket_start"), F.lit(width).alias("bucket_width"), "metric").agg(F.count(F.lit(1)).alias("count"))


def located_gaps(events: DataFrame, longest_us: int) -> DataFrame:
    """(run_id, gap_from, gap_to): stretches without an event longer than ``longest_us``.

    No such stretch lies within a cell of time that is no longer than that, so the first and last event of each cell decide:
    events are only aggregated, and what is put in order is a row for each cell.
    """
    cells = events.groupBy("run_id", F.floor(F.col("us") / F.lit(longest_us)).alias("cell")).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    before = F.lag("last").over(Window.partitionBy("run_id").orderBy("cell"))
    return cells.select("run_id", before.alias("gap_from"), F.col("first").alias("gap_to")).where(F.col("gap_to") - F.col("gap_from") > longest_us)


def health_of(events: DataFrame, width: int, gap_us: int, *, lossy: Column | None = None, loss_share: float = 0.02, warmup: int = 3) -> DataFrame:
    """``health`` from (run_id, us): a row for each window with an event.

    Gaps are taken off the observed duration of every window that they overlap; the first and last window of a run are
    observed from its first and to its last event.  lossy: events that count as lost.  The state is ``warming_up`` for the
    first windows of a run, then ``degraded`` where there is a reason (``gap_observed``, ``loss_observed``), else ``ok``.
    """
    lost = F.coalesce(lossy.cast("int"), F.lit(0)) if lossy is not None else F.lit(0)
    start = scalars.bucket_start(F.col("us"), width)
    seen = events.groupBy("run_id", start.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("events_seen"), F.sum(lost).cast("long").alias("parse_errors"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    gaps = located_gaps(events, gap_us)
    reach = F.sequence(scalars.bucket_start(F.col("gap_from"), width), scalars.bucket_start(F.col("gap_to") - 1, width), F.lit(width).cast("long"))
    parts = gaps.select("run_id", "gap_from", "gap_to", F.explode(reach).alias("bucket_start"))
    lo, hi = F.col("bucket_start") * scalars.MICROS, (F.col("bucket_start") + width) * scalars.MICROS
    parts = parts.groupBy("run_id", "bucket_start").agg(F.sum(F.least("gap_to", hi) - F.greatest("gap_from", lo)).alias("gap_us"))
    runs = Window.partitionBy("run_id")
    joined = seen.join(parts, ["run_id", "bucket_start"], "left").withColumn("gap_us", F.coalesce("gap_us", F.lit(0).cast("long")))
    joined = joined.withColumns({"i": F.row_number().over(runs.orderBy("bucket_start")), "k": F.count(F.lit(1)).over(runs)})
    begin, end = F.when(F.col("i") == 1, F.col("first_us")).otherwise(lo), F.when(F.col("i") == F.col("k"), F.col("last_us")).otherwise(hi)
    duration = F.greatest(F.lit(0).cast("long"), end - begin - F.col("gap_us"))
    reasons = F.array_compact(F.array(F.when(F.col("gap_us") > 0, "gap_observed"), F.when(F.col("parse_errors") > loss_share * F.col("events_seen"), "loss_observed")))
    out = joined.withColumn("observed_duration_us", duration.cast("long")).withColumn("gate_reasons", reasons)
    state = F.when(F.col("i") <= warmup, "warming_up").when(F.size("gate_reasons") > 0, "degraded").otherwise("ok")
    zero = F.lit(0).cast("long")
    return out.select(
        "run_id", "bucket_start", F.lit(width).alias("bucket_width"), "events_seen", "parse_errors", zero.alias("unclassified"), zero.alias("rejected_no_time_us"),
        zero.alias("late_events"), F.lit(None).cast("double").alias("lag_ewma_s"), F.lit(None).cast("double").alias("lag_max_s"), zero.alias("reconnects"), "gap_us",
        (F.col("gap_us") > 0).alias("resume_seam"), F.col("first_us").alias("observed_from_us"), F.col("last_us").alias("observed_to_us"), "observed_duration_us",
        state.alias("coverage_state"), "gate_reasons", (F.col("observed_duration_us") < width * scalars.MICROS).alias("partial"),
    )


def flags() -> Column:
    """The flags of a health row, sorted.  Only measured incompleteness disqualifies counts; lateness and recovery do not."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    gap, loss = n("gap_us") > 0, n("parse_errors") + n("rejected_no_time_us") + n("late_events") > 0
    partial, degraded = F.coalesce(F.col("partial"), F.lit(False)), F.col("coverage_state") == "degraded"
    reasons = F.coalesce(F.col("gate_reasons"), F.array().cast("array<string>"))
    serious = F.size(F.array_except(reasons, F.array(*map(F.lit, vocab.LATENCY_REASONS)))) > 0
    serious = serious | partial | gap | loss
    found = F.array(
        F.when(partial, "partial"), F.when(F.col("resume_seam"), "seam"), F.when(gap, "gap"), F.when(loss, "loss"),
        F.when(degraded & serious, "degraded"), F.when(degraded & ~serious & (F.size(reasons) > 0), "lagged"),
        F.when(degraded & ~serious & (F.size(reasons) == 0), "recovering"), F.when(F.col("coverage_state") == "warming_up", "warming_up"),
    )
    return F.array_sort(F.array_compact(found))


def eligible(flag: Column, count: Column) -> Column:
    bad = F.array(*map(F.lit, (*vocab.INELIGIBLE, vocab.UNOBSERVED)))
    return count.isNotNull() & ~F.arrays_overlap(flag, bad)


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Pieces of one window (of runs that follow each other) as one: counts and durations add, the duration up to the width;
    flags unite, but ``partial`` is decided anew; of the states the worst stays."""
    full = F.first("bucket_width").cast("long") * F.lit(scalars.MICROS)
    seen = F.sum("observed_duration_us")
    one = F.count(F.lit(1)) == 1
    rest = F.array_remove(F.array_distinct(F.flatten(F.collect_list("flags"))), "partial")
    joint = F.when(seen < full, F.array_append(rest, F.lit("partial"))).otherwise(rest)
    joint = F.when(one, F.flatten(F.collect_list("flags"))).otherwise(joint)
    state = F.when(F.max((F.col("coverage_state") == "degraded").cast("int")) == 1, "degraded").when(F.max((F.col("coverage_state") == "warming_up").cast("int")) == 1, "warming_up")
    return parts.groupBy(*by, "bucket_start").agg(
        F.first("bucket_width").alias("bucket_width"), F.sum("count").alias("count"), F.sum("events_seen").alias("events_seen"),
        F.least(seen, full).cast("long").alias("observed_duration_us"), F.array_sort(joint).alias("flags"), state.otherwise(F.max("coverage_state")).alias("coverage_state"),
        F.min("run_id").alias("run_id"), F.sum("gap_us").alias("gap_us"), F.max("lag_ewma_s").alias("lag_ewma_s"), F.max("lag_max_s").alias("lag_max_s"), F.count(F.lit(1)).alias("pieces"),
    )


def grid(points: DataFrame, width: int, max_points: int = MAX_POINTS, since: int | None = None, until: int | None = None) -> DataFrame:
    """(bucket_start) of every window between the first and the last one, or the given bounds (seconds, the end excluded)."""
    lo, hi = points.agg(F.min("bucket_start"), F.max("bucket_start")).first()
    lo, hi = lo if since is None else since, (None if hi is None else hi + width) if until is None else until
    n = 0 if lo is None or hi is None else (hi - lo) // width
    if n > max_points:
        raise QueryTooLarge(f"{n} windows asked for, at most {max_points}")
    return points.sparkSession.range(0, max(0, n)).select((F.lit(lo or 0) + F.col("id") * width).alias("bucket_start"))


def series(health: DataFrame, bucket: DataFrame, metrics: list[str], width: int, *, densify: bool = True, since: int | None = None, until: int | None = None, max_points: int = MAX_POINTS) -> DataFrame:
    """Points of one or more metrics on one grid: (metric, bucket_start, bucket_width, count, events_seen,
    observed_duration_us, flags, coverage_state, run_id, gap_us, lag_ewma_s, lag_max_s, quality, eligible, rate)."""
    if since is not None:
        health = health.where(F.col("bucket_start") >= since)
    if until is not None:
        health = health.where(F.col("bucket_start") < until)
    each = F.explode(F.array(*map(F.lit, metrics)))  # a row of every window for each asked metric
    wide = health.withColumn("flags", flags()).withColumn("metric", each)
    counted = wide.join(bucket.select("run_id", "bucket_start", "metric", "count"), ["run_id", "bucket_start", "metric"], "left")
    points = merged(counted.withColumn("count", F.coalesce("count", F.lit(0).cast("long"))), ["metric"]).drop("pieces")
    if densify:
        empty = grid(health, width, max_points, since, until).withColumn("metric", each)
        points = empty.join(points, ["metric", "bucket_start"], "left").withColumns({
            "bucket_width": F.lit(width), "observed_duration_us": F.coalesce("observed_duration_us", F.lit(0).cast("long")),
            "flags": F.coalesce("flags", F.array(F.lit(vocab.UNOBSERVED))), "coverage_state": F.coalesce("coverage_state", F.lit(vocab.UNOBSERVED)),
            "gap_us": F.coalesce("gap_us", F.lit(0).cast("long")),
        })
    return conditioned(points)


def conditioned(points: DataFrame) -> DataFrame:
    """Adds quality, eligible and the rate by observed time."""
    rate = F.when(F.col("observed_duration_us") > 0, F.col("count") / (F.col("observed_duration_us") / F.lit(1e6)))
    return points.withColumns({"quality": scalars.worst(F.col("flags")), "eligible": eligible(F.col("flags"), F.col("count")), "rate": rate})


def total_series(health: DataFrame, width: int, **kw) -> DataFrame:
    """All events seen as one metric, ``_events_total``."""
    counts = health.select("run_id", "bucket_start", F.lit("_events_total").alias("metric"), F.col("events_seen").alias("count"))
    return series(health, counts, ["_events_total"], width, **kw)


def metric_series(health: DataFrame, bucket: DataFrame, metric: str) -> DataFrame:
    """Windows in which the metric occurred (an inner join: observed zeros are not in it)."""
    joined = bucket.where(F.col("metric") == metric).join(health, ["run_id", "bucket_start", "bucket_width"])
    return joined.groupBy("bucket_start", "bucket_width").agg(
        F.sum("count").alias("count"), F.min("observed_duration_us").alias("observed_duration_us"), F.max(F.col("partial").cast("int")).alias("partial"),
        F.max((F.col("coverage_state") == "degraded").cast("int")).alias("degraded"), F.max(F.col("resume_seam").cast("int")).alias("resume_seam"),
    )


def interval_coverage(health: DataFrame) -> DataFrame:
    """Bounds on the union of observed time, in one row.  Pieces of a window cover at least their longest and at most their
    sum or the width; bad durations and grids are refused."""
    full = F.col("bucket_width").cast("long") * scalars.MICROS
    width, start = F.col("bucket_width"), F.col("bucket_start")
    bad_grid = (width <= 0) | (F.pmod(start, F.when(width > 0, width)) != 0)
    d = F.col("observed_duration_us")
    checked = health.select(
        start, width, F.when(bad_grid, F.raise_error(F.lit("windows of more than one grid")).cast("long"))
        .when((d < 0) | (d > full), F.raise_error(F.lit("an observed duration that its window cannot hold")).cast("long")).otherwise(d).alias("d"),
    )
    per = checked.groupBy("bucket_start", "bucket_width").agg(F.max("d").alias("largest"), F.sum("d").alias("sum"), F.count(F.lit(1)).alias("pieces"))
    upper = F.least("sum", F.col("bucket_width").cast("long") * scalars.MICROS)
    out = per.agg(
        F.min("bucket_start").alias("first_start"), F.max(F.col("bucket_start") + F.col("bucket_width")).alias("last_end"), (F.sum("largest") / 1e6).alias("lower_s"), (F.sum(upper) / 1e6).alias("upper_s"),
        (F.sum("sum") / 1e6).alias("recorded_s"), F.count_if(F.col("pieces") > 1).alias("split_windows"), F.count_if(F.col("largest") != upper).alias("uncertain_windows"),
        F.count_distinct("bucket_width").alias("widths"),
    )
    out = out.withColumn("lower_s", F.when(F.col("widths") > 1, F.raise_error(F.lit("windows of more than one grid")).cast("double")).otherwise(F.col("lower_s")))
    span, lo, hi = F.col("last_end") - F.col("first_start"), F.col("lower_s"), F.col("upper_s")
    status = F.when(lo.isNull(), "unavailable").when(lo == hi, "exact").otherwise("bounded")
    return out.drop("widths").withColumns({"lower_ratio": F.try_divide(lo, span), "upper_ratio": F.try_divide(hi, span), "observed_s": F.when(lo == hi, lo), "status": status})


def sum_series(points: DataFrame, parts: list[str], name: str) -> DataFrame:
    """Several metrics of one grid added up; a window that any of them did not observe is not observed."""
    grouped = points.where(F.col("metric").isin(parts)).groupBy("bucket_start").agg(
        F.first("bucket_width").alias("bucket_width"), F.when(F.count("count") == len(set(parts)), F.sum("count")).alias("count"), F.first("events_seen").alias("events_seen"),
        F.max("observed_duration_us").alias("d"), F.first("flags").alias("f"), F.first("coverage_state").alias("s"), F.max("gap_us").alias("gap_us"),
    )
    known = F.col("count").isNotNull()
    return conditioned(grouped.select(
        F.lit(name).alias("metric"), "bucket_start", "bucket_width", "count", "events_seen", F.when(known, F.col("d")).otherwise(0).cast("long").alias("observed_duration_us"),
        F.when(known, F.col("f")).otherwise(F.array(F.lit(vocab.UNOBSERVED))).alias("flags"), F.when(known, F.col("s")).otherwise(vocab.UNOBSERVED).alias("coverage_state"), "gap_us",
    ))


def collapse(points: DataFrame, columns: int) -> DataFrame:
    """Points of a metric in at most so many columns: least, greatest, worst quality, whether any was not observed."""
    order = Window.partitionBy("metric").orderBy("bucket_start")
    sized = points.join(points.groupBy("metric").agg(F.count(F.lit(1)).alias("__n")), "metric")
    placed = sized.withColumn("column", F.floor((F.row_number().over(order) - 1) / F.greatest(F.lit(1), F.ceil(F.col("__n") / columns))).cast("int"))
    rank = F.create_map(*[x for i, q in enumerate((*vocab.PRECEDENCE, vocab.CLEAN)) for x in (F.lit(q), F.lit(i))])
    return placed.groupBy("metric", "column").agg(
        F.min("bucket_start").alias("bucket_start"), F.min("rate").alias("low"), F.max("rate").alias("high"), F.min_by("quality", rank[F.col("quality")]).alias("worst"),
        F.bool_or(F.col("count").isNull()).alias("any_unobserved"), F.count(F.lit(1)).alias("windows"),
    )


def commit_cursor(windows: DataFrame) -> DataFrame:
    """The latest event time that the windows hold; empty ones do not move it."""
    return windows.agg(F.max("observed_to_us").alias("cursor_us"))
