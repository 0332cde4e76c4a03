"""The library's operators over the driver's tables.

``events`` plays the stream (metric = event_type, actor = user_id, target = the number in props; a run = a week),
``orders`` the sequenced histories (entity = o_custkey, state = o_orderpriority), ``lineitem`` a second source of weekly
facts.  Every query comes with the SQL that gives the same rows; doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import compose, derive, edges, episodes, field, health, publish, reduce, runs, windows
from ..sources.store import dealt, held, shared_folder
from ..streaming import windows as live

METRICS = ["click", "error", "purchase", "signup", "view"]
HOUR, GAP_S = 3600, 1500
#: Which event types play which role in the field.
ROLES = {"posts": ["view"], "replies": ["click"], "reactions": ["click", "purchase", "signup"], "graph": ["signup", "error"], "blocks": ["error"], "follows": ["signup"], "creates": ["view", "click", "purchase"], "deletes": ["error"]}
RATIOS = [("click/view", "click", "view"), ("purchase/click", "purchase", "click"), ("signup/view", "signup", "view"), ("error/view", "error", "view")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def events(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(run_id, us, metric, actor, target); spread: dealt over the tasks, for work that costs much a row."""
    raw = table(spark, sf_dir, "events")
    raw = dealt(raw, "event_id") if spread else raw
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    week = scalars.week_start(F.floor(us / F.lit(scalars.MICROS)))
    return raw.select(F.concat(F.lit("w"), week.cast("string")).alias("run_id"), us.alias("us"), F.col("event_type").alias("metric"), F.col("user_id").alias("actor"), F.get_json_object("props", "$.k").cast("long").alias("target"), "event_id")


def bucket(spark: SparkSession, sf_dir: str, width: int = HOUR) -> DataFrame:
    return windows.count_windows(events(spark, sf_dir), width)


def health_rows(spark: SparkSession, sf_dir: str, width: int = HOUR, gap_s: int = GAP_S) -> DataFrame:
    return windows.health_of(events(spark, sf_dir), width, gap_s * scalars.MICROS)


def points(spark: SparkSession, sf_dir: str, metrics: list[str] = METRICS, width: int = HOUR, gap_s: int = GAP_S) -> DataFrame:
    health = held(health_rows(spark, sf_dir, width, gap_s))
    return windows.series(health, bucket(spark, sf_dir, width), metrics, width)


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir).groupBy("run_id").agg(F.min("us").alias("first_event_us"), F.max("us").alias("last_event_us"))
    return seen.select(
        "run_id", F.lit("events").alias("source_endpoint"), F.lit(HOUR).alias("bucket_width"), F.timestamp_micros("first_event_us").alias("started_at"), F.timestamp_micros("last_event_us").alias("ended_at"),
        F.lit("completed").alias("stop_reason"), F.lit(None).cast("long").alias("resume_cursor_at_start"), "first_event_us", "last_event_us",
    )


@query
def bucket_counts(spark, sf_dir):
    return bucket(spark, sf_dir).select("run_id", "bucket_start", "metric", "count")


@query
def bucket_counts_minute(spark, sf_dir):
    return bucket(spark, sf_dir, 60).select("run_id", "bucket_start", "metric", "count")


@query
def metric_totals(spark, sf_dir):
    return runs.totals(bucket(spark, sf_dir))


@query
def run_totals(spark, sf_dir):
    return runs.totals(bucket(spark, sf_dir), by_run=True)


@query
def available_metrics(spark, sf_dir):
    return bucket(spark, sf_dir).select("metric").distinct()


@query
def window_health(spark, sf_dir):
    rows = health_rows(spark, sf_dir)
    return rows.select("run_id", "bucket_start", "events_seen", "gap_us", "observed_duration_us", "coverage_state", "partial", F.array_join("gate_reasons", ",").alias("reasons"))


@query
def window_flags(spark, sf_dir):
    rows = health_rows(spark, sf_dir).withColumn("flags", windows.flags())
    return rows.select("run_id", "bucket_start", F.array_join("flags", ",").alias("flags"), scalars.worst(F.col("flags")).alias("quality"))


@query
def series_dense(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("metric", "bucket_start", "count", "observed_duration_us", F.array_join("flags", ",").alias("flags"), "quality", "eligible", "rate"))


@query
def series_dense_minute(spark, sf_dir):
    rows = points(spark, sf_dir, ["click", "error"], 60, 7200)
    return rounded(rows.select("metric", "bucket_start", "count", "quality", "eligible", "rate"))


@query
def metric_series(spark, sf_dir):
    return windows.metric_series(health_rows(spark, sf_dir), bucket(spark, sf_dir), "error")


@query
def total_events_series(spark, sf_dir):
    return rounded(windows.total_series(health_rows(spark, sf_dir), HOUR).select("bucket_start", "count", "quality", "rate"))


def overlapping(spark, sf_dir):
    """The same hours by two observers, one of which saw only the first 40 minutes of each."""
    rows = health_rows(spark, sf_dir).select("bucket_start", "bucket_width", "observed_duration_us")
    half = rows.withColumn("observed_duration_us", F.least("observed_duration_us", F.lit(2_400_000_000).cast("long")))
    return rows.union(half.where(F.pmod(F.floor(F.col("bucket_start") / HOUR), F.lit(3)) == 0))


@query
def interval_coverage(spark, sf_dir):
    return rounded(windows.interval_coverage(overlapping(spark, sf_dir)))


@query
def merge_window_parts(spark, sf_dir):
    rows = health_rows(spark, sf_dir).withColumn("flags", windows.flags()).withColumn("count", F.col("events_seen"))
    return windows.merged(rows, []).select("bucket_start", "count", "observed_duration_us", F.array_join("flags", ",").alias("flags"), "coverage_state", "gap_us", "pieces")


@query
def run_summary(spark, sf_dir):
    rows = runs.summaries(run_rows(spark, sf_dir), health_rows(spark, sf_dir))
    return rounded(rows.select("run_id", "windows", "partial_windows", "empty_windows", "degraded_windows", "lagged_windows", "seam_windows", "gap_windows", "events", "observed_duration_us", "nominal_duration_us", "gap_us", "status", "data_span_s", "coverage_ratio", "replayed"))


@query
def run_coverage(spark, sf_dir):
    return runs.coverage(health_rows(spark, sf_dir))


@query
def run_conflicts(spark, sf_dir):
    """Runs stretched by a day at both ends: each then overlaps its neighbours."""
    rows = run_rows(spark, sf_dir)
    day = 86_400 * scalars.MICROS
    wide = rows.withColumns({"first_event_us": F.col("first_event_us") - day, "last_event_us": F.col("last_event_us") + day})
    return runs.conflicts(wide, health_rows(spark, sf_dir))


@query
def compatible_runs(spark, sf_dir):
    return runs.compatible(run_rows(spark, sf_dir), health_rows(spark, sf_dir), "events").select("run_id", "start_us", "end_us")


@query
def latest_run(spark, sf_dir):
    return runs.latest(run_rows(spark, sf_dir))


@query
def sum_series(spark, sf_dir):
    rows = windows.sum_series(points(spark, sf_dir), ["click", "purchase"], "acts")
    return rounded(rows.select("bucket_start", "count", "quality", "rate"))


@query
def ratio_series(spark, sf_dir):
    return rounded(derive.ratios(points(spark, sf_dir), RATIOS).select("ratio", "bucket_start", "numerator", "denominator", "value", "observed", "quality"))


@query
def ratio_extremes(spark, sf_dir):
    return rounded(derive.ratio_extremes(derive.ratios(points(spark, sf_dir), RATIOS), 3))


@query
def aggregate_rates(spark, sf_dir):
    return rounded(derive.aggregate_rates(points(spark, sf_dir)))


@query
def combined_rate(spark, sf_dir):
    return rounded(derive.combined_rate(points(spark, sf_dir), METRICS))


def _deps(spark, sf_dir, robust=False):
    return derive.departures(points(spark, sf_dir), robust=robust)


@query
def rolling_departures(spark, sf_dir):
    return rounded(_deps(spark, sf_dir).select("metric", "bucket_start", "value", "baseline_mean", "baseline_std", "baseline_n", "z", "pct_change", "eligible", "quality"))


@query
def robust_departures(spark, sf_dir):
    return rounded(_deps(spark, sf_dir, True).select("metric", "bucket_start", "value", "baseline_mean", "baseline_std", "baseline_n", "z"))


@query
def condition_labels(spark, sf_dir):
    return _deps(spark, sf_dir).groupBy("metric", "condition").agg(F.count(F.lit(1)).alias("windows"))


@query
def latest_departure(spark, sf_dir):
    return rounded(derive.latest(_deps(spark, sf_dir)).select("metric", "bucket_start", "value", "baseline_mean", "z", "condition"))


@query
def lagged_correlation(spark, sf_dir):
    return rounded(derive.lagged_correlation(points(spark, sf_dir), "view", "click"))


@query
def autocorrelation(spark, sf_dir):
    return rounded(derive.persistence_of_noise(points(spark, sf_dir)))


def _episodes(spark, sf_dir):
    return episodes.episodes(_deps(spark, sf_dir, True), enter=2.0, hold=1.0, peak=2.0)


@query
def rate_episodes(spark, sf_dir):
    return rounded(_episodes(spark, sf_dir).select("metric", "type", "direction", "start_s", "end_s", "score", "n_windows", "events", "peak_z", "mean_z", "extreme_rate", "baseline_rate", "rise_windows", "fall_windows"))


@query
def episode_summary(spark, sf_dir):
    return rounded(episodes.summary(_episodes(spark, sf_dir)).where("severity is null and direction is null and type is null").select("episodes", "low", "mid", "high", "first_s", "last_s"))


@query
def co_occurrence(spark, sf_dir):
    found = held(_episodes(spark, sf_dir)).withColumn("type", F.concat_ws(":", "metric", "type"))
    return episodes.co_occurrence(found)


@query
def disclosure_gate(spark, sf_dir):
    found = episodes.disclosable(held(_episodes(spark, sf_dir)), events(spark, sf_dir), 5)
    return found.select("metric", "type", "start_s", "actors", "most_by_one", "acts", "public")


@query
def sealed_episodes(spark, sf_dir):
    found = episodes.sealed(_episodes(spark, sf_dir), "robust/2.0/1.0")
    return found.select("metric", "type", "start_s", "end_s", "evidence_id")


def _edges(spark, sf_dir):
    day = scalars.day_of(F.floor(F.col("us") / F.lit(scalars.MICROS)))
    return events(spark, sf_dir).select("us", "actor", F.col("metric").alias("collection"), F.col("target").cast("string").alias("target"), day.cast("string").alias("day"))


@query
def concentration(spark, sf_dir):
    found = edges.concentration(_edges(spark, sf_dir), ["collection"])
    return rounded(found.select("collection", "n_events", "n_actors", "actor_herfindahl", "n_targets", "target_herfindahl", "effective_actors", "score"))


@query
def cohort_pairs(spark, sf_dir):
    """Of the collection ``view`` alone, as the query's SQL has it; ``collection_cohort_pairs`` has all."""
    rows = _edges(spark, sf_dir).where("collection = 'view'")
    return rounded(edges.similar_pairs(edges.target_sets(rows, ["collection"]), ["collection"], 0.2).select("a", "b", "jaccard"))


@query
def cohort_components(spark, sf_dir):
    """Of the collection ``view`` alone, as the query's SQL has it; ``collection_cohort_components`` has all."""
    rows = _edges(spark, sf_dir).where("collection = 'view'")
    return edges.similar_components(edges.target_sets(rows, ["collection"]), ["collection"], 0.2).select("actor", "component")


@query
def cohorts(spark, sf_dir):
    """Of the collection ``view`` alone, as the query's SQL has it; ``collection_cohorts`` has all."""
    rows = _edges(spark, sf_dir).where("collection = 'view'")
    return rounded(edges.cohorts(rows, ["collection"], threshold=0.2))


def _target_sets(spark, sf_dir):
    return edges.target_sets(_edges(spark, sf_dir), ["collection"])


@query
def collection_cohort_pairs(spark, sf_dir):
    return rounded(edges.similar_pairs(_target_sets(spark, sf_dir), ["collection"], 0.2).select("collection", "a", "b", "jaccard"))


@query
def collection_cohort_components(spark, sf_dir):
    return edges.similar_components(_target_sets(spark, sf_dir), ["collection"], 0.2).select("collection", "actor", "component")


@query
def collection_cohorts(spark, sf_dir):
    return rounded(edges.cohorts(_edges(spark, sf_dir), ["collection"], threshold=0.2))


@query
def synchronisation(spark, sf_dir):
    found = edges.synchronisation(_edges(spark, sf_dir), ["collection", "day"], 86_400.0, within_s=80_000.0, least_compression=1.0)
    return rounded(found.select("collection", "day", "n_actors", "from_us", "to_us", "first_act_span_s", "compression", "score"))


@query
def lifecycle_inbound(spark, sf_dir):
    rows = events(spark, sf_dir)
    transitions = rows.where("metric = 'error'").select((F.col("actor") % 100).alias("actor"), "us", F.lit("error").alias("status"))
    acts = rows.where("metric in ('click', 'purchase')").select("us", "actor", F.lit("x").alias("collection"), "target")
    return rounded(edges.inbound(transitions, acts, least=2, least_actors=2, excess=1.5).select("who", "t", "n_inbound", "n_distinct_actors", "baseline_raw", "excess_ratio", "type", "score"))


def _field(spark, sf_dir):
    return held(field.vectors(points(spark, sf_dir), ROLES))


@query
def field_vector(spark, sf_dir):
    return rounded(_field(spark, sf_dir).select("bucket_start", "observed", "eligible", *field.QUANTITIES))


@query
def climatology_diurnal(spark, sf_dir):
    return rounded(field.diurnal(_field(spark, sf_dir)))


@query
def climatology_overall(spark, sf_dir):
    rows = _field(spark, sf_dir)
    return rounded(field.overall(rows, field.diurnal(rows)).select("quantity", "n", "mean", "sd", "p05", "p50", "p95", "minimum", "maximum", "lag1_r", "n_eff", "residual_r", "n_days", "support"))


@query
def field_candidates(spark, sf_dir):
    rows = _field(spark, sf_dir)
    cells = held(field.diurnal(rows))
    return rounded(field.candidates(rows, cells, held(field.overall(rows, cells))).select("bucket_start", "quantity", "value", "direction"))


@query
def candidate_rate(spark, sf_dir):
    rows = _field(spark, sf_dir)
    cells = held(field.diurnal(rows))
    dist = held(field.overall(rows, cells))
    return rounded(field.candidate_rate(rows, dist, field.candidates(rows, cells, dist)))


@query
def conditions_state(spark, sf_dir):
    rows = _field(spark, sf_dir)
    cells = held(field.diurnal(rows))
    return rounded(field.conditions(rows, cells, held(field.overall(rows, cells))))


@query
def recent_states(spark, sf_dir):
    rows = _field(spark, sf_dir)
    cells = held(field.diurnal(rows))
    last = rows.agg(F.max(F.col("bucket_start") + F.col("bucket_width"))).first()[0]
    return rounded(field.conditions(rows, cells, held(field.overall(rows, cells)), [last - h * 3600 for h in (0, 1, 3, 6, 12, 24)]))


@query
def persistence(spark, sf_dir):
    rows = _field(spark, sf_dir)
    return field.placed(rows, field.diurnal(rows)).select("bucket_start", "elevated", F.col("runs").cast("long").alias("runs"))


@query
def diurnal_swing(spark, sf_dir):
    return rounded(field.swing(field.diurnal(_field(spark, sf_dir))))


@query
def intensity_heatmap(spark, sf_dir):
    return rounded(field.heat(_field(spark, sf_dir), "interaction_velocity").withColumn("day", F.col("day").cast("string")))


@query
def density_portrait(spark, sf_dir):
    return field.portrait(_field(spark, sf_dir), "emission_velocity", "interaction_velocity")


@query
def marked_outliers(spark, sf_dir):
    """The windows of the portrait that are farthest outside their hour's band."""
    rows = _field(spark, sf_dir)
    found = field.marked(rows, field.diurnal(rows), "emission_velocity", "interaction_velocity")
    return rounded(found.select("bucket_start", F.col("emission_velocity").alias("x"), F.col("interaction_velocity").alias("y"), "distance"))


@query
def radar(spark, sf_dir):
    rows = _field(spark, sf_dir)
    return rounded(field.radar(rows, field.diurnal(rows)))


@query
def downsample_columns(spark, sf_dir):
    return rounded(windows.collapse(points(spark, sf_dir), 100))


@query
def quality_histogram(spark, sf_dir):
    return rounded(publish.quality_histogram(points(spark, sf_dir)))


@query
def entity_reduction(spark, sf_dir):
    """Orders as histories of customers: the priority is the state, the first order of a customer its creation."""
    o = table(spark, sf_dir, "orders")
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) == 1
    kind = F.when(first, "create").when(F.col("o_orderstatus") == "P", "tombstone").otherwise("update")
    rows = o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("entity"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), kind.alias("kind"), F.col("o_orderpriority").alias("state"))
    fit = ~F.col("state").startswith("5") & ~F.col("prior").startswith("5")
    return rounded(reduce.weekly(rows, 4_102_444_800, qualified=fit))


def weekly_facts(spark, sf_dir, name, time, value):
    rows = table(spark, sf_dir, name)
    week = scalars.week_start(F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(scalars.MICROS)))
    facts = rows.groupBy(week.alias("start_s")).agg(value.cast("double").alias("value"))
    state = F.when(F.pmod(F.floor(F.col("start_s") / scalars.WEEK), F.lit(5)) == 0, "DEGRADED").otherwise("PRESENT")
    share = F.when(state == "DEGRADED", 0.75).otherwise(1.0)
    return facts.select("start_s", (F.col("start_s") + scalars.WEEK).alias("end_s"), state.alias("state"), share.alias("coverage_fraction"), "value")


@query
def compose_overlap(spark, sf_dir):
    left = weekly_facts(spark, sf_dir, "orders", "o_orderdate", F.count(F.lit(1)))
    right = weekly_facts(spark, sf_dir, "lineitem", "l_shipdate", F.count(F.lit(1))).withColumns({"start_s": F.col("start_s") - 259_200, "end_s": F.col("end_s") - 259_200})
    return compose.overlap(left, right)


@query
def compose_pearson(spark, sf_dir):
    left = weekly_facts(spark, sf_dir, "orders", "o_orderdate", F.count(F.lit(1)))
    right = weekly_facts(spark, sf_dir, "lineitem", "l_shipdate", F.sum("l_quantity"))
    return rounded(compose.correlation(left, right))


def _published(spark, sf_dir):
    rows = health_rows(spark, sf_dir).withColumn("flags", windows.flags())
    return windows.merged(rows.withColumn("count", F.col("events_seen")), []).withColumn("quality", scalars.worst(F.col("flags")))


@query
def archive_partition(spark, sf_dir):
    rows = publish.split(_published(spark, sf_dir))
    return rows.groupBy("side", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("windows"), F.min("bucket_start").alias("first_start"), F.max("bucket_start").alias("last_start"))


@query
def archive_index(spark, sf_dir):
    return publish.day_index(publish.split(_published(spark, sf_dir)).where("side = 'archive'")).select(F.col("day").cast("string").alias("day"), "window_count", "first_start", "last_start")


@query
def archive_readback(spark, sf_dir):
    """The archive read back after every seventh day was left out, every eighth lost its first window, and a strange day came."""
    rows = publish.split(_published(spark, sf_dir)).where("side = 'archive'")
    path, number = shared_folder(spark), F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    rows = held(rows.withColumn("begins", F.col("bucket_start") == F.min("bucket_start").over(Window.partitionBy("day"))))
    left = rows.where((number % 7 != 0) & ((number % 8 != 0) | ~F.col("begins")))
    strange = rows.where((number % 7 == 1) & F.col("begins")).withColumn("day", F.lit("1969-12-31").cast("date"))
    publish.write_archive(left.unionByName(strange), path)
    found = publish.read_back(rows, path)
    return found.select(F.col("day").cast("string").alias("day"), "window_count", "problem")


@query
def publish_continuity(spark, sf_dir):
    """The archive as published against one that has lost every hour divisible by 50."""
    rows = _published(spark, sf_dir)
    return rounded(publish.continuity(rows, rows.where(F.pmod(F.floor(F.col("bucket_start") / HOUR), F.lit(50)) != 0)))


@query
def status_concerns(spark, sf_dir):
    rows = health_rows(spark, sf_dir)
    last = rows.agg(F.max(F.col("bucket_start") + HOUR)).first()[0]
    return publish.status(rows, last + 60, HOUR)


@query
def identity_tripwire(spark, sf_dir):
    """Texts that name a mail address or an account, of every document."""
    found = publish.tripwire(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    return found.select("doc_id", "rest_chars")


@query
def health_machine(spark, sf_dir):
    return rounded(health.fold(health_rows(spark, sf_dir)))


@query
def replayed_windows(spark, sf_dir):
    """The live lane's windows over the whole table, every hundredth event arriving an hour late."""
    rows = events(spark, sf_dir)
    arrival = F.when(F.col("event_id") % 100 == 0, F.col("us") + 3600 * scalars.MICROS).otherwise(F.col("us"))
    found = live.window_batch(rows.select(F.lit("events").alias("source"), arrival.alias("arrival"), "us", F.array("metric").alias("metrics")), HOUR)
    return found.drop("unclassified", "reconnects", "gap_us", "resume_seam", "lag_ewma_s", "lag_max_s")


@query
def event_profile(spark, sf_dir):
    """Counts of the keys in the events' properties."""
    rows = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("name"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query
def power_check(spark, sf_dir):
    return rounded(derive.power(points(spark, sf_dir)))


@query
def public_episodes(spark, sf_dir):
    found = held(_episodes(spark, sf_dir))
    return episodes.public_view(episodes.disclosable(found, events(spark, sf_dir), 5))


@query
def concentrated(spark, sf_dir):
    rows = _edges(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / F.lit(6 * HOUR * scalars.MICROS)))
    return rounded(edges.concentrated(edges.concentration(rows, ["hour"]), ["hour"], 0.01).select("hour", "type", "h", "n", "n_events", "score"))


@query
def seismogram(spark, sf_dir):
    return rounded(publish.seismogram(held(_episodes(spark, sf_dir))))


@query
def summary_document(spark, sf_dir):
    """The published summary as JSON text."""
    rows = _field(spark, sf_dir)
    cells = held(field.diurnal(rows))
    state = field.conditions(rows, cells, held(field.overall(rows, cells)))
    return publish.summary(points(spark, sf_dir), runs.summaries(run_rows(spark, sf_dir), health_rows(spark, sf_dir)).select("run_id", "windows", "events", "status"), windows.interval_coverage(overlapping(spark, sf_dir)), state.select("at_s", "state"))


@query
def observation_documents(spark, sf_dir):
    return field.observations(_field(spark, sf_dir), "3600s").select("bucket_start", "window", "quality", "eligible", F.size("metrics").alias("measured"), F.size("unavailable").alias("missing"))

