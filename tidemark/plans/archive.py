"""Sealed documents, concerns, publication and run rows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, vocab
from ..operators import custody, documents, episodes, field, privacy, publish, runs, visibility, windows
from ..sources.store import held
from . import messages
from .telemetry import HOUR, _edges, _episodes, _field, _published, bucket, events, health_rows, points, query, rounded, run_rows, table

M = scalars.MICROS


def _baseline(spark, sf_dir):
    rows = _field(spark, sf_dir)
    cells = held(field.diurnal(rows))
    return rows, cells, held(field.overall(rows, cells))


def _observations(spark, sf_dir):
    return field.observations(_field(spark, sf_dir), "3600s")


@query
def window_receipts(spark, sf_dir):
    rows = bucket(spark, sf_dir).join(health_rows(spark, sf_dir), ["run_id", "bucket_start", "bucket_width"])
    return rows.select("run_id", "bucket_start", "metric", custody.window_receipt().alias("receipt"))


@query
def climatology_seal(spark, sf_dir):
    """The fitted baseline's identity and extent, as the newest of two that are stored."""
    rows, cells, dist = _baseline(spark, sf_dir)
    made = documents.climatology(cells, dist, rows).withColumn("sealed_at", F.lit(1))
    stored = made.unionByName(made.withColumns({"sealed_at": F.lit(0), "climatology_id": F.lit("of another baseline")}))
    return documents.newest(held(stored)).select("climatology_id", "n_days", "first_s", "last_s", "sealed_at")


@query
def rescored_observations(spark, sf_dir):
    rows, cells, dist = _baseline(spark, sf_dir)
    return rounded(documents.rescored(_observations(spark, sf_dir), cells, dist, "a baseline").select("bucket_start", "baseline_days", "baseline_n_eff", "support"))


@query
def observation_replay(spark, sf_dir):
    """Stored observations and those of them whose identity does not follow: none, but for every seventh, which is changed."""
    changed = F.pmod(F.floor(F.col("bucket_start") / HOUR), F.lit(7)) == 0
    stored = _observations(spark, sf_dir).withColumn("quality", F.when(changed, F.lit("another")).otherwise(F.col("quality")))
    return documents.disagreeing(stored).select("bucket_start")


@query
def recent_observations(spark, sf_dir):
    """The last 200 windows of an archive in which every even hour was sealed again later."""
    first = _observations(spark, sf_dir).withColumn("sealed_at", F.lit(1))
    again = first.where(F.pmod(F.floor(F.col("bucket_start") / HOUR), F.lit(2)) == 0).withColumns({"sealed_at": F.lit(2), "quality": F.lit("again")})
    rows, total = documents.recent(held(first.unionByName(again)), 200)
    return rows.select("bucket_start", "window", "quality", "sealed_at", F.lit(total).cast("long").alias("total"))


@query
def hour_words(spark, sf_dir):
    rows, cells, _ = _baseline(spark, sf_dir)
    return documents.placed_in_words(rows, cells).groupBy("quantity", "words").agg(F.count(F.lit(1)).alias("n"))


#: Snapshots: what is known of a collector some seconds after its newest window ended.
RUNTIMES = (
    ("none", None, None, 0), ("current", "connected", 0, 60), ("old", "connected", 0, 500), ("lost", "reconnecting", 0, 60), ("ended", "stopped", 0, 60), ("odd", "pondering", 0, 60),
    ("other run", "connected", 1, 60), ("no clock", "connected", 0, None),
)
CURSORS = (
    # name, has a run, has a window, the run has ended, the window is recent, events of the window, cursor against its end, resumed at its end
    ("no run", False, False, False, True, 0, None, False), ("cold", True, False, False, True, 0, None, False), ("no window", True, False, False, True, 0, 0, False), ("ended", True, True, True, True, 5, 0, False),
    ("stale", True, True, False, False, 5, 0, False), ("quiet", True, True, False, True, 0, 0, False), ("missing", True, True, False, True, 5, None, False), ("ahead", True, True, False, True, 5, 1, False),
    ("stuck", True, True, False, True, 5, 0, True), ("moving", True, True, False, True, 5, 0, False),
)
REPORTS = (
    ("none", None, None, None, None, None), ("incomplete", False, 0, 100, 125, "current"), ("no limit", True, 0, 100, None, "current"), ("old", True, 4000, 100, 125, "current"), ("nothing seen", True, 0, None, 125, "current"),
    ("old data", True, 0, 300, 125, "current"), ("partial", True, 0, 100, 125, "partial"), ("offline", True, 0, 100, 125, "unavailable"), ("current", True, 0, 100, 125, "current"),
)


def _ends(spark, sf_dir):
    """(run_id, end_s): where the newest window of each run ends."""
    return health_rows(spark, sf_dir).groupBy("run_id").agg(F.max(F.col("bucket_start") + F.col("bucket_width")).alias("end_s"))


@query
def connection_concern(spark, sf_dir):
    """Every kind of word of a collector, for each run."""
    cases = spark.createDataFrame(RUNTIMES, "case string, state string, other int, age long")
    rows = _ends(spark, sf_dir).crossJoin(F.broadcast(cases))  # eight cases
    runtime = F.when(F.col("state").isNotNull(), F.struct(F.when(F.col("other") == 1, "another").otherwise(F.col("run_id")).alias("run_id"), F.lit("events").alias("endpoint"), "state", (F.col("end_s") - F.col("age")).alias("updated_s")))
    found = visibility.connection(runtime, F.col("run_id"), F.lit("events"), F.col("end_s"), F.lit(None).cast("double"))
    return rows.select("run_id", "case", found.alias("x")).select("run_id", "case", "x.*")


@query
def cursor_concern(spark, sf_dir):
    """Every way in which a cursor can stand, for each run."""
    cases = spark.createDataFrame(CURSORS, "case string, run boolean, window boolean, ended boolean, current boolean, events long, ahead long, stuck boolean")
    rows = _ends(spark, sf_dir).crossJoin(F.broadcast(cases))  # ten cases
    end = F.col("end_s") * M
    run = F.when(F.col("run"), F.struct("ended", F.when(F.col("stuck"), end).otherwise(end - 1).alias("resumed_at")))
    health = F.when(F.col("window"), F.struct(F.col("events").alias("events_seen"), F.lit(HOUR * M).alias("observed_duration_us"), end.alias("observed_to_us")))
    found = visibility.cursor(run, health, end + F.col("ahead"), F.col("current"))
    return rows.select("run_id", "case", found.alias("x")).select("run_id", "case", "x.*")


@query
def publication_concerns(spark, sf_dir):
    """Every kind of report, the gate's answers, and the newest window, for each run."""
    cases = spark.createDataFrame(REPORTS, "case string, complete boolean, age long, behind long, limit_s int, freshness string")
    rows = _ends(spark, sf_dir)
    report = F.when(F.col("complete").isNotNull(), F.struct("complete", (F.col("end_s") - F.col("age")).alias("generated_s"), (F.col("end_s") - F.col("age") - F.col("behind")).alias("newest_s"), "limit_s", "freshness"))
    reports = rows.crossJoin(F.broadcast(cases)).select("run_id", "case", visibility.candidate(report, F.col("end_s")).alias("x"))
    answers = rows.select("run_id", F.explode(F.array(*map(F.lit, ("PASSED", "REFUSED", "ERROR", "NOT_EVALUATED")))).alias("case"))
    gates = answers.select("run_id", "case", visibility.gate_concern(F.col("case")).alias("x"))
    ages = rows.select("run_id", "end_s", F.explode(F.array(F.lit(0), F.lit(7205), F.lit(7206))).alias("age"))
    newest = ages.select("run_id", F.concat(F.lit("age "), F.col("age").cast("string")).alias("case"), visibility.currency(F.col("end_s"), F.col("end_s") + F.col("age"), F.lit(HOUR), F.lit(False)).alias("x"))
    return reports.union(gates).union(newest).select("run_id", "case", "x.*")


@query
def store_catalog(spark, sf_dir):
    return visibility.catalog({"bucket": bucket(spark, sf_dir), "edge_event": _edges(spark, sf_dir), "observation_run": run_rows(spark, sf_dir).select("run_id", "started_at")})


@query
def latest_window(spark, sf_dir):
    return visibility.latest(run_rows(spark, sf_dir), health_rows(spark, sf_dir)).select("run_id", "health.bucket_start", "health.events_seen", "health.observed_duration_us")


@query
def archive_range(spark, sf_dir):
    """Windows of three days, from the day before the newest on: some recent, some of archived days."""
    rows = held(publish.split(_published(spark, sf_dir)))
    newest = rows.agg(F.max("bucket_start")).first()[0]
    sides = rows.where("side = 'recent'"), rows.where("side = 'archive'")
    return publish.windows_between(*sides, newest - 3 * 86_400, newest - 3600).select("bucket_start", "side", "events_seen")


@query
def continuity_notices(spark, sf_dir):
    """A notice about lost hours, written twice over one that is there."""
    rows = _published(spark, sf_dir)
    verdict = publish.continuity(rows, rows.where(F.pmod(F.floor(F.col("bucket_start") / HOUR), F.lit(50)) != 0))
    new = held(publish.loss_notice(verdict).select(F.lit("n1").alias("notice_id"), F.lit(2).cast("long").alias("at_s"), F.col("notice").alias("message")))
    index = spark.createDataFrame([("n0", 0, "an older one"), ("n1", 1, "other words")], "notice_id string, at_s long, message string")
    return publish.noticed(publish.noticed(index, new), new)


@query
def run_markers(spark, sf_dir):
    """Runs by their markers: the last has no end, an end is written twice, and one belongs to no run."""
    rows = run_rows(spark, sf_dir)
    last = rows.agg(F.max("run_id")).first()[0]
    start = rows.select("run_id", F.lit("start").alias("mark"), "source_endpoint", "bucket_width", "started_at", "resume_cursor_at_start")
    end = rows.where(F.col("run_id") != last).select("run_id", F.lit("end").alias("mark"), "ended_at", "stop_reason", "first_event_us", "last_event_us")
    early = end.withColumns({"ended_at": F.col("ended_at") - F.expr("INTERVAL 1 DAY"), "stop_reason": F.lit("lost")})
    stray = end.limit(1).withColumn("run_id", F.lit("no run"))
    markers = start.unionByName(end.unionByName(early).unionByName(stray), allowMissingColumns=True)
    found = runs.summaries(runs.merged_markers(markers), health_rows(spark, sf_dir))
    return rounded(found.select("run_id", "bucket_width", "stop_reason", "first_event_us", "last_event_us", "wall_duration_s", "windows", F.when(F.col("status") == "open", "open").otherwise("closed").alias("status")))


@query
def narrowest_width(spark, sf_dir):
    return runs.narrowest_width(run_rows(spark, sf_dir))


@query
def run_lookup(spark, sf_dir):
    rows = run_rows(spark, sf_dir)
    return runs.lookup(rows, rows.agg(F.min("run_id")).first()[0]).select("run_id", "bucket_width", "first_event_us", "last_event_us")


@query
def store_history(spark, sf_dir):
    """Where the history begins: with the first run, then with a beginning that was assigned a day later, and one a day before."""
    rows = run_rows(spark, sf_dir)
    first = rows.agg(F.unix_seconds(F.min("started_at"))).first()[0]
    cases = [runs.history(rows, None if days is None else first + days * 86_400).withColumn("days", F.lit(days).cast("int")) for days in (None, 1, -1)]
    return cases[0].union(cases[1]).union(cases[2])


@query
def sink_totals(spark, sf_dir):
    """Totals of a sink that reports its counters so far after each day."""
    day = F.floor(F.col("us") / F.lit(86_400 * M))
    per = events(spark, sf_dir).groupBy("run_id", day.alias("day")).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("metric") == "view").alias("kept"), F.min("us").alias("first_event_us"), F.max("us").alias("last_event_us"))
    upto = Window.partitionBy("run_id").orderBy("day")
    sofar = per.select("run_id", "day", F.sum("seen").over(upto).alias("seen"), F.sum("kept").over(upto).alias("stored_edges"), F.min("first_event_us").over(upto).alias("first_event_us"), F.max("last_event_us").over(upto).alias("last_event_us"))
    health = sofar.select("run_id", F.col("day").alias("flush_seq"), "seen", "stored_edges", F.lit(0).cast("long").alias("stored_status"), (F.col("seen") - F.col("stored_edges")).alias("dropped"), "first_event_us", "last_event_us")
    return custody.flush_totals(health)


@query
def trailing_episodes(spark, sf_dir):
    found = episodes.disclosable(held(_episodes(spark, sf_dir)), events(spark, sf_dir), 5)
    now = found.agg(F.max("end_s")).first()[0] or 0
    return publish.trailing(found, now, 10 * 86_400).select("metric", "type", "start_s", "end_s")


@query
def disclosure_policy(spark, sf_dir):
    return publish.disclosure_policy(spark)


@query
def criteria_table(spark, sf_dir):
    return publish.criteria(spark).select("place", "state")


@query
def display_texts(spark, sf_dir):
    """Short texts of numbers, from the order keys."""
    k = F.col("o_orderkey")
    rate, lag, age = k * k / 7.31, F.pmod(k * 7, F.lit(1000)) / 0.7, F.pmod(k * 997, F.lit(300_000)).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.compact_rate(rate).alias("rate"), scalars.lag_text(lag).alias("lag"), scalars.age_text(age).alias("age"))


@query
def time_texts(spark, sf_dir):
    """Times as text and back, from the events' hours."""
    us = F.col("us")
    start, end = scalars.coarse_period(F.timestamp_micros(us), F.timestamp_micros(us + 5_400 * M))
    iso = scalars.us_to_iso(us)
    rows = events(spark, sf_dir).select("event_id", iso.alias("iso"), scalars.seconds_to_iso(F.floor(us / F.lit(M))).alias("iso_s"), F.unix_seconds(start).alias("from_s"), F.unix_seconds(end).alias("to_s"), us)
    odd = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("iso", "Z$", "")).when(F.col("event_id") % 3 == 1, F.regexp_replace("iso", "Z$", "+00:00")).otherwise(F.concat(F.lit("x"), F.col("iso")))
    return rows.select("event_id", "iso", "iso_s", "from_s", "to_s", F.round(scalars.to_epoch(odd) * 1000).cast("long").alias("epoch_ms"))


@query
def content_addresses(spark, sf_dir):
    """Content addresses of queries, ranges, sets and windows of each run, tokens, and how clean its evidence is."""
    rows = events(spark, sf_dir)
    days = F.collect_set(F.floor(F.col("us") / F.lit(86_400 * M)).cast("string"))
    per = rows.groupBy("run_id").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count(F.lit(1)).alias("n"), days.alias("days"))
    clean = health_rows(spark, sf_dir).groupBy("run_id").agg(F.count_if(F.col("coverage_state") == "ok").alias("ok"), F.count(F.lit(1)).alias("windows"))
    return per.join(clean, "run_id").select(
        "run_id", scalars.query_commitment(F.concat(F.lit("  SELECT  *\n FROM "), F.col("run_id"), F.lit(" ")), F.col("n"), F.lit("r")).alias("query"), scalars.event_range(F.col("a"), F.col("b"), F.col("n")).alias("range"),
        scalars.set_root(F.col("days"), F.size("days")).alias("days"), scalars.fingerprint(F.col("a"), F.col("b"), F.lit("1h"), F.lit("c")).alias("fingerprint"), scalars.actor_token("salt", F.col("run_id")).alias("token"),
        scalars.watermark(F.col("ok"), F.col("windows")).alias("evidence"),
    )


@query
def episode_names(spark, sf_dir):
    """The name of an excess and a deficit of every metric of the alphabet."""
    rows = spark.createDataFrame([(m, *vocab.EPISODES.get(m, vocab.EPISODE_DEFAULT)) for m in vocab.metrics()], "metric string, up string, down string")
    return rows.groupBy("up", "down").agg(F.count(F.lit(1)).alias("metrics"))


@query
def scrubbed_messages(spark, sf_dir):
    """Every message without what no list allows."""
    return privacy.scrub(messages.lines(spark, sf_dir), "salt")


@query
def scrub_leaks(spark, sf_dir):
    """What is left of accounts in the scrubbed messages, and, to compare, in the messages: (side, problem, n)."""
    lines = messages.lines(spark, sf_dir)
    sides = [privacy.leaks(df).withColumn("side", F.lit(name)) for name, df in (("raw", lines), ("scrubbed", privacy.scrub(lines, "salt")))]
    return sides[0].union(sides[1]).groupBy("side", "problem").agg(F.count(F.lit(1)).alias("n"))
