"""What is published: recent windows and archived days, digests, continuity with what was published before, the gate."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, vocab

RECENT_S, RECENT_CAP = 86_400, 2_000
TOLERANCE_S, TOLERANCE_SHARE = 120.0, 0.01


def split(windows: DataFrame, *, recent_s: int = RECENT_S, cap: int = RECENT_CAP) -> DataFrame:
    """Adds ``side`` (``recent`` or ``archive``) and ``day``: the newest day, at most ``cap`` windows of it, is recent."""
    newest = windows.agg(F.max("bucket_start").alias("__newest"))
    young = windows.crossJoin(F.broadcast(newest)).withColumn("__young", F.col("bucket_start") > F.col("__newest") - recent_s)  # one row
    # Only windows of the last day are ranked.
    rank = F.row_number().over(Window.partitionBy("__young").orderBy(F.desc("bucket_start"), F.desc("quality")))
    ranked = young.where("__young").withColumn("__rank", rank)
    old = young.where("not __young").withColumn("__rank", F.lit(0))
    side = F.when(F.col("__young") & (F.col("__rank") <= cap), "recent").otherwise("archive")
    return ranked.unionByName(old).withColumn("side", side).withColumn("day", scalars.day_of(F.col("bucket_start"))).drop("__newest", "__young", "__rank")


def row_text() -> F.Column:
    """A window as canonical text."""
    return scalars.stable_json(bucket_start=F.col("bucket_start"), quality=F.col("quality"), flags=F.col("flags"), events_seen=F.col("events_seen"), observed_duration_us=F.col("observed_duration_us"))


def day_index(windows: DataFrame) -> DataFrame:
    """(day, window_count, first_start, last_start, digest) of the archived days.  A day holds a bounded number of windows."""
    rows = windows.withColumn("__text", row_text())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket_start", "__text"))), lambda x: x["__text"]), "\n")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("window_count"), F.min("bucket_start").alias("first_start"), F.max("bucket_start").alias("last_start"), scalars.receipt(text).alias("digest"))


def write_archive(windows: DataFrame, path: str) -> None:
    """A folder for each day, its windows in order, as JSON lines; days are dealt to tasks by a hash."""
    windows.repartition("day").sortWithinPartitions("day", "bucket_start").write.mode("overwrite").partitionBy("day").json(path)


def days_to_write(index: DataFrame, published: DataFrame) -> DataFrame:
    """(day): days of an index that are not published yet, or with another digest."""
    was = published.select("day", F.col("digest").alias("__was"))
    return index.join(was, "day", "left").where("__was is null or __was <> digest").select("day")


def write_changed(windows: DataFrame, published: DataFrame, path: str) -> None:
    """Writes the folders of the days that differ from the published index; all other days stay as they are."""
    days = days_to_write(day_index(windows), published)
    changed = windows.join(days, "day", "left_semi")
    changed.repartition("day").sortWithinPartitions("day", "bucket_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").json(path)


MISSING, OTHER, STRANGER = "missing", "other content", "not in the index"


def read_back(windows: DataFrame, path: str) -> DataFrame:
    """(day, window_count, digest, problem) of an archive after it was written: what an index may promise, and what it may not.

    windows: what should be there.  Each day's files are read again and made into an entry of their own; a day without files is
    ``missing``, one that does not read as the same windows has ``other content``, one that no window is of is ``not in the
    index``.  Days without a problem are those to list.
    """
    columns = ["bucket_start", "quality", "flags", "events_seen", "observed_duration_us"]
    schema = ", ".join(f"`{c}` {windows.schema[c].dataType.simpleString()}" for c in columns) + ", day date"
    try:
        there = windows.sparkSession.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = windows.sparkSession.createDataFrame([], schema)
    promised = day_index(windows).select("day", "window_count", "digest")
    found = day_index(there).select(F.col("day").alias("there"), F.col("digest").alias("found"))
    both = promised.join(found, F.col("day") == F.col("there"), "full")
    problem = F.when(F.col("there").isNull(), MISSING).when(F.col("day").isNull(), STRANGER).when(F.col("digest") != F.col("found"), OTHER)
    return both.select(F.coalesce("day", "there").alias("day"), "window_count", "digest", problem.alias("problem"))


def extent(index: DataFrame) -> DataFrame:
    return index.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"), F.sum("window_count").alias("windows"))


def missing_days(published: DataFrame, candidate: DataFrame) -> DataFrame:
    """Days that were published and would be gone."""
    return published.select("day").distinct().join(candidate.select("day").distinct(), "day", "left_anti")


def changed_days(published: DataFrame, candidate: DataFrame) -> DataFrame:
    """Days on both sides with different content."""
    both = published.select("day", F.col("digest").alias("was")).join(candidate.select("day", F.col("digest").alias("now")), "day")
    return both.where("was <> now")


def continuity(published: DataFrame, candidate: DataFrame, *, store_changed: bool = False) -> DataFrame:
    """One row: verdict CONTINUOUS, SHRUNK or DISCONTINUOUS, with what would be lost.

    published, candidate: windows (bucket_start, observed_duration_us) as they were and would be published.
    """
    bounds = published.agg(F.min("bucket_start").alias("lo"), F.max("bucket_start").alias("hi"), (F.sum("observed_duration_us") / 1e6).alias("published_s"))
    inside = candidate.crossJoin(F.broadcast(bounds)).where("bucket_start between lo and hi")  # one row of bounds
    kept = inside.agg((F.coalesce(F.sum("observed_duration_us"), F.lit(0)) / 1e6).alias("candidate_s"))
    begins = candidate.agg(F.min("bucket_start").alias("candidate_first"))
    day = scalars.day_of(F.col("bucket_start")).alias("day")
    gone = missing_days(published.select(day), candidate.select(day)).agg(F.count(F.lit(1)).alias("missing_days"))
    out = bounds.crossJoin(kept).crossJoin(begins).crossJoin(gone)  # one row each
    later = F.coalesce(F.col("candidate_first") > F.col("lo"), F.lit(True))
    lost = F.col("published_s") - F.col("candidate_s") > F.greatest(F.lit(TOLERANCE_S), F.col("published_s") * TOLERANCE_SHARE)
    verdict = F.when(later | lost | (F.col("missing_days") > 0), "SHRUNK").when(F.lit(store_changed), "DISCONTINUOUS").otherwise("CONTINUOUS")
    return out.select(verdict.alias("verdict"), "missing_days", later.alias("starts_later"), lost.alias("recent_lost"), "published_s", "candidate_s")


def tripwire(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Rows whose text names an account or a mail address (not shown), and how much text is left without them."""
    pattern = r"(did:(plc|web):)|(at://)|([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,})"
    return rows.where(F.coalesce(F.col(text).rlike(pattern), F.lit(False))).select(key, F.length(F.regexp_replace(text, pattern, "")).cast("long").alias("rest_chars"))


def status(windows: DataFrame, now_s: int, width: int) -> DataFrame:
    """(concern, state, detail): what can be said about the store's windows, each on its own."""
    facts = windows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("bucket_start") + F.col("bucket_width")).alias("until"), F.sum("gap_us").alias("gap"), F.sum(F.col("parse_errors") + F.col("rejected_no_time_us") + F.col("late_events")).alias("lost"),
        F.sum("unclassified").alias("odd"), F.sum("events_seen").alias("events"), F.max("lag_max_s").alias("lag"), F.max_by("coverage_state", "bucket_start").alias("last_state"),
    )
    age = F.lit(now_s) - F.col("until")
    say = lambda name, state, detail: F.struct(F.lit(name).alias("concern"), state.alias("state"), detail.cast("string").alias("detail"))
    none = F.col("n") == 0
    rows = F.array(
        say("persistence", F.when(none, "ABSENT").otherwise("PRESENT"), F.col("n")), say("currency", F.when(none, "UNKNOWN").when(age > 2 * width + 5, "STALE").otherwise("PRESENT"), age),
        say("coverage", F.when(none, "UNKNOWN").when(F.col("gap") > 0, "DEGRADED").otherwise("PRESENT"), F.col("gap")), say("loss", F.when(none, "UNKNOWN").when(F.col("lost") > 0, "DEGRADED").otherwise("PRESENT"), F.col("lost")),
        say("schema_drift", F.when(none, "UNKNOWN").when(F.col("odd") > 0.05 * F.col("events"), "DEGRADED").otherwise("PRESENT"), F.col("odd")),
        say("delay", F.when(F.col("lag").isNull(), "UNKNOWN").when(F.col("lag") > 120, "DEGRADED").otherwise("PRESENT"), F.col("lag")),
        say("health", F.when(none, "UNKNOWN").when(F.col("last_state") == "ok", "PRESENT").when(F.col("last_state") == "degraded", "DEGRADED").otherwise("UNKNOWN"), F.col("last_state")),
    )
    return facts.select(F.explode(rows).alias("r")).select("r.*")


def quality_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("metric", "quality").agg(F.count(F.lit(1)).alias("windows"), (F.sum("observed_duration_us") / 1e6).alias("observed_s"))


def seismogram(found: DataFrame) -> DataFrame:
    """Episodes by type with their score over the greatest of all."""
    top = found.agg(F.max("score").alias("__top"))
    return found.crossJoin(F.broadcast(top)).select("type", "start_s", "end_s", "score", scalars.ratio(F.col("score"), F.col("__top")).alias("height"))  # one row


FORBIDDEN = ("handle", "email", "text", "display", "avatar", "ip_", "geo")


def forbidden_columns(df: DataFrame) -> list[str]:
    """Columns whose names say that they hold what must not be kept."""
    return [c for c in df.columns if any(f in c.lower() for f in FORBIDDEN)]


def limits(names: list[str]) -> dict[str, str]:
    """What each present quantity does not say."""
    said = {
        "emission_velocity": "not how many people speak", "interaction_velocity": "not sentiment", "interaction_pressure": "not controversy", "reply_share": "not argument", "graph_velocity": "not a graph",
        "boundary_share": "not hostility", "withdrawal_share": "not regret", "turbulence": "not instability of a community", "acceleration": "not a trend",
    }
    return {n: said[n] for n in names if n in said}


def qualities() -> tuple[str, ...]:
    return (*vocab.PRECEDENCE, vocab.CLEAN)


def gate(files: DataFrame, required: list[str]) -> DataFrame:
    """(problem, path): why a set of files (path, content) may not be published; no rows if it may.

    Files that must be there and are not, empty ones, and those that name an account.
    """
    named = files.withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    wanted = files.sparkSession.createDataFrame([(r,) for r in required], "name string")
    missing = wanted.join(named.select("name"), "name", "left_anti").select(F.lit("missing").alias("problem"), F.col("name").alias("path"))
    bad = F.when(F.length("content") == 0, "empty").when(scalars.names_identity(F.decode("content", "utf-8")), "names an account")
    return missing.union(named.select(bad.alias("problem"), "path").where("problem is not null"))


def summary(points: DataFrame, summaries: DataFrame, coverage: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row of JSON: totals by metric, runs, bounds of the observed time, and the state."""
    metrics = points.groupBy("metric").agg(F.sum("count").alias("total"), F.count_if("eligible").alias("eligible"))
    held = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  a few rows each
    row = held(metrics, "metrics").crossJoin(held(summaries, "runs")).crossJoin(held(coverage, "interval")).crossJoin(held(conditions, "conditions"))
    return row.select(F.to_json(F.struct("conditions", "interval", "metrics", "runs"), {"ignoreNullFields": "false"}).alias("value"))


def windows_between(recent: DataFrame, archive: DataFrame, lo: int, hi: int) -> DataFrame:
    """Windows that start in [lo, hi]: the recent ones, and of the archived days (column ``day``) in that range, which are all
    that is read, those that are older than every recent window."""
    first = recent.agg(F.min("bucket_start").alias("__first"))
    inside = F.col("bucket_start").between(lo, hi)
    days = archive.where(F.col("day").between(scalars.day_of(F.lit(lo)), scalars.day_of(F.lit(hi))))
    older = days.where(inside).crossJoin(F.broadcast(first)).where(F.col("__first").isNull() | (F.col("bucket_start") < F.col("__first"))).drop("__first")  # one row
    return recent.where(inside).unionByName(older.select(*recent.columns))


def noticed(index: DataFrame, notices: DataFrame) -> DataFrame:
    """The discontinuities (notice_id, at_s, message) of an index with some more; each is there once however often it is
    written, and one that is written again with other words has those."""
    return index.withColumn("__new", F.lit(0)).unionByName(notices.withColumn("__new", F.lit(1))).groupBy("notice_id").agg(F.max_by(F.struct("at_s", "message"), "__new").alias("x")).select("notice_id", "x.*")


def loss_notice(verdict: DataFrame) -> DataFrame:
    """The words of a notice about lost time, from the row of ``continuity``; null where nothing was lost."""
    lost = F.col("published_s") - F.col("candidate_s")
    said = F.when(~F.col("recent_lost"), F.lit(None)).when(F.col("candidate_s") == 0, "all that was published is lost").otherwise(F.concat(F.round(lost).cast("long").cast("string"), F.lit(" s of what was published are lost")))
    return verdict.withColumn("notice", said)


# The limits that public episodes keep to, whether or not there are any.
POLICY = (("minimum_distinct_actors", "10"), ("excess_dominance_suppression", "true"), ("time_bucket_seconds", "3600"), ("exact_statistics_published", "false"), ("stable_episode_identifiers_published", "false"))


def disclosure_policy(spark) -> DataFrame:
    """(rule, value): what public episodes keep to, stated even where there is no episode to apply it to."""
    return spark.createDataFrame(list(POLICY), "rule string, value string")


def criteria(spark) -> DataFrame:
    """(place, state, rule): the named states in the order in which they are tried."""
    rules = (
        ("station_offline", "no eligible window, or only an old one"), ("unavailable", "nothing to compare the hour with"), ("severe", "above p95, three times the median, three windows long"),
        ("storm", "above p95, two windows long"), ("turbulent", "above p75 or turbulent, two windows long"), ("unsettled", "turbulent or above p95"), ("active", "above p75"), ("calm", "all else"),
    )
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "place int, state string, rule string")


def trailing(found: DataFrame, now_s: int, window_s: int = 48 * 3600) -> DataFrame:
    """Disclosable episodes that end within the last so many seconds."""
    return found.where(F.col("public") & (F.col("end_s") > now_s - window_s) & (F.col("start_s") < now_s))


def write_document(document: DataFrame, path: str) -> None:
    """A document of one row (column ``value``) as one text file."""
    document.select("value").coalesce(1).write.mode("overwrite").text(path)
