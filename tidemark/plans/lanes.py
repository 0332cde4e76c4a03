"""The live lane with drops, gaps and lags over the driver's events, and its parts; each query with its SQL.

The SQL walks the rows one by one, as a recursive query: the lane's rules as they are told, not the sets that the library
makes of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import health, recurrences
from ..sources import commits, feed, store
from ..streaming import collector
from ..streaming import windows as live
from . import messages
from .oracle import _health
from .telemetry import HOUR, events, query, rounded

#: Every hundredth event comes an hour late; after another one of a hundred the connection drops, and what resumes it tells of
#: no gap, of one of ten minutes that ends half an hour later, or of one of twenty minutes that is nowhere.
LATE_S, GAP_MINUTES = 3600, 10


def received(rows):
    """(arrival, wall_us) of events: in the order of their times, but for the late ones."""
    arrival = F.when(F.col("event_id") % 100 == 0, F.col("us") + LATE_S * scalars.MICROS).otherwise(F.col("us"))
    return arrival, arrival + F.pmod(F.floor(F.col("us") / 1000), F.lit(13)) * F.lit(scalars.MICROS)


def seamed_events(spark, sf_dir):
    """The events as lines, and the signals between them."""
    rows = events(spark, sf_dir)
    arrival, wall = received(rows)
    none = F.lit(None)
    lines = rows.select(F.lit("events").alias("source"), arrival.alias("arrival"), "us", F.array("metric").alias("metrics"), wall.alias("wall_us"), none.cast("string").alias("signal"), none.cast("long").alias("gap_us"), none.cast("long").alias("gap_end_us"), none.cast("boolean").alias("seam"), none.cast("boolean").alias("reconnect"))
    cut = rows.where("event_id % 100 = 50")
    signal = lambda name, after, gap, end, fact: cut.select(F.lit("events").alias("source"), (F.col("us") + after).alias("arrival"), none.cast("long").alias("us"), none.cast("array<string>").alias("metrics"), none.cast("long").alias("wall_us"), F.lit(name).alias("signal"), gap.cast("long").alias("gap_us"), end.cast("long").alias("gap_end_us"), F.lit(fact).alias("seam"), F.lit(fact).alias("reconnect"))
    which = F.floor(F.col("event_id") / 100) % 3
    gap = which * GAP_MINUTES * 60 * scalars.MICROS
    end = F.when(which == 1, F.col("us") + HOUR // 2 * scalars.MICROS)
    return lines.unionByName(signal(live.DROPPED, 1, none, none, None)).unionByName(signal(live.RESUMED, 2, gap, end, True))


@query
def seamed_windows(spark, sf_dir):
    """The lane's windows over all events, with what drops, gaps and lags do to them."""
    return rounded(live.window_batch(seamed_events(spark, sf_dir), HOUR))


@query
def seamed_health(spark, sf_dir):
    """How often the health machine gave which reasons over the windows of the lane."""
    closed = live.window_batch(seamed_events(spark, sf_dir), HOUR).drop("metric", "count").distinct()
    found = health.fold(closed.select(F.col("source").alias("run_id"), "bucket_start", "events_seen", "observed_duration_us", F.col("lag_ewma_s").alias("lag_max_s"), *health.LOSSES))
    return found.groupBy("reasons").agg(F.count(F.lit(1)).alias("windows"))


@query
def lag_means(spark, sf_dir):
    """The exponential mean of each run's lags after every event, in the order of arrival."""
    rows = events(spark, sf_dir)
    arrival, wall = received(rows)
    lag = F.least(F.greatest((wall - F.col("us")) / float(scalars.MICROS), F.lit(0.0)), F.lit(live.LAG_MOST))
    found = recurrences.exponential_mean(rows.withColumns({"arrival": arrival, "lag": lag}), "run_id", [F.col("arrival"), F.col("us"), F.col("event_id")], F.col("lag"), live.LAG_ALPHA)
    return rounded(found.select("run_id", "event_id", "lag", "mean"))


@query
def committed_runs(spark, sf_dir):
    """Each week as a run of its own, its windows committed as one batch; every other run ends, and what the last one wrote
    has no marker."""
    root, rows = store.shared_folder(spark), events(spark, sf_dir)
    names = sorted(r.run_id for r in rows.select("run_id").distinct().collect())  # a week each
    for k, name in enumerate(names):
        commits.start_run(spark, root, name, "events", HOUR, k)
        own = rows.where(F.col("run_id") == name).select(F.lit(name).alias("source"), F.col("us").alias("arrival"), "us", F.array("metric").alias("metrics"))
        closed = live.window_batch(own, HOUR)
        if k + 1 < len(names):
            commits.commit(closed, root, k, name, "events")
        else:
            store.append_batch(closed.where("metric IS NOT NULL"), root, "bucket", k, ["bucket_start", "metric"])
        if k % 2 == 0:
            commits.end_run(spark, root, name, k, "completed")
    counted = commits.committed(spark, root, "bucket").groupBy("run_id").agg(F.sum("count").alias("events"))
    found = commits.runs(spark, root).join(counted, "run_id", "left")
    return found.select("run_id", "state", "reason", "windows", "events", "first_event_us", "last_event_us", "resume_cursor_us")


@query
def framed_windows(spark, sf_dir):
    """The messages recorded as frames and collected from them by two runs, the first of which stops in the middle."""
    root, lines = store.shared_folder(spark), messages.lines(spark, sf_dir)
    feed.write_frames(lines, f"{root}/frames", order=["us", "event_id"])
    middle = lines.where("event_id % 30 < 20").agg(F.percentile_approx("us", 0.4)).first()[0]
    config = feed.Feed("events", f"{root}/frames", width=HOUR)
    for until in (middle, None):
        collector.collect(spark, config, f"{root}/out", lines=feed.frames(spark, config.folder, "events", until_us=until))
    health = commits.committed(spark, f"{root}/out", "window_health")
    return health.select("bucket_start", "events_seen", "late_events", "parse_errors", "rejected_no_time_us", "unclassified", "first_event_us", "last_event_us", "observed_duration_us", "partial")


_EVENTS = """ev AS (
    SELECT event_id, event_type AS metric, 'w' || CAST((epoch_us(ts) // 1000000 - 345600) // 604800 * 604800 + 345600 AS VARCHAR) AS run_id, epoch_us(ts) AS us, CASE WHEN event_id % 100 = 0 THEN epoch_us(ts) + 3600000000 ELSE epoch_us(ts) END AS arrival FROM events
  ), timed AS (
    SELECT *, least(greatest((arrival + us // 1000 % 13 * 1000000 - us) / 1e6, 0.0), 600.0) AS lag FROM ev
  )"""

#: The lane row by row: the open window, the highest closed one, when the open one was opened, the lag's mean and maximum.
_WALK = f"""WITH RECURSIVE {_EVENTS}, lines AS (
    SELECT arrival, us, metric, NULL AS signal, lag, NULL::BIGINT AS gap, NULL::BIGINT AS gap_end FROM timed
    UNION ALL SELECT us + 1, NULL, NULL, 'dropped', NULL, NULL, NULL FROM ev WHERE event_id % 100 = 50
    UNION ALL SELECT us + 2, NULL, NULL, 'resumed', NULL, event_id // 100 % 3 * 600000000, CASE WHEN event_id // 100 % 3 = 1 THEN us + 1800000000 END FROM ev WHERE event_id % 100 = 50
  ), o AS (
    SELECT *, row_number() OVER (ORDER BY arrival, us NULLS LAST, signal NULLS FIRST) AS pos, us // 3600000000 * 3600 AS b FROM lines
  ), f(pos, bucket, high, inst, mean, top, late, closes, closed_mean, closed_top) AS (
    SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, false, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE
    UNION ALL
    SELECT pos, CASE WHEN signal = 'dropped' THEN NULL WHEN b IS NULL OR late THEN bucket ELSE b END, CASE WHEN closing THEN bucket ELSE high END, CASE WHEN closing OR opening THEN pos ELSE inst END,
      mean, CASE WHEN closing THEN 0.0 ELSE top END, late, CASE WHEN closing THEN inst END, CASE WHEN closing THEN mean END, CASE WHEN closing THEN top END
    FROM (
      SELECT *, b IS NOT NULL AND NOT late AND bucket IS NOT NULL AND b > bucket AS closing, b IS NOT NULL AND NOT late AND bucket IS NULL AS opening
      FROM (SELECT o.pos, o.b, o.signal, f.bucket, f.high, f.inst, CASE WHEN o.lag IS NULL THEN f.mean WHEN f.mean = 0 THEN o.lag ELSE 0.2 * o.lag + 0.8 * f.mean END AS mean, greatest(f.top, coalesce(o.lag, 0.0)) AS top,
              coalesce(o.b <= f.high, false) OR coalesce(o.b < f.bucket, false) AS late FROM f JOIN o ON o.pos = f.pos + 1)
    )
  ), r AS (
    SELECT o.*, f.bucket AS open, f.inst, f.late, f.closes, f.closed_mean, f.closed_top, f.mean, f.top, lag(f.bucket) OVER (ORDER BY o.pos) AS open_before, lag(f.inst) OVER (ORDER BY o.pos) AS inst_before, f.inst = o.pos AND o.b IS NOT NULL AS opens FROM o JOIN f USING (pos)
  ), final AS (
    SELECT inst AS closes, mean AS closed_mean, top AS closed_top FROM r WHERE pos = (SELECT max(pos) FROM r) AND open IS NOT NULL
  ), kept AS (
    SELECT closes AS inst, closed_mean, closed_top, false AS is_open FROM r WHERE closes IS NOT NULL UNION ALL SELECT *, true FROM final
  ), placed AS (
    SELECT r.*, b IS NOT NULL AND NOT late AS on_time, kept.inst IS NOT NULL AS stays, min(CASE WHEN opens THEN pos END) OVER later AS next, min(CASE WHEN opens AND kept_at.inst IS NOT NULL THEN pos END) OVER later AS next_kept
    FROM r LEFT JOIN kept ON kept.inst = r.inst_before LEFT JOIN kept kept_at ON kept_at.inst = r.pos WINDOW later AS (ORDER BY r.pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
  ), counted AS (
    SELECT *, CASE WHEN on_time THEN inst WHEN open_before IS NOT NULL THEN inst_before ELSE next END AS counts_on, CASE WHEN open_before IS NOT NULL AND stays THEN inst_before ELSE next_kept END AS facts_on FROM placed
  ), cell AS (
    SELECT counts_on AS inst, any_value(b) FILTER (on_time) AS bucket, count(*) FILTER (on_time) AS events_seen, count(*) FILTER (late) AS late_events, arg_min(us, pos) FILTER (on_time) AS first_us, arg_max(us, pos) FILTER (on_time) AS last_us FROM counted WHERE signal IS NULL GROUP BY 1
  ), fact AS (
    SELECT facts_on AS inst, count(*) FILTER (signal = 'resumed') AS reconnects, coalesce(sum(gap), 0) AS gap_us, coalesce(sum(gap) FILTER (gap_end IS NULL), 0) AS nowhere, bool_or(signal = 'resumed' OR open_before IS NOT NULL) AS seam FROM counted WHERE signal IS NOT NULL GROUP BY 1
  ), win AS (
    SELECT cell.*, closed_mean, closed_top, is_open, coalesce(reconnects, 0) AS reconnects, coalesce(gap_us, 0) AS gap_us, coalesce(nowhere, 0) AS nowhere, coalesce(seam, false) AS seam,
      CASE WHEN bucket > min(bucket) OVER () THEN bucket * 1000000 ELSE first_us END AS a, CASE WHEN is_open THEN least(last_us, (bucket + 3600) * 1000000) ELSE (bucket + 3600) * 1000000 END AS z FROM cell JOIN kept USING (inst) LEFT JOIN fact USING (inst)
  ), clipped AS (
    SELECT win.inst, greatest(gap_end - gap, a) AS x, least(gap_end, z) AS y FROM counted JOIN win ON win.inst = facts_on WHERE gap > 0 AND gap_end IS NOT NULL
  ), gone AS (
    SELECT inst, sum(greatest(0, y - greatest(x, coalesce(before, x)))) AS us FROM (SELECT *, max(y) OVER (PARTITION BY inst ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM clipped WHERE x < y) GROUP BY inst
  ), closed AS (
    SELECT win.*, CAST(greatest(0, greatest(0, z - a) - nowhere - coalesce(us, 0)) AS BIGINT) AS observed_duration_us FROM win LEFT JOIN gone USING (inst)
  )"""

SQL = {
    "archive_readback": f"""WITH {_health()}, d AS (SELECT bucket_start // 86400 AS d, count(*) AS n FROM health WHERE bucket_start <= (SELECT max(bucket_start) FROM health) - 86400 GROUP BY 1)
      SELECT CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS VARCHAR) AS day, n AS window_count, CASE WHEN d % 7 = 0 OR d % 8 = 0 AND n = 1 THEN 'missing' WHEN d % 8 = 0 THEN 'other content' END AS problem FROM d
      UNION ALL SELECT '1969-12-31', NULL, 'not in the index' WHERE EXISTS (SELECT 1 FROM d WHERE d % 7 = 1)""",
    "committed_runs": f"""WITH {_EVENTS}, r AS (SELECT run_id, count(*) AS events, count(DISTINCT us // 3600000000) AS windows, min(us) AS a, max(us) AS b, row_number() OVER (ORDER BY run_id) - 1 AS k, count(*) OVER () AS runs FROM ev GROUP BY run_id)
      SELECT run_id, CASE WHEN k % 2 = 0 THEN 'ended' WHEN k + 1 < runs THEN 'interrupted' ELSE 'open' END AS state, CASE WHEN k % 2 = 0 THEN 'completed' END AS reason, CASE WHEN k + 1 < runs THEN windows ELSE 0 END AS windows,
        CASE WHEN k + 1 < runs THEN events END AS events, CASE WHEN k + 1 < runs THEN a END AS first_event_us, CASE WHEN k + 1 < runs THEN b END AS last_event_us, max(b) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS resume_cursor_us FROM r""",
    "framed_windows": """WITH ev AS (SELECT event_id % 30 AS i, epoch_us(ts) AS us, row_number() OVER (ORDER BY epoch_us(ts), event_id) AS n FROM events),
      p AS (SELECT *, us // 3600000000 * 3600 AS b, i NOT IN (22, 23, 24) AS timed FROM ev),
      o AS (SELECT *, coalesce(max(CASE WHEN timed THEN b END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), (SELECT min(b) FROM p WHERE timed)) AS at_b FROM p),
      w AS (SELECT at_b, count(*) FILTER (timed) AS events_seen, count(*) FILTER (i = 23) AS parse_errors, count(*) FILTER (i IN (22, 24)) AS rejected, count(*) FILTER (i IN (13, 14, 15, 16, 21)) AS odd, min(us) FILTER (timed) AS a, max(us) FILTER (timed) AS z FROM o GROUP BY at_b)
      SELECT at_b AS bucket_start, events_seen, 0::BIGINT AS late_events, parse_errors, rejected AS rejected_no_time_us, odd AS unclassified, a AS first_event_us, z AS last_event_us,
        CASE WHEN at_b = min(at_b) OVER () THEN (at_b + 3600) * 1000000 - a ELSE 3600000000 END AS observed_duration_us, at_b = min(at_b) OVER () AS partial FROM w QUALIFY at_b < max(at_b) OVER ()""",
    "seamed_windows": f"""{_WALK}, n AS (SELECT inst, metric, count(*) AS count FROM counted WHERE on_time GROUP BY ALL)
      SELECT 'events' AS source, bucket AS bucket_start, 3600 AS bucket_width, metric, count, events_seen, late_events, 0::BIGINT AS parse_errors, 0::BIGINT AS rejected_no_time_us, 0::BIGINT AS unclassified, first_us AS first_event_us, last_us AS last_event_us,
        reconnects, CAST(gap_us AS BIGINT) AS gap_us, seam AS resume_seam, round(closed_mean, 6) AS lag_ewma_s, round(closed_top, 6) AS lag_max_s, observed_duration_us, observed_duration_us < 3600000000 AS partial FROM closed JOIN n USING (inst)""",
    "seamed_health": f"""{_WALK}, num AS (SELECT row_number() OVER (ORDER BY bucket) AS i, events_seen / greatest(observed_duration_us / 1e6, 1.0) AS rate, late_events / greatest(events_seen + late_events, 1) > 0.02 AS loss, closed_mean AS lag, gap_us > 0 AS gap FROM closed),
      m(i, base, low, slow, lost, good, state, reasons) AS (
        SELECT 0::BIGINT, 0.0::DOUBLE, 0, 0, 0, 0, 'warming_up', ''
        UNION ALL
        SELECT i, base, low, slow, lost, CASE WHEN was = 'degraded' AND g < 5 THEN g ELSE 0 END, CASE WHEN was = 'degraded' THEN CASE WHEN g >= 5 THEN 'ok' ELSE 'degraded' END WHEN was = 'ok' OR i >= 5 THEN CASE WHEN reasons <> '' THEN 'degraded' ELSE 'ok' END ELSE was END, reasons
        FROM (SELECT *, CASE WHEN cov > 0.8 AND lag < 30 AND reasons = '' THEN good + 1 ELSE 0 END AS g
          FROM (SELECT *, array_to_string(list_filter([CASE WHEN low >= 3 THEN 'low_eps' END, CASE WHEN slow >= 3 THEN 'lag_high' END, CASE WHEN lost >= 3 THEN 'loss_observed' END, CASE WHEN gap THEN 'gap_observed' END], lambda x: x IS NOT NULL), ',') AS reasons
            FROM (SELECT i, was, base, cov, good, gap, lag, CASE WHEN cov < 0.6 THEN low + 1 ELSE 0 END AS low, CASE WHEN lag > 120 THEN slow + 1 ELSE 0 END AS slow, CASE WHEN loss THEN lost + 1 ELSE 0 END AS lost
              FROM (SELECT *, least(rate / greatest(base, 1e-6), 1.0) AS cov
                FROM (SELECT num.i, rate, loss, lag, gap, m.state AS was, m.low, m.slow, m.lost, m.good, CASE WHEN m.state = 'degraded' THEN m.base WHEN m.base = 0 THEN rate ELSE 2 / 31.0 * rate + (1 - 2 / 31.0) * m.base END AS base FROM m JOIN num ON num.i = m.i + 1)))))
      ) SELECT reasons, count(*) AS windows FROM m WHERE i > 0 GROUP BY reasons""",
    "lag_means": f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY arrival, us, event_id) AS n FROM timed),
      m(run_id, n, event_id, lag, mean) AS (
        SELECT run_id, n, event_id, lag, lag FROM o WHERE n = 1
        UNION ALL SELECT o.run_id, o.n, o.event_id, o.lag, CASE WHEN m.mean = 0 THEN o.lag ELSE 0.2 * o.lag + 0.8 * m.mean END FROM m JOIN o ON o.run_id = m.run_id AND o.n = m.n + 1
      ) SELECT run_id, event_id, round(lag, 6) AS lag, round(mean, 6) AS mean FROM m""",
}
