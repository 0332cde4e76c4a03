"""Concerns about a collection and what it publishes: each says what state a thing is in and on what evidence.

The states are PRESENT, DEGRADED, UNKNOWN, STALE, ABSENT and REFUSED.  Every function takes columns and gives a struct
(state, detail), so any number of snapshots is judged at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds for which a collector's word holds, where no window says how long a window is.
CURRENT_S = 125.0
#: Seconds between two publications, and what one may take.
PUBLISH_EVERY_S, RENDER_S = 900.0, 300.0
IDENTITY_COLUMNS = ("did", "handle", "rkey", "cid", "uri", "text", "actor", "subject")
REQUIRED_TABLES = ("meta", "observation_run", "bucket", "window_health")


def _said(state: str, detail: str) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(detail).alias("detail"))


def connection(runtime: Column, run_id: Column, endpoint: Column, now_s: Column, current_s: Column) -> Column:
    """What a collector says of its connection, if it speaks of the latest run and has spoken lately.

    runtime: a struct (run_id, endpoint, state, updated_s), null where there is none.
    """
    age, limit = now_s - runtime["updated_s"], F.coalesce(current_s, F.lit(CURRENT_S))
    bound = (runtime["run_id"] == run_id) & (runtime["endpoint"] == endpoint)
    said = runtime["state"]
    return (
        F.when(runtime.isNull(), _said("UNKNOWN", "no word of the collector")).when(~F.coalesce(bound, F.lit(False)), _said("UNKNOWN", "not about the latest run"))
        .when(age.isNull(), _said("UNKNOWN", "without a time")).when(age > limit, _said("STALE", "spoken too long ago")).when(said == "connected", _said("PRESENT", "connected"))
        .when(said.isin("disconnected", "reconnecting"), _said("DEGRADED", "not connected")).when(said == "stopped", _said("ABSENT", "stopped")).otherwise(_said("UNKNOWN", "in no known state"))
    )


def cursor(run: Column, health: Column, at: Column, current: Column) -> Column:
    """Whether the cursor of the latest run's endpoint moves on with what is stored.

    run: a struct (ended, resumed_at), health: a struct (events_seen, observed_duration_us, observed_to_us) of its newest
    window, at: the cursor; each null where there is none.  current: whether that window is recent.
    """
    return (
        F.when(run.isNull(), _said("ABSENT", "NOT_EXPECTED")).when(health.isNull() & at.isNull(), _said("UNKNOWN", "NO_CURSOR")).when(health.isNull(), _said("UNKNOWN", "UNKNOWN"))
        .when(run["ended"], _said("ABSENT", "STOPPED")).when(~current, _said("STALE", "UNKNOWN"))
        .when((health["events_seen"] == 0) & (health["observed_duration_us"] > 0), _said("PRESENT", "NO_ACTIVITY_OBSERVED")).when(at.isNull(), _said("DEGRADED", "MISSING"))
        .when(at > health["observed_to_us"], _said("DEGRADED", "INCOHERENT_AHEAD")).when(at <= run["resumed_at"], _said("DEGRADED", "NOT_ADVANCING")).otherwise(_said("PRESENT", "ADVANCING"))
    )


def candidate(report: Column, now_s: Column) -> Column:
    """Whether a report that is ready to be published is current and backed by current data.

    report: a struct (complete, generated_s, newest_s, limit_s, freshness), null where there is none.  The data's age is
    judged as of the time at which the report was made.
    """
    made, seen = report["generated_s"], report["newest_s"]
    return (
        F.when(report.isNull(), _said("ABSENT", "no report")).when(~report["complete"], _said("DEGRADED", "incomplete")).when(made.isNull() | report["limit_s"].isNull(), _said("UNKNOWN", "facts are missing"))
        .when(now_s - made > 2 * PUBLISH_EVERY_S + RENDER_S, _said("STALE", "the report is old")).when(seen.isNull(), _said("UNKNOWN", "no observed window"))
        .when(made - seen > report["limit_s"], _said("STALE", "its data were old")).when(report["freshness"] == "partial", _said("DEGRADED", "its newest window is partial"))
        .when(report["freshness"] == "unavailable", _said("UNKNOWN", "its observation is unavailable")).otherwise(_said("PRESENT", "current"))
    )


def gate_concern(disposition: Column) -> Column:
    """What the gate's answer says about publication; it grants nothing by itself."""
    return (
        F.when(disposition == "PASSED", _said("PRESENT", "passed")).when(disposition == "REFUSED", _said("REFUSED", "refused"))
        .when(disposition == "ERROR", _said("DEGRADED", "could not be judged")).otherwise(_said("ABSENT", "nothing to judge"))
    )


def currency(newest_end_s: Column, now_s: Column, width_s: Column, partial: Column) -> Column:
    """Whether the newest window is recent: within two windows and five seconds."""
    age = now_s - newest_end_s
    return (
        F.when(newest_end_s.isNull(), _said("ABSENT", "no window")).when(age > 2 * width_s + 5, _said("STALE", "the newest window is old"))
        .when(partial, _said("DEGRADED", "the newest window is partial")).otherwise(_said("PRESENT", "current"))
    )


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, names_identity) of a store's tables, and a row without a column for each required one that is missing."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, c.lower() in IDENTITY_COLUMNS) for t, df in sorted(tables.items()) for c in df.columns]
    rows += [(t, None, False) for t in REQUIRED_TABLES if t not in tables]
    return spark.createDataFrame(rows, "table string, column string, names_identity boolean")


def latest(runs: DataFrame, health: DataFrame) -> DataFrame:
    """The run that started last with its newest window: one row, or none."""
    last = runs.agg(F.max(F.struct("started_at", "run_id")).alias("x")).select("x.run_id", "x.started_at").where("run_id is not null")
    window = health.join(F.broadcast(last), "run_id").groupBy("run_id").agg(F.max_by(F.struct("bucket_start", "bucket_width", "events_seen", "observed_duration_us", "observed_to_us", "partial"), "bucket_start").alias("health"))
    return last.join(window, "run_id", "left")
