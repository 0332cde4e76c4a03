"""Sealed documents: climatologies and observations, their identities, and the reading of what is stored.

An identity is a content address of what was found, without what slides from one sealing to the next: the extent in time of
a climatology, the baseline that an observation was compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import field

#: What an observation carries of the baseline that it is compared with; no part of its identity.
EVIDENCE = ("baseline_days", "baseline_n_eff", "support", "climatology_id")
#: What a climatology says of the slice of time that it was fitted on; no part of its identity.
EXTENT = ("n_days", "first_s", "last_s", "sealed_at")
MILLIONTHS = 1_000_000


def _fixed(name: str) -> Column:
    """A number in whole millionths: the same text on every machine."""
    return F.round(F.col(name) * MILLIONTHS).cast("long").alias(name)


def identity_columns(df: DataFrame, dropped: tuple[str, ...] = (*EVIDENCE, *EXTENT)) -> list[str]:
    """The columns of a document that its identity is made of, sorted."""
    return sorted(c for c in df.columns if c not in dropped and not c.endswith("_id"))


def climatology(cells: DataFrame, dist: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: the fitted baseline as text, its identity, and its extent.  There is a cell for each quantity and hour, so
    their number has a bound."""
    hours = cells.select("quantity", F.struct("hour", "n", *map(_fixed, ("p05", "p25", "p50", "p75", "p95"))).alias("cell"))
    hours = hours.groupBy("quantity").agg(F.sort_array(F.collect_list("cell")).alias("hours"))
    fitted = dist.select("quantity", "support", *map(_fixed, ("p05", "p25", "p50", "p75", "p95"))).join(hours, "quantity")
    text = fitted.agg(F.to_json(F.sort_array(F.collect_list(F.struct("quantity", "support", "p05", "p25", "p50", "p75", "p95", "hours"))), {"ignoreNullFields": "false"}).alias("fitted"))
    extent = rows.where("eligible").agg(F.count_distinct(scalars.day_of(F.col("bucket_start"))).alias("n_days"), F.min("bucket_start").alias("first_s"), F.max(F.col("bucket_start") + F.col("bucket_width")).alias("last_s"))
    return text.crossJoin(extent).withColumn("climatology_id", scalars.receipt(F.col("fitted")))  # one row each


def newest(stored: DataFrame, climatology_id: str | None = None) -> DataFrame:
    """The stored climatology of that identity, or the one that was sealed last; no rows if there is none."""
    rows = stored if climatology_id is None else stored.where(F.col("climatology_id") == climatology_id)
    return rows.orderBy(F.desc("sealed_at"), F.desc("climatology_id")).limit(1)


def evidence(cells: DataFrame, dist: DataFrame, quantity: str = "interaction_velocity") -> DataFrame:
    """(hour, baseline_days, baseline_n_eff, support): what an hour's cell contributes to the observations of that hour."""
    hours = cells.where(F.col("quantity") == quantity).select("hour", F.col("n_days").alias("baseline_days"))
    whole = dist.where(F.col("quantity") == quantity).select(F.round("n_eff", 2).alias("baseline_n_eff"), "support")
    return hours.crossJoin(F.broadcast(whole))  # one row of a quantity


def rescored(observations: DataFrame, cells: DataFrame, dist: DataFrame, climatology_id: str | None) -> DataFrame:
    """Stored observations with the evidence of another baseline; their identity stays.  Without a baseline for its hour an
    observation is unsupported."""
    kept = observations.drop(*EVIDENCE).withColumn("__hour", scalars.hour_of(F.col("bucket_start")))
    joined = kept.join(F.broadcast(evidence(cells, dist).withColumnRenamed("hour", "__hour")), "__hour", "left").drop("__hour")
    return joined.withColumns({"baseline_days": F.coalesce("baseline_days", F.lit(0)).cast("long"), "support": F.coalesce("support", F.lit("unsupported")), "climatology_id": F.lit(climatology_id)})


def observation_identity() -> Column:
    """The identity of an observation, from its own columns: what a stored one must agree with."""
    return scalars.receipt(scalars.stable_json(start=F.col("bucket_start"), window=F.col("window"), quality=F.col("quality"), metrics=F.col("metrics")))


def disagreeing(observations: DataFrame) -> DataFrame:
    """Stored observations whose identity does not follow from what they say."""
    return observations.where(observation_identity() != F.col("observation_id"))


def recent(stored: DataFrame, limit: int, since: int | None = None, until: int | None = None) -> tuple[DataFrame, int]:
    """The most recent ``limit`` windows and how many there are in all: of a window that was sealed more than once the last."""
    rows = stored if since is None else stored.where(F.col("bucket_start") >= since)
    rows = rows if until is None else rows.where(F.col("bucket_start") <= until)
    rest = [c for c in rows.columns if c not in ("bucket_start", "window")]
    last = rows.groupBy("bucket_start", "window").agg(F.max_by(F.struct(*rest), "sealed_at").alias("__last")).select("bucket_start", "window", "__last.*")
    total = rows.select("bucket_start").distinct().count()
    return last.orderBy(F.desc("bucket_start"), "window").limit(limit), total


def place_in_words(value: Column, p05: Column, p25: Column, p75: Column, p95: Column) -> Column:
    """Where a value is among those of its hour (to nine digits: a percentile may be one of the values)."""
    value, p05, p25, p75, p95 = (F.round(x, 9) for x in (value, p05, p25, p75, p95))
    return (
        F.when(p05.isNull(), "nothing to compare with").when(value > p95, "above nearly all of this hour").when(value < p05, "below nearly all of this hour")
        .when(value > p75, "high for this hour").when(value < p25, "low for this hour").otherwise("usual for this hour")
    )


def placed_in_words(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(bucket_start, quantity, value, words)."""
    joined = field.long(rows).where("value is not null").join(F.broadcast(cells.select("quantity", "hour", "p05", "p25", "p75", "p95")), ["quantity", "hour"], "left")
    return joined.select("bucket_start", "quantity", "value", place_in_words(F.col("value"), F.col("p05"), F.col("p25"), F.col("p75"), F.col("p95")).alias("words"))
