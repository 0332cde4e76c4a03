"""The field: a vector of quantities for each window, what is usual for each hour of day, and conditions.

Roles (posts, replies, …) are metrics; which is which is a parameter, since streams name them differently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, stats
from ..sources.store import held
from . import derive, ranks

QUANTITIES = (
    "emission_velocity", "interaction_velocity", "interaction_pressure", "reply_share", "graph_velocity", "boundary_share", "withdrawal_share", "turbulence", "acceleration",
)
#: Which metrics play which role.
ROLES = {
    "posts": ["post.create"], "replies": ["post.create.reply"], "reactions": ["post.create.reply", "post.create.quote", "repost.create", "like.create"],
    "graph": ["follow.create", "follow.delete", "block.create", "block.delete", "listitem.create", "listitem.delete"], "blocks": ["block.create"], "follows": ["follow.create"],
    "creates": ["post.create", "like.create", "repost.create", "follow.create", "block.create", "listitem.create"],
    "deletes": ["post.delete", "like.delete", "repost.delete", "follow.delete", "block.delete", "listitem.delete"],
}
#: The percentiles that describe what is usual.
SPREAD = {f"p{q:02d}": ranks.between(q / 100) for q in (5, 25, 50, 75, 95)}
CONTEXT, DEGENERATE, EXCEEDANCE, NOMINAL = 10, 0.01, 0.05, 0.10


def vectors(points: DataFrame, roles: dict[str, list[str]] = ROLES) -> DataFrame:
    """(bucket_start, bucket_width, observed, eligible, quality, observed_s, quantities): windows not observed have nulls."""
    names = sorted({m for ms in roles.values() for m in ms})
    wide = points.where(F.col("metric").isin(names)).groupBy("bucket_start").agg(
        F.first("bucket_width").alias("bucket_width"), F.bool_and(F.col("count").isNotNull()).alias("observed"), F.bool_and("eligible").alias("eligible"), F.first("quality").alias("quality"),
        (F.max("observed_duration_us") / 1e6).alias("observed_s"), *[F.max(F.when(F.col("metric") == m, F.col("rate"))).alias(f"r_{i}") for i, m in enumerate(names)],
    )
    rate = {m: F.col(f"r_{i}") for i, m in enumerate(names)}
    of = lambda role: [rate[m] for m in roles[role]]
    emission, interaction = scalars.total(of("posts")), scalars.total(of("reactions"))
    made, gone = scalars.total(of("creates")), scalars.total(of("deletes"))
    blocks, follows = scalars.total(of("blocks")), scalars.total(of("follows"))
    plain = wide.select(
        "bucket_start", "bucket_width", "observed", "eligible", "quality", "observed_s", emission.alias("emission_velocity"), interaction.alias("interaction_velocity"),
        scalars.positive_ratio(interaction, emission).alias("interaction_pressure"), scalars.share(scalars.total(of("replies")), of("reactions")).alias("reply_share"),
        scalars.total(of("graph")).alias("graph_velocity"), scalars.share(blocks, [blocks, follows]).alias("boundary_share"), scalars.share(gone, [gone, made]).alias("withdrawal_share"),
    )
    held = derive.trailing(plain.withColumn("__one", F.lit(1)), ["__one"], "interaction_velocity", CONTEXT)
    mean, deviation = derive.mean_of(F.col("history")), derive.stddev_of(F.col("history"))
    turbulence = F.when(F.col("observed") & (mean > 0), deviation / mean)
    change = F.when(F.col("observed") & (F.size("history") > 0), F.col("interaction_velocity") - F.element_at("history", -1))
    return held.withColumns({"turbulence": turbulence, "acceleration": change}).drop("history", "__one")


def long(field: DataFrame) -> DataFrame:
    """(bucket_start, quantity, value, hour, day) of the eligible windows with a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(q).alias("value")) for q in QUANTITIES])).alias("__p")
    rows = field.where("eligible").select("bucket_start", pairs, scalars.hour_of(F.col("bucket_start")).alias("hour"), scalars.day_of(F.col("bucket_start")).alias("day"))
    return rows.select("bucket_start", "__p.quantity", "__p.value", "hour", "day")


def diurnal(field: DataFrame) -> DataFrame:
    """(quantity, hour, n, n_days, p05 … p95): what is usual at each hour of day."""
    rows = held(long(field))
    days = rows.groupBy("quantity", "hour").agg(F.count("value").alias("n"), F.count_distinct("day").alias("n_days"))
    return days.join(ranks.order_statistics(rows, ["quantity", "hour"], "value", SPREAD).drop("n"), ["quantity", "hour"], "left")


def overall(field: DataFrame, cells: DataFrame) -> DataFrame:
    """The distribution of each quantity, its effective size (raw, and with the hour's median taken off), and how far the
    comparison is supported."""
    rows = held(long(field).where("value is not null"))
    dist = rows.groupBy("quantity").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    dist = dist.join(ranks.order_statistics(rows, ["quantity"], "value", SPREAD).drop("n"), "quantity").select("quantity", "n", "mean", "sd", *SPREAD, "minimum", "maximum")
    residual = rows.join(F.broadcast(cells.select("quantity", "hour", "p50")), ["quantity", "hour"]).withColumn("residual", F.col("value") - F.col("p50"))
    raw = stats.autocorrelation(rows, ["quantity"], "bucket_start", "value").drop("n")
    rest = stats.autocorrelation(residual, ["quantity"], "bucket_start", "residual", "residual_r").drop("n")
    days = field.where("eligible").agg(F.count_distinct(scalars.day_of(F.col("bucket_start"))).alias("n_days"))
    out = dist.join(raw, "quantity", "left").join(rest, "quantity", "left").crossJoin(F.broadcast(days))  # one row of days
    out = out.withColumns({"n_eff": scalars.effective_n(F.col("n"), F.col("lag1_r")), "residual_n_eff": scalars.effective_n(F.col("n"), F.col("residual_r"))})
    return out.withColumn("support", scalars.support(F.col("n_days"), F.col("n_eff")))


def candidates(field: DataFrame, cells: DataFrame, dist: DataFrame) -> DataFrame:
    """Windows outside the 5th to 95th percentile of their hour by more than a twentieth of that band."""
    usable = dist.where("support <> 'unsupported'").select("quantity", "support")
    rows = long(field).where("value is not null").join(F.broadcast(usable), "quantity")
    rows = rows.join(F.broadcast(cells.select("quantity", "hour", "p05", "p50", "p95", F.col("n_days").alias("cell_days"))), ["quantity", "hour"])
    band = F.col("p95") - F.col("p05")
    level = F.greatest(F.abs(F.coalesce("p50", F.lit(0.0))), F.lit(1e-9))
    direction = F.when(F.col("value") > F.col("p95") + EXCEEDANCE * band, "above").when(F.col("value") < F.col("p05") - EXCEEDANCE * band, "below")
    return rows.where(band > DEGENERATE * level).withColumn("direction", direction).where("direction is not null").select("bucket_start", "quantity", "value", "direction", "p05", "p95", "cell_days", "support")


def candidate_rate(field: DataFrame, dist: DataFrame, found: DataFrame) -> DataFrame:
    """Share of scored values that are candidates, against the share that the rule gives by construction."""
    scored = long(field).where("value is not null").join(F.broadcast(dist.where("support <> 'unsupported'").select("quantity")), "quantity", "left_semi")
    pairs, marked = scored.agg(F.count(F.lit(1)).alias("scored_pairs")), found.agg(F.count(F.lit(1)).alias("candidates"))
    out = pairs.crossJoin(F.broadcast(marked))  # one row each
    return out.withColumn("observed_rate", scalars.ratio(F.col("candidates"), F.col("scored_pairs"))).withColumn("excess_over_nominal", F.col("observed_rate") - NOMINAL)


def placed(field: DataFrame, cells: DataFrame) -> DataFrame:
    """Each window with its hour's cells of interaction velocity and turbulence, and how long it has been elevated.

    ``runs`` counts the windows up to this one, without a break, that are above their hour's 75th percentile.
    """
    cell = lambda q, names: cells.where(F.col("quantity") == q).select("hour", *[F.col(a).alias(b) for a, b in names.items()])
    rows = field.withColumn("hour", scalars.hour_of(F.col("bucket_start")))
    rows = rows.join(F.broadcast(cell("interaction_velocity", {"p50": "p50", "p75": "p75", "p95": "p95"})), "hour", "left")
    rows = rows.join(F.broadcast(cell("turbulence", {"p95": "turbulence_p95"})), "hour", "left")
    rows = rows.withColumn("elevated", F.coalesce(F.col("interaction_velocity") > F.col("p75"), F.lit(False)))
    order = Window.partitionBy("bucket_width").orderBy("bucket_start")
    rows = rows.withColumn("i", F.row_number().over(order))
    broken = F.coalesce(F.max(F.when(~F.col("elevated"), F.col("i"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("runs", F.col("i") - broken)


def state(iv: Column, runs: Column, turbulence_high: Column) -> Column:
    """The named state of a window."""
    ratio = F.try_divide(iv, F.col("p50"))
    over95, over75, lasting = iv > F.col("p95"), iv > F.col("p75"), runs >= 2
    return (
        F.when(over95 & (F.coalesce(ratio, F.lit(0.0)) >= 3) & (runs >= 3), "severe").when(over95 & lasting, "storm").when((over75 | turbulence_high) & lasting, "turbulent")
        .when(turbulence_high | over95, "unsettled").when(over75, "active").otherwise("calm")
    )


def conditions(field: DataFrame, cells: DataFrame, dist: DataFrame, at: list[int] | None = None, stale_windows: int = 15) -> DataFrame:
    """(at_s, state, bucket_start, ratio, runs, support): the state as of the last eligible window before each time.

    at: times in seconds (default: the end of the field).  A time with no such window, or only one older than
    ``stale_windows``, is ``station_offline``; one whose hour cannot be compared is ``unavailable``.
    """
    spark = field.sparkSession
    support = {r.quantity: r.support for r in dist.select("quantity", "support").collect()}  # a row for each quantity
    rows = placed(field, cells)
    if at is None:
        at = [r[0] for r in field.agg(F.max(F.col("bucket_start") + F.col("bucket_width"))).collect() if r[0] is not None]
    times = spark.createDataFrame([(t,) for t in at], "at_s long")  # a row for each asked time
    # Each window goes to the first asked time that it is over by; what is last before a time is a running maximum over those.
    end = F.col("bucket_start") + F.col("bucket_width")
    asked = F.filter(F.array(*[F.lit(t).cast("long") for t in sorted(set(at))]), lambda t: t >= end)
    last = rows.withColumn("slot", F.try_element_at(asked, F.lit(1))).where("slot IS NOT NULL").groupBy("slot").agg(
        F.max(F.when(F.col("eligible"), F.struct("bucket_start", "bucket_width", "interaction_velocity", "turbulence", "p50", "p75", "p95", "turbulence_p95"))).alias("w"), F.max(F.struct("bucket_start", "runs")).alias("r")
    )
    upto = Window.orderBy("at_s").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as times
    out = times.distinct().join(last, F.col("at_s") == F.col("slot"), "left").select("at_s", F.max("r").over(upto)["runs"].alias("runs"), F.max("w").over(upto).alias("w"))
    out = times.join(out, "at_s").select("at_s", "runs", F.col("w.bucket_start").alias("known"), "w.*")
    high = F.coalesce(F.col("turbulence") > F.col("turbulence_p95"), F.lit(False)) & F.lit(support.get("turbulence", "unsupported") != "unsupported")
    behind = (F.col("at_s") - F.col("bucket_start") - F.col("bucket_width")) / F.col("bucket_width")
    comparable = F.col("interaction_velocity").isNotNull() & F.col("p95").isNotNull() & F.lit(support.get("interaction_velocity", "unsupported") != "unsupported")
    named = F.when(F.col("known").isNull() | (behind > stale_windows), "station_offline").when(~comparable, "unavailable").otherwise(state(F.col("interaction_velocity"), F.col("runs"), high))
    return out.select("at_s", named.alias("state"), "bucket_start", F.try_divide(F.col("interaction_velocity"), F.col("p50")).alias("ratio"), "runs", F.lit(support.get("interaction_velocity", "unsupported")).alias("support"))


def reasons(found: DataFrame) -> DataFrame:
    """What is said about a state: far above, far below, or near what is usual."""
    said = F.when(F.col("ratio") >= 1.25, "above usual").when(F.col("ratio") <= 0.8, "below usual").when(F.col("ratio").isNotNull(), "within usual range")
    return found.withColumn("reason", said)


def swing(cells: DataFrame) -> DataFrame:
    """Greatest over least hourly median of each quantity."""
    return cells.groupBy("quantity").agg(F.max("p50").alias("high"), F.min("p50").alias("low")).withColumn("swing", scalars.positive_ratio(F.col("high"), F.col("low")))


def heat(field: DataFrame, quantity: str) -> DataFrame:
    """Mean by day and hour."""
    return field.where(F.col(quantity).isNotNull()).groupBy(scalars.day_of(F.col("bucket_start")).alias("day"), scalars.hour_of(F.col("bucket_start")).alias("hour")).agg(F.avg(quantity).alias("mean"), F.count(F.lit(1)).alias("windows"))


def portrait(field: DataFrame, x: str, y: str, columns: int = 60, rows: int = 34) -> DataFrame:
    """Counts of windows in a grid over two quantities."""
    known = field.where(F.col("eligible") & F.col(x).isNotNull() & F.col(y).isNotNull())
    bounds = known.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    place = lambda v, lo, hi, n: F.least(F.lit(n - 1), F.floor(F.coalesce(F.try_divide((v - lo) * n, hi - lo), F.lit(0.0)))).cast("int")
    put = known.crossJoin(F.broadcast(bounds))  # one row of bounds
    return put.groupBy(place(F.col(x), F.col("x0"), F.col("x1"), columns).alias("bx"), place(F.col(y), F.col("y0"), F.col("y1"), rows).alias("by")).agg(F.count(F.lit(1)).alias("windows"))


def marked(field: DataFrame, cells: DataFrame, x: str, y: str, most: int = 60) -> DataFrame:
    """(bucket_start, x, y, distance): the windows of the portrait that are farthest outside the 5th to 95th percentile of x at
    their hour, ``most`` at most (the earlier among equals).  Every task keeps no more than that many."""
    band = cells.where((F.col("quantity") == x) & F.col("p95").isNotNull()).select(F.col("hour").alias("of"), "p05", "p95")
    known = field.where(F.col("eligible") & F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = known.join(F.broadcast(band), scalars.hour_of(F.col("bucket_start")) == F.col("of"))  # a row for each hour of day
    distance = F.greatest(F.col(x) - F.col("p95"), F.col("p05") - F.col(x))
    return rows.withColumn("distance", distance).where("distance > 0").orderBy(F.desc("distance"), "bucket_start").limit(most).select("bucket_start", x, y, "distance")


def radar(field: DataFrame, cells: DataFrame, quantity: str = "interaction_velocity", hours: int = 24) -> DataFrame:
    """Upper median, for each hour of the last day, of the value over the hour's median."""
    last = field.agg(F.max("bucket_start").alias("last"))
    recent = field.crossJoin(F.broadcast(last)).where(F.col("bucket_start") > F.col("last") - hours * 3600)  # one row
    rows = recent.withColumn("hour", scalars.hour_of(F.col("bucket_start"))).join(F.broadcast(cells.where(F.col("quantity") == quantity).select("hour", "p50")), "hour")
    ratio = scalars.positive_ratio(F.col(quantity), F.col("p50"))
    found = ranks.order_statistics(rows.withColumn("over", ratio), ["hour"], "over", {"ratio": ranks.UPPER_MEDIAN})
    return found.select("hour", "ratio", F.col("n").alias("windows"))


def observations(field: DataFrame, window: str) -> DataFrame:
    """Documents of windows: maps of what was measured and of why other quantities were not, with their own identifier."""
    measured = F.map_filter(F.create_map(*[x for q in QUANTITIES for x in (F.lit(q), F.round(F.col(q), 6))]), lambda _, v: v.isNotNull())
    why = F.when(~F.col("observed"), "window not observed").otherwise("no value in this window")
    missing = F.map_filter(F.create_map(*[x for q in QUANTITIES for x in (F.lit(q), F.when(F.col(q).isNull(), why))]), lambda _, v: v.isNotNull())
    rows = field.select("bucket_start", (F.col("bucket_start") + F.col("bucket_width")).alias("bucket_end"), F.lit(window).alias("window"), "quality", "eligible", measured.alias("metrics"), missing.alias("unavailable"))
    return rows.withColumn("observation_id", scalars.receipt(scalars.stable_json(start=F.col("bucket_start"), window=F.col("window"), quality=F.col("quality"), metrics=F.col("metrics"))))


def unsaved(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Observations that the store does not hold yet."""
    return new.join(stored.select("observation_id"), "observation_id", "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
