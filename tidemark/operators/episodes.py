"""Episodes: stretches of departure, their scores, their sealing, and which of them coincide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, vocab

ENTER, HOLD, MAX_GAP, MIN_WINDOWS, PEAK = 3.0, 1.5, 2, 2, 3.0


def segments(deps: DataFrame, *, enter: float = ENTER, hold: float = HOLD, gap: int = MAX_GAP) -> DataFrame:
    """Windows of episodes: the rows of ``deps`` with ``sign`` (1 excess, -1 deficit), ``segment`` and the signed ``sz``.

    Set-based hysteresis.  Holding windows no more than ``gap`` windows apart form an island; an island counts from its
    first window at ``enter`` on, and only if it has one.  Its end is stretched to the last of the ``gap`` windows behind
    its last holding one that is over ``hold`` in z, though not eligible.  Every row carries the number of the last island
    that began before it, so the islands' bounds are windows over what is dealt by metric already: one shuffle, no join.
    """
    numbered = deps.withColumn("i", F.row_number().over(Window.partitionBy("metric").orderBy("bucket_start")))
    signed = numbered.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")).withColumn("sz", F.col("sign") * F.col("z"))
    holds = F.coalesce(F.col("eligible") & (F.col("sz") >= hold), F.lit(False))
    upto = Window.partitionBy("metric", "sign").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("metric", "sign").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    marked = signed.withColumn("__holds", holds).withColumn("__before", F.max(F.when(F.col("__holds"), F.col("i"))).over(before))
    begins = F.col("__holds") & (F.col("__before").isNull() | (F.col("i") - F.col("__before") > gap + 1))
    rows = marked.withColumn("segment", F.sum(begins.cast("int")).over(upto))
    island = Window.partitionBy("metric", "sign", "segment")
    rows = rows.withColumns({"__first": F.min(F.when(F.col("__holds") & (F.col("sz") >= enter), F.col("i"))).over(island), "__last": F.max(F.when(F.col("__holds"), F.col("i"))).over(island)})
    # At most ``gap`` windows behind an island may stretch it; the next one begins later than that.
    end = F.max(F.when((F.col("sz") >= hold) & (F.col("i") <= F.col("__last") + gap), F.col("i"))).over(island)
    return rows.withColumn("__end", end).where("segment > 0 AND i BETWEEN __first AND __end").drop("__holds", "__before", "__first", "__last", "__end")


def episodes(deps: DataFrame, *, min_windows: int = MIN_WINDOWS, peak: float = PEAK, **kw) -> DataFrame:
    """A row for each episode: type, bounds, score, severity, and what explains it."""
    z = F.col("sz")
    rows = segments(deps, **kw)
    names = F.create_map(*[x for m, (up, down) in vocab.EPISODES.items() for x in (F.lit(m), F.struct(F.lit(up).alias("up"), F.lit(down).alias("down")))])
    name = names[F.col("metric")]
    kind = F.when(F.col("sign") > 0, F.coalesce(name["up"], F.lit(vocab.EPISODE_DEFAULT[0]))).otherwise(F.coalesce(name["down"], F.lit(vocab.EPISODE_DEFAULT[1])))
    known = Window.partitionBy("metric", "sign", "segment").orderBy("i")
    rows = rows.withColumn("place", F.sum(z.isNotNull().cast("int")).over(known.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = rows.groupBy("metric", "sign", "segment").agg(
        F.min("bucket_start").alias("start_s"), F.max(F.col("bucket_start") + F.col("bucket_width")).alias("end_s"), F.count(F.lit(1)).alias("n_windows"), F.sum("count").alias("events"),
        F.max("sz").alias("peak_z"), F.avg("sz").alias("mean_z"), F.max("value").alias("top"), F.min("value").alias("bottom"), F.avg("baseline_mean").alias("baseline"),
        F.min(F.when(z.isNotNull(), F.struct((-z).alias("v"), "place"))).alias("best"), F.count("sz").alias("n_z"), F.array_sort(F.collect_set("quality")).alias("qualities"),
    ).where((F.col("n_windows") >= min_windows) & (F.col("peak_z") >= peak))
    extreme = F.when(F.col("sign") > 0, F.col("top")).otherwise(F.col("bottom"))
    base = F.col("baseline")
    ratio = (
        F.when(extreme.isNull() | base.isNull() | (base == 0), F.lit(1.0)).when(F.col("sign") > 0, F.try_divide(extreme, base))
        .when(extreme > 0, F.try_divide(base, extreme)).otherwise(F.greatest(base * 60.0, F.lit(2.0)))
    )
    out = grouped.withColumns({"type": kind, "extreme_rate": extreme, "rate_ratio": ratio})
    return out.select(
        "metric", "type", F.when(F.col("sign") > 0, "excess").otherwise("deficit").alias("direction"), "start_s", "end_s", scalars.magnitude(F.col("rate_ratio")).alias("score"),
        scalars.severity(scalars.magnitude(F.col("rate_ratio"))).alias("severity"), "n_windows", "events", "peak_z", "mean_z", "extreme_rate", F.col("baseline").alias("baseline_rate"), "rate_ratio",
        (F.col("best.place") - 1).alias("rise_windows"), (F.col("n_z") - F.col("best.place")).alias("fall_windows"),
        ((F.col("best.place") - 1) / F.greatest(F.col("n_z") - 1, F.lit(1))).alias("peak_position"), "qualities",
    )


def sealed(found: DataFrame, config: str, detector: str = "aggregate_rate_episode", version: str = "v1") -> DataFrame:
    """Adds identifiers that depend on nothing but the content: evidence, configuration and the finding itself."""
    evidence = scalars.stable_json(end=F.col("end_s"), metric=F.col("metric"), start=F.col("start_s"), windows=F.col("n_windows"))
    out = found.withColumn("evidence_id", scalars.receipt(evidence)).withColumn("config_hash", scalars.receipt(F.lit(config)))
    finding = scalars.stable_json(detector=F.lit(f"{detector}/{version}"), type=F.col("type"), start=F.col("start_s"), end=F.col("end_s"), evidence=F.col("evidence_id"), config=F.col("config_hash"), metric=F.col("metric"))
    return out.withColumn("det_id", scalars.receipt(finding))


def violations(found: DataFrame) -> DataFrame:
    """Rows of sealed findings that break a rule, with the rules they break."""
    rule = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), name)
    problems = F.array_compact(F.array(
        rule(F.col("end_s") <= F.col("start_s"), "ends before it starts"), rule(F.col("score") < 0, "negative score"), rule(~F.col("severity").isin(*vocab.SEVERITY_RANK), "unknown severity"),
        rule(~F.col("det_id").rlike("^[0-9a-f]{16}$"), "bad identifier"), rule(~F.col("evidence_id").rlike("^[0-9a-f]{16}$"), "bad evidence identifier"),
        rule(scalars.names_identity(F.to_json(F.struct(*found.columns))), "names an account"),
    ))
    return found.withColumn("problems", problems).where(F.size("problems") > 0)


def ordered(found: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in vocab.SEVERITY_RANK.items() for x in kv])
    return found.orderBy(F.desc(rank[F.col("severity")]), F.desc("score"), "start_s", "type", "metric")


def newest_per_episode(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of episodes sealed more than once the last one, by time of sealing and identifier."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("sealed_at", "det_id")).alias("__last")).select(*keys, "__last.*")


def between(rows: DataFrame, since: Column, until: Column) -> DataFrame:
    """Episodes that touch an interval."""
    return rows.where((F.col("end_s") >= since) & (F.col("start_s") <= until))


def range_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of intervals [start_s, end_s) with a common part, by way of the cells of ``width`` seconds that they touch.

    Each pair is found once, in the cell of the later start.  Columns: a (struct), b (struct), start_s, end_s.
    """
    def cells(df, name):
        touch = F.sequence(F.floor(F.col("start_s") / width), F.floor((F.col("end_s") - 1) / width))
        return df.where("start_s < end_s").select(F.struct(*df.columns).alias(name), F.explode(touch).alias("cell"))

    both = cells(left, "a").join(cells(right, "b"), "cell")
    start, end = F.greatest("a.start_s", "b.start_s"), F.least("a.end_s", "b.end_s")
    return both.where((start < end) & (F.floor(start / width) == F.col("cell"))).select("a", "b", start.alias("start_s"), end.alias("end_s"))


def co_occurrence(found: DataFrame, least_s: float = 1.0, width: int = 86_400) -> DataFrame:
    """Pairs of episodes of different types that overlap for at least ``least_s`` seconds."""
    pairs = range_join(found, found, width)
    first = F.struct("a.start_s", "a.type", "a.metric") < F.struct("b.start_s", "b.type", "b.metric")
    kept = pairs.where(first & (F.col("a.type") != F.col("b.type")) & (F.col("end_s") - F.col("start_s") >= least_s))
    return kept.select(F.col("a.metric").alias("metric_a"), F.col("a.type").alias("type_a"), F.col("b.metric").alias("metric_b"), F.col("b.type").alias("type_b"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("overlap_s"))


def summary(found: DataFrame) -> DataFrame:
    """Counts by severity, type and direction, with the spread of the scores, in one pass over grouping sets."""
    found.createOrReplaceTempView("__episodes")
    return found.sparkSession.sql(
        "SELECT severity, type, direction, count(*) AS episodes, min(score) AS low, median(score) AS mid, max(score) AS high, min(start_s) AS first_s, max(end_s) AS last_s "
        "FROM __episodes GROUP BY GROUPING SETS ((severity), (type), (direction), ())"
    )


def cooled(found: DataFrame, seconds: int) -> DataFrame:
    """Episodes that begin at least ``seconds`` after the last one of their kind that was let through."""
    import pandas as pd

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group, last, take = group.sort_values("start_s"), None, []
        for start in group.start_s:
            take.append(last is None or start - last >= seconds)
            last = start if take[-1] else last
        return group[take]

    return found.groupBy("metric", "type").applyInPandas(keep, found.schema)


def disclosable(found: DataFrame, events: DataFrame, least_actors: int = 10, cell_s: int = 3600) -> DataFrame:
    """Adds what decides whether an episode may be shown: distinct actors, the most active one's share, and ``public``.

    events: (metric, us, actor).  An episode is public if it has at least ``least_actors`` actors and no single one made up
    all that exceeds the baseline; without a baseline it is not.  Events meet episodes in cells of ``cell_s`` seconds, in
    which an actor's events of one second travel as one row.
    """
    cells = found.select("metric", "type", "start_s", "end_s", F.explode(F.sequence(F.floor(F.col("start_s") / cell_s), F.floor((F.col("end_s") - 1) / cell_s))).alias("cell"))
    second = F.floor(F.col("us") / F.lit(scalars.MICROS))
    acts = events.groupBy("metric", "actor", second.alias("s")).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.floor(F.col("s") / cell_s))
    inside = acts.join(cells, ["metric", "cell"]).where((F.col("s") >= F.col("start_s")) & (F.col("s") < F.col("end_s")))
    per = inside.groupBy("metric", "type", "start_s", "actor").agg(F.sum("n").alias("n"))
    per = per.groupBy("metric", "type", "start_s").agg(F.count(F.lit(1)).alias("actors"), F.max("n").alias("most_by_one"), F.sum("n").alias("acts"))
    joined = found.join(per, ["metric", "type", "start_s"], "left").fillna(0, ["actors", "most_by_one", "acts"])
    spread = F.col("most_by_one") < F.col("acts") - F.col("baseline_rate") * (F.col("end_s") - F.col("start_s"))
    return joined.withColumn("public", (F.col("actors") >= least_actors) & F.coalesce(spread, F.lit(False)))


def public_view(found: DataFrame) -> DataFrame:
    """What of a disclosable episode is shown: named columns only, hours and bands instead of exact values."""
    start, end = scalars.coarse_period(F.timestamp_seconds("start_s"), F.timestamp_seconds("end_s"))
    band = F.when(F.col("score") >= 3.5, "extreme").when(F.col("score") >= 2, "large").when(F.col("score") >= 1, "moderate").otherwise("small")
    return found.where("public").select("type", "direction", F.unix_seconds(start).alias("from_s"), F.unix_seconds(end).alias("to_s"), band.alias("band"), "severity")
