"""Derived numbers of a series: departures from a trailing baseline, ratios, correlations.

A baseline is made of the last ``n`` eligible windows strictly before the current one, however far back they reach.  It is
computed in two passes: over the eligible rows alone, a frame of n rows; then every row takes the last such result before it.
Both passes share one partitioning by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, stats, vocab

BASELINE_N, MIN_SAMPLES, MAD_TO_SIGMA = 15, 5, 1.4826


def trailing(points: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Adds ``history``: the values of the last n eligible rows before each row, oldest first."""
    order = Window.partitionBy(*by).orderBy("bucket_start")
    teach = F.col("eligible") & F.col(value).isNotNull()
    marked = points.withColumn("__teach", teach)
    own = Window.partitionBy(*by, "__teach").orderBy("bucket_start").rowsBetween(-(n - 1), 0)
    carried = marked.withColumn("__run", F.when(F.col("__teach"), F.collect_list(value).over(own)))
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("__run", ignorenulls=True).over(back)
    return carried.withColumn("history", F.coalesce(last, F.array().cast("array<double>"))).drop("__run", "__teach")


def mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def stddev_of(values: Column) -> Column:
    """Sample deviation of an array; null for fewer than two values."""
    m = mean_of(values)
    return F.when(F.size(values) > 1, F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (F.size(values) - 1)))


def median_of(values: Column) -> Column:
    s = F.array_sort(values)
    k = F.size(values)
    return F.when(k > 0, (F.element_at(s, F.floor((k + 1) / 2).cast("int")) + F.element_at(s, (F.floor(k / 2) + 1).cast("int"))) / 2)


def departures(points: DataFrame, *, by: tuple[str, ...] = ("metric",), n: int = BASELINE_N, least: int = MIN_SAMPLES, robust: bool = False) -> DataFrame:
    """Every window against its baseline: value, baseline_mean, baseline_std, baseline_n, z, pct_change, condition.

    robust: median and scaled median deviation; the sample deviation where that is 0.
    """
    held = trailing(points, list(by), "rate", n)
    h, enough = F.col("history"), F.size("history") >= least
    held = held.withColumns({"baseline_n": F.size("history"), "baseline_mean": F.when(enough, median_of(h) if robust else mean_of(h))})
    if robust:
        mad = median_of(F.transform("history", lambda x: F.abs(x - F.col("baseline_mean"))))
        held = held.withColumn("__mad", F.when(enough, mad)).withColumn("baseline_std", F.when(F.col("__mad") > 0, F.col("__mad") * MAD_TO_SIGMA).when(enough, stddev_of(h))).drop("__mad")
    else:
        held = held.withColumn("baseline_std", F.when(enough, stddev_of(h)))
    value, m, s = F.col("rate"), F.col("baseline_mean"), F.col("baseline_std")
    held = held.withColumns({"z": scalars.zscore(value, m, s), "pct_change": scalars.pct_change(value, m)})
    out = held.withColumn("condition", scalars.condition(F.col("z"), F.col("pct_change"))).withColumnRenamed("rate", "value")
    return out.select(*by, "bucket_start", "bucket_width", "value", "count", "baseline_mean", "baseline_std", "baseline_n", "z", "pct_change", "condition", "eligible", "quality", "flags")


def latest(deps: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """The last window of each series that has a value."""
    known = deps.where(F.col("value").isNotNull())
    return known.groupBy(*by).agg(F.max_by(F.struct(*[c for c in deps.columns if c not in by]), "bucket_start").alias("__last")).select(*by, "__last.*")


def ratios(points: DataFrame, named: list[tuple[str, str, str]]) -> DataFrame:
    """(ratio, bucket_start, numerator, denominator, value, observed, quality) of pairs of metrics on one grid."""
    pairs = F.broadcast(points.sparkSession.createDataFrame(named, "ratio string, num string, den string"))
    a = points.join(pairs, points["metric"] == pairs["num"]).select("ratio", "den", "bucket_start", F.col("count").alias("numerator"), F.col("quality").alias("qa"))
    b = points.select(F.col("metric").alias("den"), "bucket_start", F.col("count").alias("denominator"), F.col("quality").alias("qb"))
    observed = F.col("numerator").isNotNull() & F.col("denominator").isNotNull()
    quality = F.when(~observed, vocab.UNOBSERVED).when(F.col("qa") != vocab.CLEAN, F.col("qa")).otherwise(F.col("qb"))
    return a.join(b, ["den", "bucket_start"], "left").select(
        "ratio", "bucket_start", "numerator", "denominator", F.when(observed, scalars.ratio(F.col("numerator"), F.col("denominator"))).alias("value"), observed.alias("observed"), quality.alias("quality")
    )


def ratio_extremes(ratio: DataFrame, least: int = 30) -> DataFrame:
    """Least and greatest value of each ratio over windows with a denominator of at least ``least``; thinner ones are counted."""
    thick = (F.col("denominator") >= least) & F.col("value").isNotNull()
    v = F.when(thick, F.col("value"))
    return ratio.groupBy("ratio").agg(
        F.min(v).alias("low"), F.max(v).alias("high"), F.min(F.when(thick, F.struct("value", "bucket_start"))).alias("__lo"), F.max(F.when(thick, F.struct("value", (-F.col("bucket_start")).alias("t")))).alias("__hi"),
        F.count_if(thick).alias("windows"), F.count_if(F.col("value").isNotNull() & ~thick).alias("thin_windows"),
    ).select("ratio", "low", F.col("__lo.bucket_start").alias("low_at"), "high", (-F.col("__hi.t")).alias("high_at"), "windows", "thin_windows")


def aggregate_rates(points: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Counts, observed seconds and their quotient over the observed windows of each series."""
    seen = F.col("count").isNotNull()
    out = points.groupBy(*by).agg(
        F.sum("count").alias("total"), (F.sum(F.when(seen, F.col("observed_duration_us"))) / 1e6).alias("observed_s"), F.count(F.lit(1)).alias("windows"), F.count_if(seen).alias("observed"), F.count_if("eligible").alias("eligible")
    )
    return out.withColumn("mean_rate", F.when(F.col("observed_s") > 0, F.col("total") / F.col("observed_s")))


def combined_rate(points: DataFrame, metrics: list[str]) -> DataFrame:
    """Events a second over several metrics of one observation."""
    per = aggregate_rates(points.where(F.col("metric").isin(metrics)))
    return per.agg((F.sum("total") / F.max("observed_s")).alias("rate"), F.sum("total").alias("total"))


def lagged_correlation(points: DataFrame, a: str, b: str, most: int = 5, least: int = 10) -> DataFrame:
    """(lag, pairs, r): rate of ``a`` at t against ``b`` at t + lag windows, over windows eligible on both sides."""
    fit = points.where(F.col("eligible") & F.col("rate").isNotNull())
    left = fit.where(F.col("metric") == a).select("bucket_start", F.col("rate").alias("x"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "bucket_width")
    left = left.withColumn("at", F.col("bucket_start") + F.col("lag") * F.col("bucket_width"))
    right = fit.where(F.col("metric") == b).select(F.col("bucket_start").alias("at"), F.col("rate").alias("y"))
    lags = points.sparkSession.range(-most, most + 1).select(F.col("id").cast("int").alias("lag"))
    found = left.join(right, "at").groupBy("lag").agg(F.count(F.lit(1)).alias("pairs"), stats.pearson(F.col("x"), F.col("y")).alias("r"))
    return F.broadcast(lags).join(found, "lag", "left").select("lag", F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), F.when(F.col("pairs") >= least, F.col("r")).alias("r"))


def persistence_of_noise(points: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(by, n, lag1_r, n_eff) of the eligible rates, in order."""
    fit = points.where("eligible")
    out = stats.autocorrelation(fit, list(by), "bucket_start", "rate")
    return out.withColumn("n_eff", scalars.effective_n(F.col("n"), F.col("lag1_r")))


def power(points: DataFrame, target: float = 100.0) -> DataFrame:
    """(metric, n, n_eff, days, days_to_target): how long a series must be watched, as it goes, for an effective size."""
    noise = persistence_of_noise(points)
    days = points.where("eligible").groupBy("metric").agg(F.count_distinct(scalars.day_of(F.col("bucket_start"))).alias("days"))
    return noise.join(days, "metric").select("metric", "n", "n_eff", "days", F.try_divide(F.col("days") * F.lit(target), F.col("n_eff")).alias("days_to_target"))
