"""Aggregates that give null instead of an error or infinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Correlation over rows where both are known; null for fewer than ``least`` pairs or a constant side."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= least) & (spread > 0), F.covar_pop(x, y) / spread)


def herfindahl(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, n, events, herfindahl): concentration of the rows of each group over a key."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("__c"))
    out = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("__c").alias("events"), F.sum(F.col("__c").cast("double") * F.col("__c")).alias("__q"))
    return out.select(*by, "n", "events", F.try_divide(F.col("__q"), F.col("events").cast("double") * F.col("events")).alias("herfindahl"))


def autocorrelation(df: DataFrame, by: list[str], order: str, value: str, name: str = "lag1_r") -> DataFrame:
    """(by, n, name): correlation of neighbours, by order, of the known values; null for fewer than 3 or constant ones."""
    known = df.where(F.col(value).isNotNull())
    mean = known.groupBy(*by).agg(F.avg(value).alias("__m"))
    paired = known.withColumn("__next", F.lead(value).over(Window.partitionBy(*by).orderBy(order))).join(mean, by)
    d, e = F.col(value) - F.col("__m"), F.col("__next") - F.col("__m")
    out = paired.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("__den"), F.sum(d * e).alias("__num"))
    return out.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("__den") > 0), F.col("__num") / F.col("__den")).alias(name))


def nearest_rank(values: Column, q: float) -> Column:
    """Percentile of a short array by the rounded index (halves to even)."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, F.bround(F.lit(q) * (F.size(values) - 1), 0).cast("int") + 1))


def upper_median(values: Column) -> Column:
    """The one after the lower half of a short array."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int")))
