"""Exact order statistics of groups of any size, from counts of values and running totals over ranges of them.

No task holds a group's values: equal values are counted where they are read, the distinct ones are dealt into ranges of
(group, value), each range adds its counts to those of the ranges before it, and a wanted rank is where that total passes it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.store import held


@dataclass(frozen=True)
class Rank:
    """A wanted value of n sorted ones: ``nearest``, the one at the rounded place (halves to even); ``upper``, the one after the
    lower half; ``between``, interpolated between the two at a place."""

    kind: str
    q: float = 0.5

    def places(self, n: Column) -> tuple[Column, Column]:
        """The places, from 0 on, of the values it is made of."""
        if self.kind == "nearest":
            at = F.bround(F.lit(self.q) * (n - 1), 0).cast("long")
            return at, at
        if self.kind == "upper":
            at = F.floor(n / 2).cast("long")
            return at, at
        place = F.lit(self.q) * (n - 1)
        return F.floor(place).cast("long"), F.ceil(place).cast("long")

    def value(self, low: Column, high: Column, n: Column) -> Column:
        if self.kind != "between":
            return low
        place = F.lit(self.q) * (n - 1)
        upper = place - F.floor(place)
        low, high = low.cast("double"), high.cast("double")
        return F.when(low == high, low).otherwise(scalars.fused(low, 1.0 - upper, high * upper))


def nearest(q: float) -> Rank:
    return Rank("nearest", q)


def between(q: float) -> Rank:
    return Rank("between", q)


UPPER_MEDIAN = Rank("upper")


def order_statistics(df: DataFrame, by: list[str], value: str, wanted: dict[str, Rank]) -> DataFrame:
    """(by, n, …): the number of known values of each group and the wanted statistics; null values do not count, and groups
    without a value have no row."""
    groups = [F.col(b).alias(f"__{i}") for i, b in enumerate(by)]
    keys = [f"__{i}" for i in range(len(by))]
    counted = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("x")]
    dealt = held(counted.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "range").agg(F.sum("c").alias("in_range"))
    whole = Window.partitionBy(*keys)
    parts = parts.select(*[F.col(k).alias(f"g{k}") for k in keys], F.col("range").alias("part"), (F.sum("in_range").over(whole.orderBy("range")) - F.col("in_range")).alias("ahead"), F.sum("in_range").over(whole).alias("n"))
    same = F.col("range") == F.col("part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"g{k}"))
    placed = dealt.withColumn("inside", F.sum("c").over(Window.partitionBy(*keys, "range").orderBy("x"))).join(parts, same)
    upto = F.col("ahead") + F.col("inside")
    picks, out = [], []
    for name, rank in wanted.items():
        for side, place in zip(("low", "high"), rank.places(F.col("n")), strict=True):
            picks.append(F.max(F.when((upto - F.col("c") <= place) & (place < upto), F.col("x"))).alias(f"{side} {name}"))
        out.append(rank.value(F.col(f"`low {name}`"), F.col(f"`high {name}`"), F.col("n")).alias(name))
    found = placed.groupBy(*keys, "n").agg(*picks)
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], "n", *out)
