"""The most frequent names of streams with any number of names: bounded summaries first, then an exact count of candidates.

A task holds ``size`` counters a group: when there are more, the least is taken off all of them, and what was taken off is kept
as the summary's error.  A name's true count is at least its merged counter and at most that plus all errors, so the names
that can be among the most frequent are known, and few where some names stand out; they are counted exactly, and the count
proves that none is missed.  Where none stands out (all names about as frequent), every name is counted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import held

#: Counters that a task holds for each group.
SIZE = 4096


def summaries(df: DataFrame, group: str, name: str, size: int) -> DataFrame:
    """(group, name, n): counters of all tasks; a row without a name is a task's error for the group.  Null names do not count."""

    def run(batches):
        held_: dict[str, dict[str, int]] = {}
        lost: dict[str, int] = {}
        for batch in batches:
            counts = pa.Table.from_batches([batch]).group_by(["g", "x"]).aggregate([("x", "count")])
            for g, x, n in zip(*(counts.column(c).to_pylist() for c in ("g", "x", "x_count")), strict=True):
                own = held_.setdefault(g, {})
                own[x] = own.get(x, 0) + n
            for g, own in held_.items():
                if len(own) > size:
                    off = sorted(own.values(), reverse=True)[size]
                    held_[g] = {x: n - off for x, n in own.items() if n > off}
                    lost[g] = lost.get(g, 0) + off
        out = [(g, x, n) for g, own in held_.items() for x, n in own.items()] + [(g, None, n) for g, n in lost.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()), strict=True)], ["g", "x", "n"])

    rows = df.where(F.col(name).isNotNull()).select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(name).cast("string").alias("x"))
    return rows.mapInArrow(run, "g string, x string, n long").groupBy("g", "x").agg(F.sum("n").alias("n"))


def most_frequent(df: DataFrame, group: str, name: str, k: int, size: int = SIZE) -> DataFrame:
    """(group, name, n): the k most frequent names of each group, by count and then by name, exactly; fewer where there are
    fewer.  Groups are few (each has its counters in every task); null ones count as the empty text.

    Where a summary's error is not below the k-th count, its group has no bounded candidates, and all of its names are counted:
    one more pass over the rows, however many names there are.
    """
    merged = held(summaries(df, group, name, size))
    error = merged.where("x IS NULL").select(F.col("g").alias("eg"), F.col("n").alias("error"))
    found = merged.where("x IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "x"))
    least = found.withColumn("place", place).where(F.col("place") == k).select(F.col("g").alias("lg"), F.col("n").alias("least"))
    groups = merged.select("g").distinct().join(error, F.col("g") == F.col("eg"), "left").join(least, F.col("g") == F.col("lg"), "left")
    # A name outside the summary has at most the error; that must be below what k names have at least.
    bounds = held(groups.select("g", F.coalesce("error", F.lit(0)).alias("error"), F.coalesce("least", F.lit(0)).alias("least")).withColumn("open", F.expr("error > 0 AND error >= least")))
    asked = held(found.join(F.broadcast(bounds.where("NOT open")), "g").where("n + error >= least").select("g", "x"))  # a row a group
    rows = df.where(F.col(name).isNotNull()).select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(name).cast("string").alias("x"))
    whole = rows.join(F.broadcast(bounds.where("open").select("g")), "g", "left_semi")
    counted = rows.join(asked, ["g", "x"], "left_semi").union(whole).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "x"))).where(F.col("place") <= k)
    return ranked.select(F.col("g").alias(group), F.col("x").alias(name), "n")
