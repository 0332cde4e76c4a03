"""Values that depend on all earlier rows of an ordered table, without one task that holds the order.

The rows are dealt into ranges of the order; each range is folded on its own into what it does to any value that comes in, these
few rows are composed, and each range is finished from what comes into it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import held


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` dealt into ranges of ``order`` and sorted in each; ``range`` and ``at`` number ranges and rows in order."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()})


class _Fold:
    """An exponential mean over a stretch, from any start.

    After the stretch a mean x has become a * x + b if it was above 0, and c if it was 0: a mean of 0 takes the next value as
    it is.  (It is 0 only while all values were.)
    """

    def __init__(self, alpha: float):
        self.alpha, self.a, self.b, self.c = alpha, 1.0, 0.0, 0.0

    def _from(self, start: float, values: np.ndarray) -> np.ndarray:
        return pd.Series(np.r_[start, values]).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[1:]

    def take(self, values: np.ndarray) -> np.ndarray:
        """(a, b, c) before and after each value; the state moves on."""
        out = np.empty((3, len(values) + 1))
        out[:, 0] = self.a, self.b, self.c
        out[0, 1:] = self.a * (1 - self.alpha) ** np.arange(1, len(values) + 1)
        out[1, 1:] = self._from(self.b, values)
        first = 0 if self.c else int(np.argmax(values > 0)) if (values > 0).any() else len(values)
        out[2, 1 : first + 1] = self.c
        if first < len(values):
            out[2, first + 1 :] = self._from(self.c, values) if self.c else np.r_[values[first], self._from(values[first], values[first + 1 :])]
        self.a, self.b, self.c = out[:, -1].tolist()
        return out


#: The columns that a range's fold adds.
FOLDED = ("mean_a", "mean_b", "mean_c")


def folded(df: DataFrame, by: str, value: str, alpha: float) -> DataFrame:
    """``df``, sorted by ``by`` in each partition, with what the rows of its key up to each do to a mean; rows without a value
    do nothing to it."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    place, what = df.columns.index(by), df.columns.index(value)

    def run(batches):
        key, fold = None, None
        for batch in batches:
            keys = batch.column(place).to_pandas()
            values = batch.column(what).to_numpy(zero_copy_only=False).astype(float)
            starts = np.flatnonzero(np.r_[True, (keys.to_numpy()[1:] != keys.to_numpy()[:-1]) & ~(keys.isna().to_numpy()[1:] & keys.isna().to_numpy()[:-1])]) if len(keys) else []
            out = np.empty((3, len(keys)))
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                name = (None if pd.isna(keys.iloc[lo]) else keys.iloc[lo],)
                if fold is None or name != key:
                    key, fold = name, _Fold(alpha)
                there = ~np.isnan(values[lo:hi])
                out[:, lo:hi] = fold.take(values[lo:hi][there])[:, np.cumsum(there)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in out)], [*batch.schema.names, *FOLDED])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in FOLDED)]))


def finished(dealt: DataFrame, by: str) -> DataFrame:
    """The mean at each row of what ``folded`` gave and was written, in place of the three columns.

    A range of a key is a row; a key has no more of them than there are partitions, and they are composed in order.
    """
    ends = dealt.groupBy(by, "range").agg(F.max_by(F.struct(*FOLDED), "at").alias("end")).select(F.col(by).alias("of"), F.col("range").alias("in"), "end.*")

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group, x, into = group.sort_values("in"), 0.0, []
        for a, b, c in zip(*(group[c] for c in FOLDED), strict=True):
            into.append(x)
            x = a * x + b if x else c
        return group[["of", "in"]].assign(into=into)

    starts = ends.groupBy("of").applyInPandas(compose, f"of {dealt.schema[by].dataType.simpleString()}, in int, into double")
    rows = dealt.join(starts, F.col(by).eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    return rows.withColumn("mean", F.when(F.col("into") > 0, F.col("mean_a") * F.col("into") + F.col("mean_b")).otherwise(F.col("mean_c"))).drop("of", "in", "into", *FOLDED)


def exponential_mean(df: DataFrame, by: str, order: list[Column], value: Column, alpha: float) -> DataFrame:
    """``df`` with the exponential ``mean`` of ``value`` over the rows of each key in order, and ``at``, a row's place.

    The first value above 0 is the mean as it is.  Values are 0 or above; rows without one repeat the mean.  Rows that tie in
    ``order`` are in no fixed order, so it should decide.  A key of any size is dealt over ranges.
    """
    rows = ranged(df.withColumn("__value", value.cast("double")), [F.col(by).asc_nulls_first(), *order])
    return finished(held(folded(rows, by, "__value", alpha)), by).drop("__value", "range")
