"""Mixing sources to target weights, in DataFrame functions only.

One aggregation gives the size of every source.  Sources share the whole by their weights; a source's target stops at ``most``
times its size, and what is above goes to the others by weight until none is above: the level that every weight gets is found
by rounds of one aggregate over the table of sources.  The repetition rate of a source is its target over its size.  A document
is emitted floor(rate) times, and once more if its draw, a hash of its key and text under a seed, is below the rate's fraction.

The seed of a source is one of ``SEEDS``: the one whose copies come nearest the target (the first among equals).  All are
judged by one aggregation of a sum for each, combined where the rows are read, so nothing but sums is shuffled.  A seed names
two factors modulo a prime, by which the two halves of a 52-bit digest are hashed, so that within one seed the draws of any two
documents are independent and each falls below the fraction with that probability.

The table of sources is broadcast up to ``FEW_SOURCES`` rows, counted before; beyond it is joined by source and salt, the salt
dealing a hot source over ``SALTS`` parts.  Reruns give equal rows.

Nulls: a null text has no words, and takes no part in a size; a null source is a source of its own, ordered last; null keys
draw by their texts alone.  Rows equal in key and text draw alike.  A source without words has target 0 and no copies.
Empty tables give empty results.  Very long texts only count by their words.  Other columns are read only if carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Workspace, partitions

#: Times its size that a source's target may be; weights that go round where none are given.
MOST, WEIGHTS = 3, (1, 2, 3)
#: Seeds that are judged for each source; the prime that draws are below, and the factor that leads from one number of a seed to
#: the next (the minimal standard generator's).
SEEDS, PRIME, FACTOR = 64, (1 << 31) - 1, 48271
#: Rows of the table of sources up to which it is broadcast, and parts of a source beyond.
FEW_SOURCES, SALTS = 10_000, 64

# A word is a run of anything but these.
_BLANK = "\\x20\\x09-\\x0D"


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null.  No array of words is made."""
    whole = F.coalesce(text, F.lit(""))
    marks = F.regexp_replace(whole, f"[{_BLANK}]*+[^{_BLANK}]++[{_BLANK}]*+", "x")
    return F.when(whole.rlike(f"[^{_BLANK}]"), F.length(marks)).otherwise(0).cast("long")


def digest(key: Column, text: Column) -> Column:
    """52 bits of key and text, as a long."""
    named = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, source, size, digest[, row]): what the mix needs of each document; ``row`` holds the carried columns."""
    kept = [F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), digest(F.col(key), F.col(text)).alias("digest"), *kept)


def cyclic_weights(sources: DataFrame, space: Workspace, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with a column weight: the given ones in turn, sources in the order of their code points, null last.

    Ranks come from ranges of sources and the sums of the ranges before, so no task orders all sources.
    """
    order = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(partitions(sources.sparkSession), order).withColumn("part", F.spark_partition_id())
    dealt = space.stored(dealt, "ranges")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    ranked = dealt.join(F.broadcast(before), "part").withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1)
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    return ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int"))).drop("part", "base", "rank")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, weight) with target and rate.  Weights are whole numbers above 0.

    A round takes out the sources that the level is above the limit of, and raises the level for the others; the level never
    falls, so rounds end.  The driver holds three sums.
    """
    if most < 1:
        raise ValueError("a limit below the size itself leaves nothing to share")
    wide = "decimal(38,0)"
    whole, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    whole, free, taken, out = whole or 0, weights or 0, 0, -1
    limit = F.col("source_size") * most
    while True:
        above = limit.cast("decimal(19,0)") * F.lit(free).cast("decimal(19,0)") < F.lit(whole - taken).cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
        above = F.coalesce(above, F.lit(False))
        n, used, left = sources.agg(F.count_if(above), F.sum(F.when(above, limit)).cast(wide), F.sum(F.when(~above, F.col("weight"))).cast(wide)).first()
        if n == out:
            break
        taken, free, out = int(used or 0), int(left or 0), n
    level = F.col("weight").cast("double") * F.lit(float(whole - taken)) / F.lit(float(free or 1))
    found = sources.withColumn("target", F.least(F.when(above, limit.cast("double")).otherwise(level), limit.cast("double")))
    return found.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows beside what is planned for their source."""
    plan = plan.select(*[F.col(c).alias(f"of_{c}") for c in plan.columns])
    same = F.col("source").eqNullSafe(F.col("of_source"))
    if few:
        return rows.join(F.broadcast(plan), same)
    plan = plan.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(plan, same & (F.pmod(F.col("digest"), F.lit(SALTS)) == F.col("of_salt"))).drop("of_salt")


def seeds() -> list[tuple[int, int]]:
    """The two factors of each seed."""
    return [(pow(FACTOR, 2 * k + 1, PRIME), pow(FACTOR, 2 * k + 2, PRIME)) for k in range(SEEDS)]


def _copies(high: Column, low: Column) -> Column:
    """Copies of a document beside its plan, drawn with the seed of these factors."""
    sure, half = F.floor(F.col("of_rate")), F.lit(1 << 26)
    drawn = (high * F.floor(F.col("digest") / half).cast("long") + low * (F.col("digest") % half)) % F.lit(PRIME)
    return (sure + F.when(drawn.cast("double") < (F.col("of_rate") - sure) * F.lit(float(PRIME)), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: DataFrame | None = None, *, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, size, source_size, target, rate, copies[, row]): how often each document is emitted.

    weights: (source, weight), a row for each source, whole numbers above 0; a source without one gets nothing.  Without the
    table, ``WEIGHTS`` go round over the sources in order.  ``emitted`` makes the rows of the mix.
    """
    space = Workspace(docs.sparkSession)
    rows = space.stored(sized(docs, key=key, text=text, source=source, carry=carry), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = cyclic_weights(sources, space)
    else:
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("long").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given").fillna(0, ["weight"])
    sources = space.stored(sources, "sources")
    plan, few = targets(sources, most), sources.count() <= FEW_SOURCES
    pairs = [(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in seeds()]
    sums = [F.sum(F.col("size") * _copies(a, b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]
    judged = _with_plan(rows.select("source", "size", "digest"), plan, few).groupBy("of_source").agg(F.first("of_target").alias("target"), *sums)
    offs = [F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed"), a.alias("high"), b.alias("low")) for k, (a, b) in enumerate(pairs)]
    chosen = judged.select(F.col("of_source").alias("judged"), F.array_min(F.array(*offs)).alias("by")).select("judged", "by.high", "by.low")
    plan = space.stored(plan.join(chosen, F.col("source").eqNullSafe(F.col("judged"))).drop("judged"), "plan")
    found = _with_plan(rows, plan, few)
    return found.select(
        F.col("key").alias(key), "size", F.col("of_source_size").alias("source_size"), F.col("of_target").alias("target"), F.col("of_rate").alias("rate"),
        _copies(F.col("of_high"), F.col("of_low")).alias("copies"), *(["row"] if carry else []),
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy, numbered from 1 in ``copy``."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
