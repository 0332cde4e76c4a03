"""Sharding by jump consistent hashing, in DataFrame functions only.

The hash needs no table of shards: a linear congruential sequence seeded by the key gives the ever larger shard counts at
which the key would move, and the key is in the last of them below the number of shards.  So with one more shard a key stays
or goes into the new one.  The law of the shards is ``key``: the key and the number of shards decide, nothing else.

Slots count the rows of a shard from 0 on.  Rows that are equal in key, size and crc are counted where they are read and
travel as one; the others are dealt into small buckets by a hash of all three.  A prefix sum over the buckets of a shard and
one within a bucket give the slots, so no task ever holds a shard, whatever the keys; equal rows are told apart again at the
end, in chunks of bounded size.

Nulls: a null text has no bytes (crc of the empty string); a null key hashes as key 0.  Repeated rows get slots of their own.
Very long texts only count by their bytes.  Empty tables give empty results.  Other columns are not read, whatever they are
called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published algorithm: the generator's factor, and 2 to the power 31.
FACTOR, SPAN = 2862933555777941757, 2147483648.0
#: Rows of a bucket in which slots are numbered, and of a chunk of equal rows.
BUCKET_ROWS, CHUNK_ROWS = 50_000, 100_000
#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def jumps(key: Column, most: int) -> Column:
    """The shard counts at which the key moves, below ``most``, in order: ``shard(n)`` is the last of them below n.

    key: a long; it seeds the generator as an unsigned 64-bit integer.
    """
    modulus = F.lit(str(1 << 64)).cast("decimal(20,0)")
    seed = F.when(key < 0, key.cast("decimal(20,0)") + modulus).otherwise(key.cast("decimal(20,0)")).cast("decimal(20,0)")
    start = F.struct(F.lit(-1.0).alias("at"), F.lit(0.0).alias("next"), seed.alias("state"), F.array().cast("array<int>").alias("seen"))

    def step(a: Column, _: Column) -> Column:
        state = ((a["state"] * F.lit(FACTOR).cast("decimal(19,0)") + F.lit(1)).cast("decimal(38,0)") % modulus).cast("decimal(20,0)")
        high = F.floor(state / F.lit(1 << 33).cast("decimal(20,0)")).cast("double") + F.lit(1.0)
        moved = F.struct(
            a["next"].alias("at"), F.floor((a["next"] + 1.0) * (F.lit(SPAN) / high)).cast("double").alias("next"), state.alias("state"),
            F.concat(a["seen"], F.array(a["next"].cast("int"))).alias("seen"),
        )
        return F.when(a["next"] < F.lit(float(most)), moved).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda a: a["seen"])


def shard_of(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key."""
    return F.element_at(jumps(key, shards), -1)


def assign(df: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): every row's shard, and the one it has with one shard more."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))
    seed = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    rows = df.select(
        F.col(key).alias("key"), seed.alias("seed"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    rows = rows.withColumn("jumps", jumps(F.col("seed"), shards + 1))
    rows = rows.select(
        "key", "seed", "size", "text_crc32", F.element_at("jumps", -1).alias("grown_shard"),
        F.element_at(F.filter("jumps", lambda j: j < shards), -1).alias("shard"),
    )
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows"))
    buckets = max(1, -(-df.count() // (shards * BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("seed", "size", "text_crc32"), F.lit(buckets)))
    before = rows.groupBy("shard", "bucket").agg(F.sum("rows").alias("all"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("shard", "bucket", F.coalesce(F.sum("all").over(earlier), F.lit(0).cast("long")).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("seed", F.col("key").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("rows").over(inside), F.lit(0).cast("long"))).join(before, ["shard", "bucket"])
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(CHUNK_ROWS).cast("long"))))
    chunks = chunks.repartition("shard", "bucket", "chunk")
    slot = F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + CHUNK_ROWS, F.col("rows")) - 1))
    return chunks.withColumn("own", slot).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("inner") + F.col("own")).alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, shards: int, path: str, *, key: str = "doc_id") -> None:
    """Whole rows as Parquet, a folder ``shard=N`` for each shard; rows of a shard come from many tasks, each its own file."""
    column = "shard" if "shard" not in df.columns else "__shard"
    df.withColumn(column, shard_of(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")), shards)).write.partitionBy(column).parquet(path)

