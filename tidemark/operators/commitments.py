"""Commitments to sets of any size: a hash tree over the sorted members, of which no task or list holds more than a few.

Members are ranked by ranges of their order, and a node is the hash of up to ``FAN`` neighbours of the level below; so the tree
depends on the set alone, not on partitions, order of arrival or repeated rows.  A level is one aggregation of a sixteenth of
the rows of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.store import held

#: Children of a node.
FAN = 16


def _hash(mark: str, text: Column) -> Column:
    """A hash of its own for leaves and for nodes, so that neither can stand for the other."""
    return F.sha2(F.concat(F.lit(mark), text).cast("binary"), 256)


def ranked(df: DataFrame, by: list[str], member: str) -> DataFrame:
    """(by, member, rank): the distinct members of each group in order, from 0 on.

    Ranges of (group, member) are numbered on their own; a group's ranks go on from what the ranges before hold of it, a row
    for each range and group.  Null members do not count.
    """
    rows = df.where(F.col(member).isNotNull()).select(*by, F.col(member).alias("member")).distinct()
    order = [*[F.col(b).asc_nulls_first() for b in by], F.col("member")]
    dealt = held(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "range").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("range").alias("__range"), (F.sum("n").over(Window.partitionBy(*by).orderBy("range")) - F.col("n")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy(*by, "range").orderBy("member"))
    same = F.col("range") == F.col("__range")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return dealt.withColumn("inside", inside).join(ahead, same).select(*by, "member", (F.col("ahead") + F.col("inside") - 1).cast("long").alias("rank"))


def tree(df: DataFrame, by: list[str], member: str) -> list[DataFrame]:
    """The levels (by, node, hash) of each group's tree, written, the leaves first; a leaf has its member too.

    A group's last level is the one with a single node; smaller groups stop earlier, and their node is carried on as it is.
    """
    level = held(ranked(df, by, member).select(*by, F.col("rank").alias("node"), _hash("leaf:", F.col("member")).alias("hash"), "member"))
    found = [level]
    while level.where("node > 0").limit(1).count():
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"])  # FAN at most
        up = level.groupBy(*by, F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(children.alias("c"))
        single = (F.col("up") == 0) & (F.size("c") == 1)  # nodes are numbered from 0 without gaps
        level = held(up.select(*by, F.col("up").alias("node"), F.when(single, F.element_at("c", 1)).otherwise(_hash("node:", F.array_join("c", ""))).alias("hash")))
        found.append(level)
    return found


def roots(levels: list[DataFrame], by: list[str]) -> DataFrame:
    """(by, n, root): how many members a group has, and what stands for all of them."""
    counts = levels[0].groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    top = levels[-1].select(*[F.col(b).alias(f"__{b}") for b in by], "hash")
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return counts.join(top, same).select(*by, "n", scalars.receipt(scalars.stable_json(n=F.col("n"), root=F.col("hash"))).alias("root"))


def paths(levels: list[DataFrame], by: list[str], asked: DataFrame) -> DataFrame:
    """(by, member, path): for each asked (by, member) that is in a set, what proves it: a level after the other the hashes of
    the siblings, and which of them its own is.  A level where a group has a single node says nothing."""
    on = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    names = [F.col(f"a.{b}") for b in by]
    rows = asked.alias("a").join(levels[0].alias("l"), [*on("a", "l"), F.col("a.member") == F.col("l.member")]).select(*names, "a.member", "l.node", F.array().cast("array<struct<at:long,hashes:array<string>>>").alias("path"))
    for level in levels[:-1]:
        siblings = level.withColumn("up", F.floor(F.col("node") / FAN).cast("long")).groupBy(*by, "up").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"]).alias("hashes"))
        rows = rows.withColumn("up", F.floor(F.col("node") / FAN).cast("long")).alias("a").join(siblings.alias("s"), [*on("a", "s"), F.col("a.up") == F.col("s.up")])
        step = F.struct((F.col("a.node") % FAN).alias("at"), F.col("s.hashes").alias("hashes"))
        rows = rows.select(*names, "a.member", F.col("a.up").alias("node"), F.when((F.col("s.up") > 0) | (F.size("s.hashes") > 1), F.concat("a.path", F.array(step))).otherwise(F.col("a.path")).alias("path"))
    return rows.select(*by, "member", "path")


def proven(member: Column, path: Column, n: Column, root: Column) -> Column:
    """Whether a path leads from a member to the root: no table is needed."""
    own = F.aggregate(path, _hash("leaf:", member), lambda h, s: F.when(F.element_at(s["hashes"], (s["at"] + 1).cast("int")) == h, _hash("node:", F.array_join(s["hashes"], ""))))
    return F.coalesce(scalars.receipt(scalars.stable_json(n=n, root=own)) == root, F.lit(False))
