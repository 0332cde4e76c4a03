"""The prefix trie of conversations: which conversations begin alike, how far, and what one encoding of a shared turn saves.

A node is a distinct sequence of first turns; it belongs to the least conversation that begins with it.  A conversation that
is the least of a prefix is the least of every longer prefix of its own too, so what it owns is one chain, from a first depth
down to its end.

Digests.  A turn becomes two longs where it is read; no text is shuffled.  The digest of a prefix is the sum of hashes of its
turns with their depths, so it needs no order of evaluation: sums run inside blocks of ``BLOCK`` depths and blocks add up, and a
conversation of any length is dealt over many tasks.  Two prefixes count as equal if 126 bits of their digests are.

First owned depth.  One aggregation has the least conversation of each (depth, digest).  Each conversation then searches its
first owned depth by halving.  A round is two steps of that: it joins the middle depth and the middles of both halves with the
minima, and keeps only the rows that can still matter, a quarter of them, so all rounds together shuffle little more than the
prefixes.  The last depth that was not its own names its parent.

Chains form a tree, a row for each.  Levels come from pointer doubling; from the deepest level up, each chain's totals go to
its parent.  What a subtree saves is linear in the counts below it, so chains need no rows of their nodes for that; the nodes
themselves get theirs at the end, from the totals of their chain less what lies above them.

The list of the conversations that end at a node is hashed in order: sorted ranges make texts of up to ``BLOCK`` ids, which
then stream through the hash, so copies by the million need no list in memory.

Nulls: a null turn number comes first; a null role or text is the empty one; rows without a conversation id belong to none and
are left out.  Turns that tie are ordered by role, by the first ``TIE_CHARS`` code points of the text, then by their digests;
rows that repeat are turns of their own.  An empty table has no
conversation and no node.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Workspace, partitions

#: Depths of a block of running sums; ids of a text that is hashed at once.
BLOCK = 4096
#: Code points of a text by which turns of one number are ordered before their digests decide.
TIE_CHARS = 32


def running(df: DataFrame, key: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """``df`` with running totals of whole numbers by ``key`` up to each row; ``order`` counts from 0 or 1 without gaps.

    Totals run inside blocks of ``BLOCK``; the last row of each block passes its block's total on.
    """
    block = F.floor(F.col(order) / BLOCK).cast("long")
    inside = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = df.withColumn("__block", block).withColumns({name: F.sum(value).over(inside) for name, value in sums.items()})
    full = found.where(F.col(order) % BLOCK == BLOCK - 1)
    earlier = Window.partitionBy(key).orderBy("__block")
    base = full.select(F.col(key).alias("__key"), (F.col("__block") + 1).alias("__next"), *[F.sum(name).over(earlier).alias(f"__{name}") for name in sums])
    found = found.join(base, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__next")), "left")
    return found.withColumns({name: F.col(name) + F.coalesce(F.col(f"__{name}"), F.lit(0)) for name in sums}).drop("__block", "__key", "__next", *[f"__{name}" for name in sums])


def compact(df: DataFrame, space: Workspace, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, high, low, chars): the turns in order, depths from 1, texts as digests and code points.

    Ranges of (conversation, turn) are numbered on their own.  Of the conversations in a range only the first and the last can
    go beyond it, so the numbers to add are at most two rows a range.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary"))
    half = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 17)]
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), half[0].alias("high"), half[1].alias("low"), F.length(what).cast("long").alias("chars"),
        who.alias("role"), F.substring(what, 1, TIE_CHARS).alias("begins"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("begins"), F.col("high"), F.col("low")]
    dealt = rows.repartitionByRange(partitions(df.sparkSession), F.col("conv"), *order).withColumn("part", F.spark_partition_id())
    dealt = space.stored(dealt, "dealt")
    counts = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("conv").orderBy("part")
    ahead = counts.select("conv", "part", (F.sum("n").over(by_part) - F.col("n")).alias("ahead")).where("ahead > 0")
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    found = numbered.join(F.broadcast(ahead), ["conv", "part"], "left")
    return found.select("conv", (F.col("place") + F.coalesce(F.col("ahead"), F.lit(0))).cast("long").alias("depth"), "high", "low", "chars")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, turns) of compact turns: the conversations and their number of turns."""
    return turns.groupBy("conv").agg(F.max("depth").alias("turns"))


def crossed(turns: DataFrame, convs: DataFrame, *, block: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) in which each conversation c has taken over the first h turns of c - c % block, in place of its own first
    h, h being crc32(c) % (most + 1).  Where the other has fewer turns all of them come, and what follows moves up; where there
    is none, nothing comes.  Heads are joined as digests, each to the conversations of one block only."""
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most + 1)).cast("long")
    of = (F.col("conv") - F.col("conv") % block).cast("long")
    bases = convs.where(F.col("conv") % block == 0).select(F.col("conv").alias("base"), F.least(F.col("turns"), F.lit(most)).alias("base_turns"))
    plan = convs.withColumns({"head": head, "base": of}).join(bases, "base", "left")
    plan = plan.withColumn("taken", F.least(F.col("head"), F.coalesce(F.col("base_turns"), F.lit(0))).cast("long"))
    plan = plan.withColumn("length", F.col("taken") + F.greatest(F.col("turns") - F.col("head"), F.lit(0)))
    own = turns.join(plan.select("conv", "head", "taken"), "conv").where("depth > head").select("conv", (F.col("depth") - F.col("head") + F.col("taken")).alias("depth"), "high", "low", "chars")
    heads = turns.where((F.col("conv") % block == 0) & (F.col("depth") <= most)).withColumnRenamed("conv", "base")
    heads = plan.where("taken > 0").select("conv", "base", "taken").join(heads, "base").where("depth <= taken").select("conv", "depth", "high", "low", "chars")
    return own.unionByName(heads), plan.select("conv", F.col("length").alias("turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, high, low, chars, all_chars): the digest of each prefix, and the code points of its turns together."""
    placed = {"high": F.xxhash64("depth", "high", "low"), "low": F.xxhash64("low", "depth", "high")}
    wide = {name: value.cast("decimal(20,0)") for name, value in placed.items()}
    found = running(turns.withColumns({f"own_{n}": v for n, v in wide.items()}), "conv", "depth", {"sum_high": F.col("own_high"), "sum_low": F.col("own_low"), "all_chars": F.col("chars")})
    short = {name: F.pmod(F.col(f"sum_{name}"), F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("long") for name in placed}
    return found.select("conv", "depth", short["high"].alias("high"), short["low"].alias("low"), "chars", "all_chars")


def first_owned(rows: DataFrame, convs: DataFrame, space: Workspace) -> DataFrame:
    """(conv, above, parent, top_chars): the greatest depth whose prefix another conversation owns, with that owner and the
    code points down to it; conversations that own all their turns are left out.  Depth 0 is not looked at."""
    minima = space.stored(rows.groupBy("depth", "high", "low").agg(F.min("conv").alias("least")), "minima")
    longest = convs.agg(F.max("turns")).first()[0] or 0
    live = rows.drop("chars").join(convs, "conv").select("*", F.lit(1).cast("long").alias("lo"), (F.col("turns") + 1).alias("hi")).drop("turns")
    half = lambda a, b: F.floor((a + b) / 2).cast("long")
    middle = half(F.col("lo"), F.col("hi"))
    asked_at = F.col("depth").isin(middle, half(F.col("lo"), middle), half(middle + 1, F.col("hi")))
    found, last, rounds = [], None, -(-longest.bit_length() // 2)
    for k in range(rounds):
        asked = live.where(asked_at).join(minima, ["depth", "high", "low"])
        asked = space.stored(asked.select("conv", "lo", "hi", F.col("depth").alias("at"), "least", "all_chars"), f"asked{k}")
        owns = F.col("least") == F.col("conv")
        found.append(asked.where(~owns).select("conv", F.struct("at", "least", "all_chars").alias("miss")))
        if k + 1 < rounds:
            told = asked.groupBy("conv").agg(F.max(F.when(owns, F.col("lo")).otherwise(F.col("at") + 1)).alias("lo"), F.min(F.when(owns, F.col("at")).otherwise(F.col("hi"))).alias("hi")).where("lo < hi")
            live = space.stored(live.drop("lo", "hi").join(told, "conv").where("depth >= lo AND depth < hi"), f"live{k}")
            if last:
                space.drop(last)
            last = f"live{k}"
    if last:
        space.drop(last)
    if not found:
        return convs.select("conv", F.lit(0).cast("long").alias("above"), F.col("conv").alias("parent"), F.lit(0).cast("long").alias("top_chars")).where("false")
    misses = found[0]
    for more in found[1:]:
        misses = misses.unionByName(more)
    return misses.groupBy("conv").agg(F.max("miss").alias("miss")).select("conv", F.col("miss.at").alias("above"), F.col("miss.least").alias("parent"), F.col("miss.all_chars").alias("top_chars"))


def levels(chains: DataFrame, root: int, space: Workspace) -> tuple[DataFrame, int]:
    """(chains with their level, the deepest level): the root's chain has 0.  Doubling: each round looks twice as far up."""
    known = space.stored(chains.select("conv", F.coalesce("parent", "conv").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("level")), "up0")
    for k in range(1, 64):
        open_ = known.where(F.col("up") != root)
        if open_.isEmpty():
            break
        above = known.select(F.col("conv").alias("up"), F.col("up").alias("upper"), F.col("level").alias("more"))
        stepped = open_.join(above, "up").select("conv", F.col("upper").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        known = space.stored(known.where(F.col("up") == root).unionByName(stepped), f"up{k}")
        space.drop(f"up{k - 1}")
    deepest = known.agg(F.max("level")).first()[0] or 0
    return chains.join(known.select("conv", "level"), "conv"), deepest


def end_lists(ends: DataFrame) -> DataFrame:
    """(owner, at, n, sha): of each node's conversations that end there, the number and the hash of their ids in order."""
    keys = ["owner", "at"]
    dealt = ends.repartitionByRange(partitions(ends.sparkSession), *keys, "conv").sortWithinPartitions(*keys, "conv")

    def texts(batches):
        """Runs of one node's ids as texts of up to BLOCK ids, and the first id of each."""
        node, ids = None, []
        for batch in batches:
            out = []
            for owner, at, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (owner, at) != node or len(ids) >= BLOCK:
                    if ids:
                        out.append((*node, ids[0], len(ids), ",".join(map(str, ids))))
                    node, ids = (owner, at), []
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, ids[0], len(ids), ",".join(map(str, ids))), kinds, strict=True)], names)

    names, kinds = ["owner", "at", "first", "n", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    runs = dealt.select(*keys, "conv").mapInArrow(texts, "owner long, at long, first long, n long, ids string")

    def hashed(batches):
        node, held, n = None, None, 0
        for batch in batches:
            out = []
            for owner, at, _, more, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (owner, at) != node:
                    if held:
                        out.append((*node, n, held.hexdigest()))
                    node, held, n = (owner, at), hashlib.sha256(), 0
                held.update((("," if n else "") + ids).encode())
                n += more
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), done, strict=True)], ["owner", "at", "n", "sha"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, n, held.hexdigest()), done, strict=True)], ["owner", "at", "n", "sha"])

    done = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return runs.repartition(partitions(ends.sparkSession), *keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, "owner long, at long, n long, sha string")


def trie(turns: DataFrame, convs: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    turns: (conv, depth, high, low, chars) as ``compact`` gives them; convs: (conv, turns), conversations without turns
    included.  A node is named by the least conversation that begins with it and its depth, so its last turn is that
    conversation's turn of that depth.
    """
    convs = space.stored(convs, "convs")
    rows = space.stored(prefixes(turns), "prefixes")
    root = convs.agg(F.min("conv")).first()[0]
    nothing = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if root is None:
        return turns.sparkSession.createDataFrame([], nothing)
    misses = first_owned(rows, convs, space)
    whole = rows.join(convs, "conv").where("depth = turns").select("conv", "all_chars")
    known = convs.join(misses, "conv", "left").join(whole, "conv", "left").fillna(0, ["all_chars"])
    is_root = F.col("conv") == root
    known = known.select(
        "conv", "turns", "all_chars", F.when(is_root, -1).otherwise(F.coalesce("above", F.lit(0))).cast("long").alias("above"),
        F.when(~is_root, F.coalesce("parent", F.lit(root))).alias("parent"), F.coalesce("top_chars", F.lit(0)).alias("top_chars"),
    )
    known = space.stored(known, "known")
    owner = F.when(F.col("turns") > F.col("above"), F.col("conv")).otherwise(F.col("parent"))
    ends = known.select(owner.alias("owner"), F.col("turns").alias("at"), "conv", "all_chars")
    lists = space.stored(end_lists(ends), "ends")
    chains, deepest = levels(known.where("turns > above"), root, space)
    own_ends = ends.groupBy("owner").agg(F.count(F.lit(1)).alias("ended"), F.sum("all_chars").alias("ended_chars"))
    chains = chains.join(own_ends.withColumnRenamed("owner", "conv"), "conv", "left").fillna(0, ["ended", "ended_chars"])
    chains = space.stored(chains, "chains")

    # From the deepest level up: the totals of a chain are its own ends and its children's totals.
    totals, below = [], None
    for k in range(deepest, -1, -1):
        level = chains.where(F.col("level") == k)
        sums = {"c_convs": F.lit(0), "c_leaves": F.lit(0), "c_saved": F.lit(0), "c_chars": F.lit(0), "c_last": F.lit(-1)}
        if below is None:
            level = level.withColumns({n: v.cast("long") for n, v in sums.items()})
        else:
            children = below.groupBy(F.col("parent").alias("conv")).agg(
                F.sum("n_convs").alias("c_convs"), F.sum("n_leaves").alias("c_leaves"), F.sum("saved").alias("c_saved"),
                F.sum(F.col("n_convs") * F.col("top_chars")).alias("c_chars"), F.max("above").alias("c_last"),
            )
            level = level.join(children, "conv", "left").fillna(0, ["c_convs", "c_leaves", "c_saved", "c_chars"]).fillna(-1, ["c_last"])
        n_convs = F.col("ended") + F.col("c_convs")
        saved = F.col("c_saved") + F.col("ended_chars") + F.col("c_chars") - n_convs * F.col("top_chars") - (F.col("all_chars") - F.col("top_chars"))
        leaves = F.col("c_leaves") + F.when(F.col("c_last") == F.col("turns"), 0).otherwise(1)
        below = space.stored(level.select("conv", "parent", "above", "turns", "top_chars", n_convs.alias("n_convs"), leaves.alias("n_leaves"), saved.alias("saved")), f"totals{k}")
        totals.append(below)
    every = totals[0]
    for more in totals[1:]:
        every = every.unionByName(more)

    # The nodes of a chain: its totals less what its nodes above have of their own.
    hung = every.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv"), F.col("above").alias("depth")).agg(
        F.sum("n_convs").alias("h_convs"), F.sum("n_leaves").alias("h_leaves"), F.sum("saved").alias("h_saved"), F.count(F.lit(1)).alias("h_chains")
    )
    chain = every.select("conv", "parent", "above", "turns", "n_convs", "n_leaves", "saved")
    nodes = rows.select("conv", "depth", "chars").join(chain, "conv").where("depth > above")
    nodes = nodes.unionByName(chain.where(is_root).withColumns({"depth": F.lit(0).cast("long"), "chars": F.lit(0).cast("long")}))
    nodes = nodes.join(hung, ["conv", "depth"], "left").join(lists.select(F.col("owner").alias("conv"), F.col("at").alias("depth"), "n", "sha"), ["conv", "depth"], "left")
    nodes = nodes.fillna(0, ["h_convs", "h_leaves", "h_saved", "h_chains", "n"])
    here = {"s_convs": F.col("h_convs") + F.col("n"), "s_leaves": F.col("h_leaves")}
    nodes = running(nodes.withColumn("place", F.col("depth")), "conv", "place", here)
    convs_from = F.col("n_convs") - F.col("s_convs") + F.col("h_convs") + F.col("n")
    nodes = nodes.withColumns({"from_convs": convs_from, "from_leaves": F.col("n_leaves") - F.col("s_leaves") + F.col("h_leaves")})
    term = (F.col("from_convs") - 1) * F.col("chars") + F.col("h_saved")
    nodes = running(nodes, "conv", "place", {"s_saved": term})
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("above") + 1, F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("from_convs").alias("n_convs"), (F.col("h_chains") + F.when(F.col("depth") < F.col("turns"), 1).otherwise(0)).cast("long").alias("n_children"),
        F.col("from_leaves").alias("n_leaves"), (F.col("saved") - F.col("s_saved") + term).cast("long").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
