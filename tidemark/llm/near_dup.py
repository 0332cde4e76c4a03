"""Near duplicates by MinHash: fast similarity sketches, banding, exact verification and components.

Sketch.  A document's set of word shingles is thrown into ``BANDS * ROWS`` bins in rounds.  In round i every shingle falls
into a hashed bin with a hashed value above all values of earlier rounds, and a bin keeps its least value; rounds stop once
every bin has one.  The second half of the rounds goes through the bins one by one, so none stays empty.  Two sets agree in a
bin with a probability of their Jaccard similarity, with the concentration of independent bins, at about t log t + n steps.

Candidates.  Documents with equal sets become one node.  Nodes that share a band meet in its bucket, and each is compared
with the bucket's least node.  A bucket whose other nodes are not all of one component afterwards is taken up again, so that
every pair that shares a band is judged or already connected: its nodes are dealt into blocks by their sizes, and for each pair
of blocks of sizes that can be alike a matrix product of 16-bit prints of the shingles bounds all intersections from above.  Only pairs of different components
whose bound reaches the similarity leave the task (they are then compared in full), so families of documents that are alike
but not alike enough cost no rows.  A pair of the least similarity, 0.8, shares no band with a probability of
(1 - 0.8^6)^42, about 3 in a million.

Verification computes both full shingle sets from the texts.  Components come from alternating large-star and small-star
rounds on the links, each round written to the shared folder.  No bucket is ever collected into one task: buckets are
aggregated and joined, and joins with hot keys are Spark's to split.

Nulls: a null text, or one without words, has an empty set (n_shingles 0) and no links; a null id takes no part, gets a null
component and is kept.  Rows that share an id are one document with several sets: all get the component of all their links,
also a row without words.  Repeated texts are one node.  A very long text is sketched whole, in one task.  Empty tables give
empty results.  Other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .runtime import Workspace, partitions, stored, tune

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Bands of the sketch and its bins in each.
BANDS, ROWS = 42, 6
#: Nodes of a block of a bucket that is taken up again.
BLOCK = 512

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def shingles(raw: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of lower-cased words between ASCII blanks."""
    found = raw.lower().split() if raw else []
    if not found:
        return np.zeros(0, _U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, len(found))
    size = min(words, len(found))
    n = len(hashes) - size + 1
    total = np.full(n, 0x9E3779B97F4A7C15 * size & (2**64 - 1), _U)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = mix(total + hashes[i : i + n] + _U(i))
    return np.unique(total)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` values for each non-empty set: hashed bin placement in rounds, for all sets of a batch at once."""
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, _U)
    sizes = np.array([len(s) for s in sets])
    items, owner = (np.concatenate(sets) if len(sets) else np.zeros(0, _U)), np.repeat(np.arange(len(sets)), sizes)
    flat, empty = out.reshape(-1), np.iinfo(np.uint64).max
    for i in range(2 * bins):
        with np.errstate(over="ignore"):
            r = mix(items + _U((i + 1) * 0xD1342543DE82EF95 & (2**64 - 1)))
        place = owner * bins + (((r >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64) if i < bins else owner * bins + (i - bins)
        np.minimum.at(flat, place, (_U(i) << _U(32)) | (r & _U(0xFFFFFFFF)))
        open_ = (out == empty).any(axis=1)
        if not open_[owner].any():
            break
        if i % 4 == 0 or i < 4:  # filled sketches take no part in later rounds: their values could only be larger
            keep = open_[owner]
            items, owner = items[keep], owner[keep]
    return out


def bands(sketch: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), count, rows)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15 >> 8), (len(sketch), count)).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix(key + parts[:, :, i])
    return key.view(np.int64)


def signatures(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, f1, f2, bands, prints): set size, a 128-bit fingerprint of the set, band keys (none for an empty set), and
    the distinct last 16 bits of the shingles' hashes."""

    def sign(batches):
        for batch in batches:
            sets = [shingles(raw, words) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [[]] * len(sets)
            if full:
                for i, row in zip(full, bands(sketches([sets[i] for i in full], BANDS * ROWS), BANDS, ROWS), strict=True):
                    keys[i] = row
            with np.errstate(over="ignore"):
                f1 = [int(s.sum(dtype=_U).view(np.int64)) for s in sets]
                f2 = [int(mix(s + _U(77)).sum(dtype=_U).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array([np.unique(s.astype(np.uint16)).tobytes() for s in sets], pa.binary())], ["id", "n", "f1", "f2", "bands", "prints"],
            )

    kept = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return kept.mapInArrow(sign, "id long, n long, f1 long, f2 long, bands array<long>, prints binary")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked) of the pairs (a, b), each compared on its two full shingle sets."""

    def compare(batches):
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ones, others = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            linked = []
            for i, x in enumerate(a):
                if x != last:
                    last, held = x, shingles(ones[i].as_py(), words)
                other = shingles(others[i].as_py(), words)
                both = len(np.intersect1d(held, other, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a long, b long, linked boolean")


def size_class(n: str, percent: int):
    """Numbers by which sets that may be alike are in the same class or in neighbouring ones."""
    return F.floor(F.log(max(100.0 / percent, 1.01), F.col(n)) + 1e-9).cast("int")


def close_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of one bucket and different components (c) whose similarity may reach ``percent``.

    placed: (bucket, rep, n, c, s, ks, prints): the node's size class and the number of nodes in each class of its bucket.  A
    bucket of up to a block is one cell.  A larger one is dealt out by size classes, and each class and each two neighbouring
    ones as pairs of blocks, so a task holds two blocks at a time and nodes of unlike sizes never meet.
    """
    blocks = lambda s: F.ceil(F.coalesce(F.element_at("ks", s), F.lit(0)) / BLOCK).cast("int")
    s, n, mine = F.col("s"), blocks(F.col("s")), F.col("mine")
    cell = lambda a, b, i, j, side: F.struct(a.alias("a"), b.alias("b"), i.alias("i"), j.alias("j"), side.alias("side"))
    none = F.array().cast("array<struct<a:int,b:int,i:int,j:int,side:int>>")
    each = lambda count, make: F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), make)).otherwise(none)
    own = each(n, lambda o: cell(s, s, F.least(mine, o), F.greatest(mine, o), mine))
    up = each(blocks(s + 1), lambda o: cell(s, s + 1, mine, o, F.lit(0)))
    down = each(blocks(s - 1), lambda o: cell(s - 1, s, o, mine, F.lit(1)))
    zero, all_ = F.lit(0), F.aggregate(F.map_values("ks"), F.lit(0).cast("long"), lambda x, k: x + k)
    cells = F.when(all_ <= BLOCK, F.array(cell(zero, zero, zero, zero, zero))).otherwise(F.concat(own, up, down))
    dealt = placed.withColumn("mine", F.pmod(F.xxhash64("rep"), n).cast("int")).withColumn("x", F.explode(cells))
    dealt = dealt.select("bucket", "x.a", "x.b", "x.i", "x.j", "x.side", "rep", "n", "c", "prints")

    def compare(batches):
        held: list[tuple] = []

        def judged(two_classes: bool):
            side, rep, n, c, prints = (list(x) for x in zip(*held, strict=True))
            side, rep, n, c = np.array(side), np.array(rep, np.int64), np.array(n, np.int64), np.array(c, np.int64)
            if two_classes and (side == side[0]).all():  # the other block is empty, and these meet in a cell of their own
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            grams = [np.frombuffer(p, np.uint16) for p in prints]
            sizes = np.array([len(g) for g in grams])
            values, column, seen = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            keep = seen[column] > 1  # what only one node has is in no intersection
            matrix = np.zeros((len(grams), int((seen > 1).sum())), np.float32)
            matrix[np.repeat(np.arange(len(grams)), sizes)[keep], (np.cumsum(seen > 1) - 1)[column[keep]]] = 1
            rows, others = (np.arange(len(grams)), np.arange(len(grams))) if (side == side[0]).all() else (np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0]))
            # Shingles that share a print with another of their own set are missed at most once each.
            most = matrix[rows] @ matrix[others].T + np.minimum((n - sizes)[rows][:, None], (n - sizes)[others][None, :])
            most = np.minimum(most, np.minimum(n[rows][:, None], n[others][None, :]))
            fits = (100 * most >= percent * (n[rows][:, None] + n[others][None, :] - most)) & (c[rows][:, None] != c[others][None, :])
            x, y = np.nonzero(fits)
            one, two = rep[rows[x]], rep[others[y]]
            pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        last = None
        for batch in batches:
            for key, row in zip(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True), zip(*(batch.column(i).to_pylist() for i in range(5, 10)), strict=True), strict=True):
                if key != last and held:
                    yield judged(last[1] != last[2])
                    held.clear()
                last = key
                held.append(row)
        if held:
            yield judged(last[1] != last[2])

    place = ["bucket", "a", "b", "i", "j"]
    spread = dealt.repartition(partitions(placed.sparkSession), *place).sortWithinPartitions(*place)
    return spread.mapInArrow(compare, "a long, b long")


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node that it is connected with."""
    run = uuid.uuid4().hex
    edges = work.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"links-{run}")
    mark, turn = None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turn, seen = turn + 1, Observation()
        stars = joined.union(small_least.select("u", F.col("m").alias("v"))).distinct()
        stars = stars.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        edges = work.stored(stars, f"stars-{run}-{turn}")
        now = seen.get
        if now == mark:
            break
        mark = now
    least = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return least.union(least.select(F.col("component").alias("node"), "component").distinct())


def _alike(n: str, m: str, percent: int):
    return (F.least(n, m) * 100) >= (F.greatest(n, m) * percent)


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept): a row for each row of ``df``; kept: it has the least id of its component."""
    tune(df.sparkSession)
    work = Workspace(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    if not rows.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
        out = _grouped(rows, work, words, percent).select("id", "n", "component")
    else:
        # Rows go by numbers; rows of one id are linked by their numbers, and the least id of a component is sought at the end.
        numbered = work.stored(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
        known = numbered.where("id is not null")
        first = known.groupBy("id").agg(F.min("number").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        same = work.stored(known.select("id", "number").join(first, "id").select("a", F.col("number").alias("b")), "same")
        found = _grouped(known.select(F.col("number").alias("id"), "text"), work, words, percent, same)
        found = work.stored(known.select("id", "number").join(found.withColumnRenamed("id", "number"), "number"), "numbered_components")
        least = found.groupBy("component").agg(F.min("id").alias("least"))
        out = found.join(least, "component").select("id", "n", F.col("least").alias("component"))
        unknown = signatures(numbered.where("id is null"), "id", "text", words)
        out = out.union(unknown.select("id", "n", F.lit(None).cast("long").alias("component")))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    result = stored(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept), "near_duplicates")
    work.drop()
    return result


def _grouped(texts: DataFrame, work: Workspace, words: int, percent: int, same: DataFrame | None = None) -> DataFrame:
    """(id, n, component) of (id, text), ids distinct but for nulls.  same: (a, b), pairs of ids that are one document, each id
    of such a pair being once in ``b``."""
    signed = work.stored(signatures(texts, "id", "text", words), "signatures")
    sets = signed.where("id is not null and n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    sets = work.stored(sets, "sets")
    texts = texts.where("id is not null and text is not null")

    nodes = signed.select("id", "n", "f1", "f2", "bands").join(sets, ["n", "f1", "f2"]).where("id = rep")
    members = work.stored(nodes.select("rep", "n", "bands"), "nodes").select(F.explode("bands").alias("bucket"), "rep", "n")
    # Aggregates are written before they are joined: Spark can then deal out what one bucket holds.
    buckets = members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = work.stored(buckets, "heads")
    shared = work.stored(members.join(buckets, "bucket").select("bucket", "rep", "n", F.col("head.rep").alias("a"), F.col("head.n").alias("m"), "size"), "buckets")
    pairs = work.stored(shared.where("rep <> a").where(_alike("n", "m", percent)).select("a", F.col("rep").alias("b")).distinct(), "pairs")
    tested = work.stored(verified(pairs, texts, words, percent), "tested")
    links = tested.where("linked").select("a", "b")
    if same is not None:
        own = signed.select("id", "n", "f1", "f2").join(same.select(F.col("b").alias("id")), "id").join(sets, ["n", "f1", "f2"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
        links = links.union(same).union(own)
    found = work.stored(components(links, work), "components")

    # Buckets whose nodes, but for the head that all were compared with, are of several components.
    open_ = shared.where("size > 2 and rep <> a").select("bucket", "rep", "n")
    placed = open_.join(found, open_["rep"] == found["node"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("c"))
    placed = placed.withColumn("s", size_class("n", percent))
    sizes = placed.groupBy("bucket", "s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("s", "k"))).alias("ks")).where("lo < hi")
    placed = work.stored(placed.join(work.stored(mixed.select("bucket", "ks"), "mixed"), "bucket"), "open")
    wanted = work.stored(placed.select(F.col("rep").alias("id")).distinct(), "open_nodes")
    prints = signed.select("id", "prints").join(wanted, "id", "left_semi")
    placed = placed.join(prints.withColumnRenamed("id", "rep"), "rep")
    close = work.stored(close_pairs(placed, percent).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "close")
    again = work.stored(verified(close, texts, words, percent), "tested_again")
    if again.where("linked").limit(1).count():
        found = work.stored(components(links.union(again.where("linked").select("a", "b")), work), "components_again")

    named = sets.join(found, sets["rep"] == found["node"], "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    if same is not None:
        out = out.join(found.select(F.col("node").alias("id"), F.col("component").alias("own")), "id", "left")
        component = F.coalesce(F.col("own"), component)
    return out.select("id", "n", F.when(F.col("id").isNotNull(), component).alias("component"))
