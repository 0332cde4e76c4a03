"""Structure over actor and target edges: concentration, cohorts, synchronisation, what precedes a transition.

Edges are (us, actor, collection, target).  Nothing here narrows or samples: cohorts are found by a join on shared targets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, stats
from ..sources.store import held

H_THRESHOLD, JACCARD, MIN_TARGETS, MIN_COHORT = 0.15, 0.5, 3, 3
#: Sets of at most so many targets travel whole to where they are compared; the words of bits that tell most of them apart.
WHOLE, OUTLINE = 256, ["o0", "o1", "o2", "o3"]
#: Rows of one target that meet as one block, and actors of equal sets that travel together.
BLOCK, TOGETHER = 4096, 256
#: Cells in which a first part of the links is looked for, where groups are far larger: all further ones are between what these join.
CELLS = (64, 4096)


def concentration(edges: DataFrame, by: list[str]) -> DataFrame:
    """Events, actors, targets and their concentration in each group."""
    a = stats.herfindahl(edges, by, "actor").withColumnsRenamed({"n": "n_actors", "herfindahl": "actor_herfindahl", "events": "n_events"})
    t = stats.herfindahl(edges.where("target is not null and target <> ''"), by, "target").drop("events").withColumnsRenamed({"n": "n_targets", "herfindahl": "target_herfindahl"})
    out = a.join(t, by, "left")
    return out.withColumns({"effective_actors": F.try_divide(F.lit(1.0), F.col("actor_herfindahl")), "score": scalars.magnitude(F.col("actor_herfindahl") * F.col("n_events"))})


def concentrated(measured: DataFrame, by: list[str], threshold: float = H_THRESHOLD, least: int = 20) -> DataFrame:
    """Findings: groups whose actors or targets are concentrated beyond the threshold."""
    kinds = F.array(
        F.struct(F.lit("actor_concentration").alias("type"), F.col("actor_herfindahl").alias("h"), F.col("n_actors").alias("n")),
        F.struct(F.lit("target_concentration").alias("type"), F.col("target_herfindahl").alias("h"), F.col("n_targets").alias("n")),
    )
    rows = measured.where(F.col("n_events") >= least).select(*by, "n_events", F.explode(kinds).alias("f")).select(*by, "n_events", "f.*")
    return rows.where((F.col("h") >= threshold) & (F.col("n") > 0)).withColumn("score", scalars.magnitude(F.col("h") * F.col("n_events")))


def target_sets(edges: DataFrame, by: list[str], least: int = MIN_TARGETS) -> DataFrame:
    """(by, actor, target, size): distinct targets of the actors that have at least ``least``."""
    pairs = edges.where("target is not null and target <> ''").select(*by, "actor", "target").distinct()
    sizes = pairs.groupBy(*by, "actor").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return pairs.hint("merge").join(sizes, [*by, "actor"])


def classes_of(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by, rep, actor, n): for each actor the least one that has the same targets, and how many have them.

    Sets count as equal if their sizes and 128 bits of sums of their targets' hashes are.
    """
    parts = [F.sum(F.xxhash64(F.lit(k), F.col("target").cast("string")).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)]
    content = held(sets.groupBy(*by, "actor").agg(F.count(F.lit(1)).alias("size"), *parts))
    keys = [*by, "size", "h0", "h1"]
    return content.join(content.groupBy(*keys).agg(F.min("actor").alias("rep"), F.count(F.lit(1)).alias("n")), keys).select(*by, "rep", "actor", "n")


def classed(sets: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes of equal sets, the sets of their representatives), each written once."""
    classes = held(classes_of(sets, by))
    return classes, held(sets.hint("merge").join(classes.where("actor = rep").select(*by, "actor"), [*by, "actor"]))


def similar_classes(sets: DataFrame, by: list[str], threshold: float = JACCARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes of equal sets, the sets of their representatives, similar pairs of representatives)."""
    classes, own = classed(sets, by)
    return classes, own, distinct_pairs(own, by, threshold)


def similar_pairs(sets: DataFrame, by: list[str], threshold: float = JACCARD) -> DataFrame:
    """(by, a, b, jaccard) of actors whose target sets are alike: found between classes of equal sets, then told of every actor.

    The actors of a class travel with its set, some at a time, so that no pair is written or shuffled.
    """
    classes, own = classed(sets, by)
    n = _tasks(sets.sparkSession)
    dealt = classes.withColumn("deal", F.pmod(F.xxhash64("actor"), F.ceil(F.col("n") / F.lit(TOGETHER))))
    parts = dealt.groupBy(*by, "rep", "deal").agg(F.min("actor").alias("actor"), F.collect_list("actor").alias("members"))
    rows = outlines(own, by).withColumnRenamed("actor", "rep").hint("merge").join(parts.drop("deal"), [*by, "rep"])
    found = alike(rows, by, threshold, ["rep", "members"], F.col("rep_x") != F.col("rep_y"))
    pairs = found.select(*by, F.explode("members_x").alias("x"), "members_y", "jaccard").select(*by, "x", F.explode("members_y").alias("y"), "jaccard")
    # The rows of a join are many more than go into it, so its partitions are not to be drawn together by what they read.
    of = lambda rep, name, least: classes.where(F.col("n") > least).select(*by, F.col("rep").alias(rep), F.col("actor").alias(name)).repartition(n, *by, rep)
    if has_large(own):
        large = large_pairs(own, by, threshold).withColumnsRenamed({"a": "p", "b": "q"})
        pairs = pairs.unionByName(large.join(of("p", "x", 0).hint("merge"), [*by, "p"]).repartition(n, *by, "q").join(of("q", "y", 0).hint("merge"), [*by, "q"]).select(*by, "x", "y", "jaccard"))
    same = of("p", "x", 1).join(of("p", "y", 1).hint("merge"), [*by, "p"]).where("x < y").withColumn("jaccard", F.lit(1.0))
    least, most = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    return pairs.select(*by, least, most, "jaccard").union(same.where(F.lit(1.0 >= threshold)).select(*by, least, most, "jaccard"))


def distinct_pairs(sets: DataFrame, by: list[str], threshold: float = JACCARD) -> DataFrame:
    """(by, a, b, jaccard) of actors whose target sets are alike, where few or no sets are equal."""
    pairs = alike(outlines(sets, by), by, threshold, []).select(*by, F.least("actor_x", "actor_y").alias("a"), F.greatest("actor_x", "actor_y").alias("b"), "jaccard")
    return pairs.unionByName(large_pairs(sets, by, threshold)) if has_large(sets) else pairs


def _tasks(spark) -> int:
    """Tasks of a join that makes many more rows than it reads."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def has_large(sets: DataFrame) -> bool:
    return bool(sets.where(F.col("size") > WHOLE).limit(1).count())


def outlines(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by, actor, size, targets, exact, o0 …) of sets of at most ``WHOLE`` targets: these as (number, bit), the rarest first, and
    an outline in which each target sets its bit.

    Two sets differ in as many targets as their outlines do in bits, or more.  Where a group has no more targets than an
    outline has bits, each has its own, in the order of rarity: then outlines are ``exact``.
    """
    sets, bits = sets.where(F.col("size") <= WHOLE), 64 * len(OUTLINE)
    rarity = held(sets.groupBy(*by, "target").agg(F.count(F.lit(1)).alias("df")).withColumn("number", F.monotonically_increasing_id()))
    few = rarity.groupBy(*by).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= bits).drop("k")
    own = rarity.join(few, by).withColumns({"bit": F.row_number().over(Window.partitionBy(*by).orderBy("df", "number")) - 1, "exact": F.lit(True)})
    hashed = rarity.join(few, by, "left_anti").withColumns({"bit": F.pmod(F.xxhash64("number"), F.lit(bits)).cast("int"), "exact": F.lit(False)})
    known = own.unionByName(hashed).select(*by, "target", "exact", F.struct("df", "number", "bit").alias("t"), *[_word("bit", k).alias(o) for k, o in enumerate(OUTLINE)])
    found = sets.join(known, [*by, "target"]).groupBy(*by, "actor", "size", "exact").agg(F.sort_array(F.collect_list("t")).alias("t"), *[F.bit_or(o).alias(o) for o in OUTLINE])
    return found.select(*by, "actor", "size", F.transform("t", lambda t: F.struct(t.number.alias("number"), t.bit.alias("bit"))).alias("targets"), "exact", *OUTLINE)


def _word(bit: str, k: int):
    """One bit in the outline's word ``k``."""
    return F.expr(f"CASE WHEN {bit} div 64 = {k} THEN shiftleft(1L, {bit} % 64) ELSE 0L END")


def _below(bit: str, k: int):
    """The bits of the outline's word ``k`` that come before one."""
    return F.expr(f"CASE WHEN {bit} div 64 > {k} THEN -1L WHEN {bit} div 64 = {k} THEN ~shiftleft(-1L, {bit} % 64) ELSE 0L END")


def prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` of ``outlines`` for each of an actor's rarest targets that a similar actor can share first: (number, bit, place, class).

    With |A| targets, a partner at the threshold shares one of the ``|A| - ceil(threshold |A|) + 1`` rarest.  Sizes of a class
    are within 1 / threshold of each other, so a partner is of the same class or a neighbour.
    """
    step = max(1.0 / threshold, 1.0 + 1e-6)
    # A half keeps rounding away from the ends of a class.
    kind = F.floor(F.log(F.col("size") + F.lit(0.5)) / math.log(step)).alias("class")
    first = F.slice("targets", 1, (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).cast("int"))
    return rows.select("*", kind, F.posexplode(first).alias("place", "first")).select("*", "first.*").drop("first")


def alike(rows: DataFrame, by: list[str], threshold: float, told: list[str], only=None, near: int | None = None) -> DataFrame:
    """(by, actor_x, size_x, told_x …, actor_y, size_y, told_y …, jaccard): the similar pairs of ``rows``, as ``outlines`` gives them
    with the columns ``told``, each pair once.

    Actors meet at the targets that ``prefixes`` gives, by blocks of at most some ``BLOCK`` rows, so that a target that very many
    actors have is dealt over many tasks; they are decided on where they meet, by their outlines and then by their sets, and
    a pair counts at the first target that it shares.  No candidate is written, shuffled or told twice.
    only: a condition on both sides that is asked first.  near: only some pairs, those that meet within cells of about so many rows.
    """
    key = ["number", "class"]
    met = prefixes(rows, threshold)
    sizes = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    if near:
        deal = F.pmod(F.xxhash64("actor", "number"), F.ceil(F.col("n") / F.lit(near)))
        left = right = met.join(sizes, key).select("*", F.struct(F.col("class").alias("at"), F.lit(0).alias("kind"), deal.alias("p"), deal.alias("q")).alias("cell"))
    else:
        crowded = sizes.where(F.col("n") > BLOCK).withColumn("parts", F.ceil(F.col("n") / F.lit(BLOCK)))
        moved = [F.struct((F.col("class") + F.lit(d)).alias("class"), *[F.when(F.lit(c == name), F.col("parts")).alias(c) for c in ("own", "next", "last")]) for name, d in (("own", 0), ("next", -1), ("last", 1))]
        crowded = crowded.select("number", F.explode(F.array(*moved)).alias("m")).groupBy("number", F.col("m.class").alias("class")).agg(*[F.max(f"m.{c}").alias(c) for c in ("own", "next", "last")])
        one = F.lit(1).cast("long")
        met = met.join(F.broadcast(crowded), key, "left").withColumns({c: F.coalesce(c, one) for c in ("own", "next", "last")})  # at most three rows for each BLOCK
        met = met.withColumn("part", F.pmod(F.xxhash64("actor"), F.col("own")))
        zero = F.lit(0).cast("long")
        cells = lambda first, end, kind, at, of: F.transform(F.sequence(first, end), lambda k: F.struct(at.alias("at"), F.lit(kind).alias("kind"), *[(F.col("part") if c == of else k).alias(c) for c in ("p", "q")]))
        at = F.col("class")
        left = met.select("*", F.explode(F.concat(cells(F.col("part"), F.col("own") - 1, 0, at, "p"), cells(zero, F.col("next") - 1, 1, at, "p"))).alias("cell"))
        right = met.select("*", F.explode(F.concat(cells(zero, F.col("part"), 0, at, "q"), cells(zero, F.col("last") - 1, 1, at - 1, "q"))).alias("cell"))
    share = threshold / (1.0 + threshold)
    worked = {"rest": F.col("size") - F.col("place"), "whole": F.when(~F.col("exact"), F.col("targets.number"))}
    # What a set has before the target where it is met; unknown where bits are shared.
    ahead = {f"before{k}": F.when(F.col("exact"), F.col(o).bitwiseAND(_below("bit", k))).otherwise(0) for k, o in enumerate(OUTLINE)}
    cell, more, n = ["number", "at", "kind", "p", "q"], ["actor", "size", *OUTLINE, *told], _tasks(rows.sparkSession)

    def side(df: DataFrame, end: str, columns: dict, *also: str) -> DataFrame:
        got = df.select(*also, "number", "cell.*", *more, *[c.alias(name) for name, c in columns.items()])
        return got.withColumnsRenamed({c: f"{c}_{end}" for c in (*more, *worked)}).repartition(n, *cell)

    # A pair shares at most what is left behind the target it meets at, and differs at least as its outlines do.
    differ, seen = F.lit(0), F.lit(0).cast("long")
    for k, o in enumerate(OUTLINE):
        differ = differ + F.bit_count(F.col(f"{o}_x").bitwiseXOR(F.col(f"{o}_y")))
        seen = seen.bitwiseOR(F.col(f"before{k}").bitwiseAND(F.col(f"{o}_y")))
    sizes = F.col("size_x") + F.col("size_y")
    fits = (differ <= sizes * (1.0 - 2.0 * share) + 1e-9) & (seen == 0) & (F.least("rest_x", "rest_y") >= sizes * share - 1e-9)
    once = (F.col("kind") == 1) | (F.col("p") < F.col("q")) | (F.col("actor_x") < F.col("actor_y"))
    both = side(left, "x", worked | ahead, *by, "exact").hint("merge").join(side(right, "y", worked), cell).where((once & fits) if only is None else (once & only & fits))
    keep = [f"{c}_{end}" for end in "xy" for c in ("actor", "size", *told)]
    # Exploded, what both share is worked out once.
    shared = both.select(*by, *keep, "number", "exact", differ.alias("differ"), F.explode(F.array(F.array_intersect("whole_x", "whole_y"))).alias("shared"))
    count = F.when(F.col("exact"), F.expr("(size_x + size_y - differ) div 2")).otherwise(F.size("shared"))
    shared = shared.where(F.col("exact") | (F.get("shared", F.lit(0)) == F.col("number"))).withColumn("both", count)
    jaccard = F.col("both") / (F.col("size_x") + F.col("size_y") - F.col("both"))
    return shared.withColumn("jaccard", jaccard).where(F.col("jaccard") >= threshold).select(*by, *keep, "jaccard")


def large_pairs(sets: DataFrame, by: list[str], threshold: float = JACCARD) -> DataFrame:
    """(by, a, b, jaccard) of similar actors one of which has more than ``WHOLE`` targets.

    Only the rarest targets of an actor can be the ones that a similar actor shares first.  Candidates come from a join on those
    and on classes of set sizes, a set meeting only those of its own class and the next larger one.  A candidate whose places of
    the shared target leave too little behind them goes at once; the others are counted on full sets, which are too large to
    travel with each of their targets.
    """
    sets = sets.where(F.col("size") >= F.lit(threshold * WHOLE))
    rarity = sets.groupBy(*by, "target").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(*by, "actor").orderBy("df", "target")
    ranked = sets.join(rarity, [*by, "target"]).withColumn("rank", F.row_number().over(order))
    prefix = ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1)
    # Sizes of a class are within 1 / threshold of each other; a half keeps rounding away from its ends.
    step = max(1.0 / threshold, 1.0 + 1e-6)
    prefix = prefix.select(*by, "target", "actor", "size", "rank", F.floor(F.log(F.col("size") + F.lit(0.5)) / math.log(step)).alias("class"))
    small = prefix.select(*by, "target", F.col("actor").alias("s"), F.col("size").alias("ns"), F.col("rank").alias("i"), F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    large = prefix.where(F.col("size") > WHOLE).withColumnsRenamed({"actor": "l", "size": "nl", "rank": "j"})
    ordered = (F.col("ns") < F.col("nl")) | ((F.col("ns") == F.col("nl")) & (F.col("s") < F.col("l")))
    left = 1 + F.least(F.col("ns") - F.col("i"), F.col("nl") - F.col("j"))
    fits = ordered & (F.col("ns") >= F.lit(threshold) * F.col("nl") - 1e-9) & (left * (1 + threshold) >= F.lit(threshold) * (F.col("ns") + F.col("nl")) - 1e-9)
    smaller = F.col("s") < F.col("l")
    pick = lambda x, y: F.when(smaller, F.col(x)).otherwise(F.col(y))
    candidates = small.join(large, [*by, "target", "class"]).where(fits).select(*by, pick("s", "l").alias("a"), pick("l", "s").alias("b"), pick("ns", "nl").alias("na"), pick("nl", "ns").alias("nb")).distinct()
    full_a = sets.select(*by, F.col("actor").alias("a"), "target")
    full_b = sets.select(*by, F.col("actor").alias("b"), "target")
    shared = candidates.hint("merge").join(full_a, [*by, "a"]).hint("merge").join(full_b, [*by, "b", "target"]).groupBy(*by, "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    jaccard = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return shared.withColumn("jaccard", jaccard).where(F.col("jaccard") >= threshold).select(*by, "a", "b", "jaccard")


def components(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, actor, component): least actor reachable, by rounds of least labels with short cuts.

    Each round is written to the shared folder, so no lineage grows with the rounds.
    """
    pairs = held(pairs.select(*by, "a", "b"))
    links = held(pairs.select(*by, F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(*by, F.col("b"), F.col("a"))).distinct())
    labels = held(links.select(*by, F.col("x").alias("actor")).distinct().withColumn("component", F.col("actor")))
    mark = None
    while True:
        near = links.join(labels.withColumnsRenamed({"actor": "y"}), [*by, "y"]).groupBy(*by, F.col("x").alias("actor")).agg(F.min("component").alias("c"))
        stepped = labels.join(near, [*by, "actor"]).select(*by, "actor", F.least("component", "c").alias("component"))
        hop = labels.select(*by, F.col("actor").alias("component"), F.col("component").alias("root"))
        labels = held(stepped.join(hop, [*by, "component"]).select(*by, "actor", F.least("component", "root").alias("component")))
        now = labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "actor", "component").cast("decimal(38,0)"))).first()
        if now == mark:
            return labels
        mark = now


def linked(sets: DataFrame, by: list[str], threshold: float = JACCARD) -> DataFrame:
    """(by, actor, component) of the actors that have a similar one, by the least actor that is reachable.

    Not all pairs are needed for it: where many actors meet, they are first compared within small cells and then larger ones, and
    further pairs are looked for only between those that are not joined yet.
    """
    rows = held(outlines(sets, by))
    labels = held(sets.groupBy(*by, "actor").agg(F.lit(1).alias("one")).select(*by, "actor", F.col("actor").alias("label")))
    most = prefixes(rows, threshold).groupBy("number", "class").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for near in [*(c for c in CELLS if most > 8 * c), None]:
        told = rows.hint("merge").join(labels, [*by, "actor"])
        found = alike(told, by, threshold, ["label"], F.col("label_x") != F.col("label_y"), near).select(*by, F.least("label_x", "label_y").alias("a"), F.greatest("label_x", "label_y").alias("b"))
        if near is None and has_large(sets):
            of = lambda name: labels.select(*by, F.col("actor").alias(name), F.col("label").alias(f"of_{name}"))
            large = large_pairs(sets, by, threshold).hint("merge").join(of("a"), [*by, "a"]).hint("merge").join(of("b"), [*by, "b"]).where("of_a <> of_b")
            found = found.unionByName(large.select(*by, F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")))
        joined = components(found.distinct(), by).select(*by, F.col("actor").alias("label"), F.col("component").alias("to"))
        labels = held(labels.hint("merge").join(joined, [*by, "label"], "left").select(*by, "actor", F.coalesce("to", "label").alias("label")))
    # Who has no link is alone in its component.
    several = labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return labels.hint("merge").join(several, [*by, "label"]).select(*by, "actor", F.col("label").alias("component"))


def class_components(classes: DataFrame, sets: DataFrame, by: list[str], threshold: float = JACCARD) -> DataFrame:
    """(by, rep, n, component) of the classes that are linked, to others or, as more actors than one, in themselves; ``sets``:
    those of the representatives."""
    found = linked(sets, by, threshold).withColumnRenamed("actor", "rep")
    own = classes.where("actor = rep").select(*by, "rep", "n").hint("merge").join(found, [*by, "rep"], "left")
    return own.where("component IS NOT NULL OR n > 1").withColumn("component", F.coalesce("component", "rep"))


def similar_components(sets: DataFrame, by: list[str], threshold: float = JACCARD) -> DataFrame:
    """(by, actor, component) of the actors that have a similar one, as ``components`` of ``similar_pairs`` has them."""
    classes, own = classed(sets, by)
    return classes.select(*by, "rep", "actor").hint("merge").join(class_components(classes, own, by, threshold), [*by, "rep"]).select(*by, "actor", "component")


def cohorts(edges: DataFrame, by: list[str], *, threshold: float = JACCARD, least_targets: int = MIN_TARGETS, least_actors: int = MIN_COHORT) -> DataFrame:
    """(by, component, n_actors, mean_jaccard, n_shared_targets, target_prevalence, score): groups of similar actors.

    Pairs are summed up where they are found, none is written.
    """
    sets = held(target_sets(edges, by, least_targets))
    classes, own = classed(sets, by)
    members = held(class_components(classes, own, by, threshold))
    sizes = members.groupBy(*by, "component").agg(F.sum("n").alias("n_actors")).where(F.col("n_actors") >= least_actors)
    # Classes stand for all their actors: a pair of them for n m pairs, a class for those within it.
    of = members.select(*by, F.col("rep").alias("actor"), "n", "component")
    times = lambda x, y: (F.col(x) * F.col(y)).alias("pairs")
    between = alike(outlines(own, by).hint("merge").join(of, [*by, "actor"]), by, threshold, ["n", "component"]).select(*by, F.col("component_x").alias("component"), "jaccard", times("n_x", "n_y"))
    if has_large(own):
        side = lambda c: of.withColumnsRenamed({"actor": c, "n": f"n_{c}", "component": f"in_{c}"})
        large = large_pairs(own, by, threshold).hint("merge").join(side("a"), [*by, "a"]).hint("merge").join(side("b"), [*by, "b"])
        between = between.union(large.select(*by, F.col("in_a").alias("component"), "jaccard", times("n_a", "n_b")))
    within = members.select(*by, "component", F.lit(1.0).alias("jaccard"), F.expr("n * (n - 1) div 2").alias("pairs"))
    means = between.union(within).groupBy(*by, "component").agg((F.sum(F.col("jaccard") * F.col("pairs")) / F.sum("pairs")).alias("mean_jaccard"))
    in_scope = classes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_scope"))
    popular = sets.groupBy(*by, "target").agg(F.count(F.lit(1)).alias("tally"))
    shared = own.hint("merge").join(members.withColumnRenamed("rep", "actor"), [*by, "actor"]).groupBy(*by, "component", "target").agg(F.sum("n").alias("k"))
    shared = shared.join(sizes, [*by, "component"]).where("k = n_actors").join(popular, [*by, "target"]).groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n_shared_targets"), F.max("tally").alias("top"))
    out = sizes.join(means, [*by, "component"]).join(shared, [*by, "component"], "left").join(in_scope, by)
    return out.select(
        *by, "component", "n_actors", "mean_jaccard", F.coalesce("n_shared_targets", F.lit(0).cast("long")).alias("n_shared_targets"), (F.coalesce("top", F.lit(0)) / F.col("n_scope")).alias("target_prevalence"),
        scalars.magnitude(F.col("mean_jaccard") * F.col("n_actors")).alias("score"),
    )


def synchronisation(edges: DataFrame, by: list[str], span_s: float, *, within_s: float = 3600.0, least_compression: float = 10.0, least_actors: int = 5) -> DataFrame:
    """Groups whose actors all first acted within a short part of the interval of ``span_s`` seconds."""
    first = edges.groupBy(*by, "actor").agg(F.min("us").alias("t"))
    out = first.groupBy(*by).agg(F.count(F.lit(1)).alias("n_actors"), F.min("t").alias("from_us"), F.max("t").alias("to_us"))
    out = out.withColumn("first_act_span_s", (F.col("to_us") - F.col("from_us")) / F.lit(1e6))
    compression = F.least(F.lit(1e6), F.when(F.col("first_act_span_s") > 0, F.lit(span_s) / F.col("first_act_span_s")).otherwise(F.lit(span_s * 1e6)))
    out = out.withColumn("compression", compression)
    return out.where((F.col("n_actors") >= least_actors) & (F.col("first_act_span_s") <= within_s) & (F.col("compression") >= least_compression)).withColumn("score", scalars.magnitude(F.col("compression")))


def inbound(transitions: DataFrame, edges: DataFrame, *, lookback_s: int = 86_400, multiple: int = 4, least: int = 5, least_actors: int = 3, excess: float = 2.0) -> DataFrame:
    """For each transition (actor, us, status): edges that point at the actor in the lookback before it, against the
    ``multiple`` lookbacks before that.

    All are differences of running counts, so no edge meets a transition.  An actor is in the lookback from its act on until
    its next one or the lookback's end, whichever comes first: the distinct ones are those that came less those that went.
    Transitions of an actor that are at the same time find each edge once each, and each has what they find together.
    Counts run within (actor, cell of one lookback), from what the cells before it sum up to.
    """
    back = lookback_s * scalars.MICROS
    acts = edges.select(F.col("target").alias("who"), F.col("us").cast("long").alias("at"), F.col("actor").alias("by_actor")).where("who IS NOT NULL AND at IS NOT NULL")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    goes = F.least(F.col("at") + back, F.lead("at").over(Window.partitionBy("who", "by_actor").orderBy("at")))
    known = F.col("by_actor").isNotNull()
    both = F.array(F.struct(F.col("at"), one.alias("acts"), F.when(known, one).otherwise(zero).alias("actors")), F.struct(F.when(known, F.col("goes")).alias("at"), zero.alias("acts"), (-one).alias("actors")))
    steps = acts.withColumn("goes", goes).select("who", F.explode(both).alias("p")).select("who", "p.*").where("at IS NOT NULL").withColumns({"t": F.lit(None).cast("long"), "k": F.lit(None).cast("int"), "times": F.lit(None).cast("long")})
    asked = transitions.select(F.col("actor").alias("who"), F.col("us").cast("long").alias("t")).where("who IS NOT NULL AND t IS NOT NULL").groupBy("who", "t").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.select("who", "t", "times", F.explode(F.array(*[F.lit(k) for k in (0, 1, multiple + 1)])).alias("k")).select("who", (F.col("t") - F.col("k") * F.lit(back)).alias("at"), zero.alias("acts"), zero.alias("actors"), "t", "k", "times")
    points = held(steps.unionByName(asked).withColumn("cell", F.floor(F.col("at") / F.lit(back))))
    before = Window.partitionBy("who").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = points.groupBy("who", "cell").agg(F.sum("acts").alias("acts_in"), F.sum("actors").alias("actors_in"))
    cells = cells.select("who", "cell", *[F.coalesce(F.sum(f"{c}_in").over(before), zero).alias(f"{c}_before") for c in ("acts", "actors")])
    # What happens at the time of a transition is not before it.
    within = Window.partitionBy("who", "cell").orderBy("at", F.col("t").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    counted = points.select("who", "cell", "t", "k", "times", *[F.sum(c).over(within).alias(c) for c in ("acts", "actors")]).where("t IS NOT NULL").join(cells, ["who", "cell"])
    upto = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c) + F.col(f"{c}_before")))
    times = F.max("times")
    found = counted.groupBy("who", "t").agg((times * (upto("acts", 0) - upto("acts", 1))).alias("n_inbound"), upto("actors", 0).alias("n_distinct_actors"), (times * (upto("acts", 1) - upto("acts", multiple + 1))).alias("baseline_raw"))
    out = transitions.select(F.col("actor").alias("who"), F.col("us").alias("t"), "status").join(found, ["who", "t"], "left").fillna(0, ["n_inbound", "n_distinct_actors", "baseline_raw"])
    base = F.col("baseline_raw") / F.lit(multiple)
    ratio = F.when(base > 0, F.col("n_inbound") / base).otherwise(F.col("n_inbound").cast("double"))
    out = out.withColumns({"baseline_inbound": base, "excess_ratio": ratio, "undefined_baseline": base <= 0})
    fits = (F.col("n_inbound") >= least) & (F.col("n_distinct_actors") >= least_actors) & (F.col("excess_ratio") >= excess)
    return out.withColumns({"type": F.when(fits, "deactivation_after_inbound").otherwise("deactivation_quiet"), "score": F.when(fits, scalars.magnitude(F.col("excess_ratio"))).otherwise(0.0)})
