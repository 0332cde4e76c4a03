"""Canonical forms, commitments to sets and order statistics against plain Python, on odd values."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import trees
from tidemark.operators import commitments, heavy, ingest, ranks


def canonical_of(value):
    """The plain way: sorted keys, six digits, nulls kept."""
    if isinstance(value, dict):
        return {k: canonical_of(value[k]) for k in sorted(value)}
    if isinstance(value, (list, tuple)):
        return [canonical_of(x) for x in value]
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def text_of(value):
    return json.dumps(canonical_of(value), separators=(",", ":"), ensure_ascii=False)


SCHEMA = "z long, a struct<y: double, b: array<struct<q: string, a: boolean>>>, m map<string, array<double>>, s string, e array<int>"


@pytest.fixture
def documents():
    rng = random.Random(8)
    rows = [(1, (0.1234567, [("x", True), (None, None)]), {"b": [1.0, -2.5], "a": []}, 'q"\\\n\t é', [1, None]), (None, None, None, None, None), (-5, (None, []), {}, "", [])]
    rows += [(rng.randrange(10**12), (rng.uniform(-1e6, 1e6), [(rng.choice(["k", "é", ""]), rng.random() < 0.5) for _ in range(rng.randint(0, 14))]), {f"k{i}": [rng.uniform(-1, 1)] for i in range(rng.randint(0, 4))}, "t" * rng.randint(0, 300), list(range(rng.randint(0, 15)))) for _ in range(60)]
    return rows


def as_dict(row):
    z, a, m, s, e = row
    inner = None if a is None else {"y": a[0], "b": [{"q": q, "a": b} for q, b in a[1]]}
    return {"z": z, "a": inner, "m": m, "s": s, "e": e}


def test_canonical_form_of_structs(spark, documents):
    df = spark.createDataFrame(documents, SCHEMA).select(F.struct("*").alias("d"))
    got = [r[0] for r in df.select(trees.canonical(F.col("d"), df.schema["d"].dataType)).collect()]
    assert sorted(got) == sorted(text_of(as_dict(r)) for r in documents)
    shuffled = df.select(F.struct(*[F.col(f"d.{c}") for c in ("s", "m", "e", "a", "z")]).alias("d"))  # the order of fields does not matter
    assert sorted(r[0] for r in shuffled.select(trees.canonical(F.col("d"), shuffled.schema["d"].dataType)).collect()) == sorted(got)


def test_documents_are_dealt_over_the_tasks_of_a_shuffle(spark, sf):
    """One file of one row group is read by one task; what the documents in it cost must not be."""
    from tidemark.plans import structure

    found = structure.order_documents(spark, sf).groupBy(F.spark_partition_id()).count().collect()
    assert len(found) == 4 and sum(r["count"] for r in found) == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_a_variant_is_parsed_once_for_its_form(spark):
    df = spark.createDataFrame([('{"a":[1,{"b":null}]}',)], "t string").select(F.parse_json("t").alias("v"))
    form = trees.canonical(F.col("v"), df.schema["v"].dataType, depth=3)
    plan = df.select(form.alias("x")).where("x <> ''")._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert plan.count("parsejson") <= 2  # in the filter and in the column


def test_bounded_form_and_what_it_cuts(spark, documents):
    def bounded(v):
        return {k: bounded(x) for k, x in v.items()} if isinstance(v, dict) else [bounded(x) for x in v[:10]] if isinstance(v, list) else v[:200] if isinstance(v, str) else v

    df = spark.createDataFrame(documents, SCHEMA).select(F.struct("*").alias("d"))
    kind = df.schema["d"].dataType
    got = df.select(trees.canonical(F.col("d"), kind, bounded=True), trees.truncated(F.col("d"), kind)).collect()
    want = [(text_of(bounded(as_dict(r))), bool(r[3] and len(r[3]) > 200 or r[4] and len(r[4]) > 10)) for r in documents]
    assert sorted(map(tuple, got)) == sorted(want)


def test_variants_have_the_form_of_what_they_hold(spark, documents):
    texts = [json.dumps(as_dict(r)) for r in documents] + ["[]", "{}", "null", "true", '"x"', "[[[1,[2]]],{}]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v"))
    got = [r[0] for r in df.select(trees.canonical(F.col("v"), df.schema["v"].dataType)).collect()]
    assert [json.loads(x) for x in sorted(got)] == [json.loads(x) for x in sorted(text_of(json.loads(t)) for t in texts)]
    deep = spark.createDataFrame([("[" * 12 + "]" * 12,)], "t string").select(F.parse_json("t").alias("v"))
    with pytest.raises(Exception, match="deeper"):
        deep.select(trees.canonical(F.col("v"), deep.schema["v"].dataType)).collect()


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_what_is_no_number_is_refused_at_any_depth(spark, bad):
    df = spark.createDataFrame([([{"a": [1.0, bad]}],)], "d array<map<string, array<double>>>")
    with pytest.raises(Exception, match="NaN and infinity"):
        df.select(trees.canonical(F.col("d"), df.schema["d"].dataType)).collect()


def plain_root(members):
    members = sorted(set(members))
    level, n = [hashlib.sha256(f"leaf:{m}".encode()).hexdigest() for m in members], len(members)
    while len(level) > 1:
        level = [hashlib.sha256(("node:" + "".join(level[i : i + 16])).encode()).hexdigest() for i in range(0, len(level), 16)]
    return hashlib.sha256(f'{{"n":{n},"root":"{level[0]}"}}'.encode()).hexdigest()[:16]


@pytest.mark.parametrize("partitions", [1, 5])
def test_roots_and_ways_to_them(spark, partitions):
    rng = random.Random(2)
    sets = {"one": 1, "some": 16, "more": 17, "many": 700, "most": 4200, None: 33}
    rows = [(g, hashlib.md5(f"{g}{i}".encode()).hexdigest()) for g, n in sets.items() for i in range(n)]
    mixed = rng.sample(rows, len(rows)) + rows[:50] + [("one", None)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(mixed, "g string, r string").repartition(partitions)
        levels = commitments.tree(df, ["g"], "r")
        roots = {r.g: (r.n, r.root) for r in commitments.roots(levels, ["g"]).collect()}
        assert roots == {g: (n, plain_root(r for h, r in rows if h == g)) for g, n in sets.items()}
        asked = [(g, max(r for h, r in rows if h == g)) for g in sets] + rng.sample(rows, 40)
        ways = commitments.paths(levels, ["g"], spark.createDataFrame([*asked, ("some", "no member")], "g string, member string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.g or "", r.member) for r in ways) == sorted((g or "", m) for g, m in asked)
    held = spark.createDataFrame([(r.member, r.path, *roots[r.g], roots["most" if r.g != "most" else "many"][1]) for r in ways], "member string, path array<struct<at: long, hashes: array<string>>>, n long, root string, other string")
    proof = lambda member, root: commitments.proven(member, F.col("path"), F.col("n"), F.col(root))
    assert held.where(proof(F.col("member"), "root")).count() == len(ways)
    assert held.where(proof(F.concat("member", F.lit("x")), "root") | proof(F.col("member"), "other")).count() == 0
    assert max(sum(len(s.hashes) for s in r.path) for r in ways) <= 4 * 16


def test_order_statistics_of_any_group(spark):
    rng = random.Random(6)
    groups = {"ties": [5] * 400 + [6] * 3, "one": [2], "two": [1, 9], "spread": [rng.randint(-500, 500) for _ in range(999)], None: [rng.randint(0, 9) for _ in range(50)]}
    rows = [(g, x) for g, v in groups.items() for x in v] + [("ties", None), ("nothing", None)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, x long").repartition(6)
    qs = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)
    wanted = {f"n{q}": ranks.nearest(q) for q in qs} | {f"b{q}": ranks.between(q) for q in qs} | {"upper": ranks.UPPER_MEDIAN}
    got = {r.g: r for r in ranks.order_statistics(df, ["g"], "x", wanted).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        v, r = sorted(values), got[g]
        assert r.n == len(v) and r.upper == v[len(v) // 2]
        for q in qs:
            place = q * (len(v) - 1)
            low, high = v[math.floor(place)], v[math.ceil(place)]
            assert r[f"n{q}"] == v[round(place)] and math.isclose(r[f"b{q}"], low + (high - low) * (place - math.floor(place)), abs_tol=1e-9)
    assert ranks.order_statistics(df.where("g = 'nothing'"), [], "x", {"m": ranks.between(0.5)}).count() == 0


def test_order_of_times_where_one_row_is_far_off(spark):
    """Ranges of rows, not of time: one late arrival must not put all others into one task."""
    rows = [(i, i * 3 % 7) for i in range(5000)] + [(1 << 45, 3)]
    df = spark.createDataFrame(rows, "arrival long, us long")
    us = [u for _, u in rows]
    steps = [b - a for a, b in zip(us, us[1:], strict=False)]
    got = ingest.monotonicity(df).first()
    assert tuple(got) == (sum(s > 0 for s in steps), sum(s == 0 for s in steps), sum(s < 0 for s in steps))


@pytest.mark.parametrize("size", [2, 8, 64])
def test_most_frequent_names_are_exact_however_small_the_summaries(spark, size):
    """Few counters, a long tail, ties at the k-th place, a group smaller than k."""
    from collections import Counter

    rng = random.Random(size)
    rows = [("a", f"n{min(int(rng.paretovariate(0.9)), 400)}") for _ in range(4000)] + [("b", f"n{i % 37}") for i in range(370)] + [(None, "x"), (None, "y"), ("c", None)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, x string").repartition(5)
    got = sorted(map(tuple, heavy.most_frequent(df, "g", "x", 5, size=size).collect()))
    want = []
    for g in ("a", "b", None):
        counts = Counter(x for h, x in rows if h == g and x is not None)
        want += [(g or "", x, n) for x, n in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:5]]
    assert got == sorted(want)


def test_no_level_of_a_tree_goes_through_one_task_a_group(spark):
    df = spark.createDataFrame([("a", f"m{i}") for i in range(40)] + [("b", "m")], "g string, r string")
    levels = commitments.tree(df, ["g"], "r")
    ways = commitments.paths(levels, ["g"], spark.createDataFrame([("a", "m7"), ("b", "m")], "g string, member string"))
    assert "Window" not in ways._jdf.queryExecution().optimizedPlan().toString()
    assert {r.g: len(r.path) for r in ways.collect()} == {"a": 2, "b": 0}


def test_names_that_are_all_as_frequent_are_counted_in_one_more_pass(spark, monkeypatch):
    """No summary of few counters can bound them, nor one of four times as many; what is bounded beside them stays right."""
    made, summaries = [], heavy.summaries
    monkeypatch.setattr(heavy, "summaries", lambda *a: made.append(a) or summaries(*a))
    rows = [("even", f"n{i % 900}") for i in range(2700)] + [("one", "x")] * 500 + [("one", f"y{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x string").repartition(3)
    got = sorted(map(tuple, heavy.most_frequent(df, "g", "x", 1, size=4).collect()))
    assert got == [("even", "n0", 3), ("one", "x", 500)] and len(made) == 1


def test_summaries_are_bounded_and_their_errors_known(spark):
    rng = random.Random(1)
    names = [f"n{rng.randrange(3000)}" for _ in range(20_000)] + ["often"] * 4000
    df = spark.createDataFrame([("g", x) for x in rng.sample(names, len(names))], "g string, x string").repartition(4)
    rows = heavy.summaries(df, "g", "x", 50).collect()
    counters, error = {r.x: r.n for r in rows if r.x}, sum(r.n for r in rows if r.x is None)
    assert len(counters) <= 4 * 50 and 0 < error <= len(names) / 50
    for x in {*names}:
        n = names.count(x) if x == "often" else None
        assert n is None or counters[x] <= n <= counters[x] + error


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_similar_actors_are_all_pairs_at_the_threshold(spark, threshold):
    """Sets of very different sizes around one popular target, copies, near copies, and pairs just at the threshold."""
    from itertools import combinations

    from tidemark.operators import edges

    rng = random.Random(3)
    sets = {f"a{i}": {"popular", *(f"t{rng.randrange(40)}" for _ in range(rng.choice([2, 3, 8, 30])))} for i in range(70)}
    sets |= {f"b{i}": {f"u{k}" for k in range(10 - i % 3)} for i in range(9)} | {"c1": {f"v{k}" for k in range(5)}, "c2": {f"v{k}" for k in range(4)}, "c3": {"v0"}}
    rows = [("g", a, t, len(v)) for a, v in sets.items() for t in v]
    got = {(r.a, r.b): r.jaccard for r in edges.similar_pairs(spark.createDataFrame(rows, "g string, actor string, target string, size long"), ["g"], threshold).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    want = {k: v for k, v in want.items() if v >= threshold}
    assert want and got.keys() == want.keys() and all(math.isclose(got[k], v) for k, v in want.items())


def test_copies_of_a_set_do_not_multiply_candidates(spark):
    """Forty actors for each of three sets: classes are compared, whatever their number of actors; pairs and cohorts tell of all."""
    from tidemark.operators import edges

    kinds = {0: "abcde", 1: "abcdx", 2: "vwz"}
    rows = [("g", 1000 * k + i, t) for k, targets in kinds.items() for i in range(40) for t in targets]
    df = spark.createDataFrame(rows, "g string, actor long, target string").withColumn("us", F.lit(0))
    sets = edges.target_sets(df, ["g"])
    classes, own, pairs = edges.similar_classes(sets, ["g"])
    assert (classes.count(), own.count(), [tuple(r) for r in pairs.select("a", "b").collect()]) == (120, 13, [(0, 1000)])
    got = {(r.a, r.b): r.jaccard for r in edges.similar_pairs(sets, ["g"]).collect()}
    assert len(got) == 3 * (40 * 39 // 2) + 40 * 40 and got[(3, 5)] == 1.0 and abs(got[(3, 1005)] - 4 / 6) < 1e-12
    assert {(r.actor, r.component) for r in edges.similar_components(sets, ["g"]).collect()} == {(1000 * k + i, 2000 if k == 2 else 0) for k in kinds for i in range(40)}
    found = {r.component: (r.n_actors, round(r.mean_jaccard, 9), r.n_shared_targets) for r in edges.cohorts(df, ["g"]).collect()}
    assert found == {0: (80, round((1560 + 1600 * 4 / 6) / 3160, 9), 4), 2000: (40, 1.0, 3)}


@pytest.mark.parametrize(("universe", "threshold"), [(40, 0.2), (90, 0.2), (20, 0.5)])
def test_similar_actors_meet_in_blocks_and_cells(spark, monkeypatch, universe, threshold):
    """Sets that all differ, of few targets (each with a bit of its own) or more than there are bits, some too large to travel:
    whatever the blocks and cells, pairs and components are those of comparing all, and no pair is shuffled."""
    from itertools import combinations

    from tidemark.operators import edges

    for name, value in (("WHOLE", 12), ("OUTLINE", ["o0"]), ("BLOCK", 8), ("CELLS", (2,))):
        assert hasattr(edges, name)
        monkeypatch.setattr(edges, name, value)
    rng = random.Random(universe)
    sets = {i: frozenset(rng.sample(range(universe), rng.choice([3, 4, 6, 9, 12, 20]))) for i in range(60)}
    rows = [("g", a, str(t), len(v)) for a, v in sets.items() for t in v]
    df = spark.createDataFrame(rows, "g string, actor long, target string, size long")
    found = edges.similar_pairs(df, ["g"], threshold)
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(want) > 5 and set(got) == want
    least = {a: a for p in want for a in p}
    for _ in sets:
        for a, b in want:
            least[a] = least[b] = min(least[a], least[b])
    assert {r.actor: r.component for r in edges.similar_components(df, ["g"], threshold).collect()} == least
    small = edges.similar_pairs(df.where("size <= 12"), ["g"], threshold)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in small and not any("jaccard" in line for line in small.split("\n") if "Exchange" in line)
