"""The stages on the smallest tables and on one with nulls, repeats and nothing."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from tests.llm.test_operators import BLANK, UPPER, components_by_hand, ids_by_hand, word_json
from tidemark.llm import decontaminate, near_dup, quality, suffix_dedup
from tidemark.llm.runtime import stored, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    want = quality.quality(docs).where("kept").count()
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == names and docs.dtypes == before.dtypes
        if name == "quality":
            assert docs.count() == want
        if name == "near_duplicates":
            assert docs.count() == near_dup.near_duplicates(before).where("kept").count()
            assert near_dup.near_duplicates(docs).where("not kept").count() == 0
        if name == "suffix_dedup":
            assert suffix_dedup.remove_repeats(docs).selectExpr("sum(n_bytes)").first()[0] <= suffix_dedup.remove_repeats(before).selectExpr("sum(n_bytes - n_removed)").first()[0]
        if name == "decontamination":
            assert decontaminate.decontaminate(docs, table(spark, sf, "benchmark")).where("contaminated").count() == 0
    assert docs.count() > 0


def test_stages_take_odd_rows(spark, sf):
    schema = table(spark, sf, "documents").schema
    rows = [(1, None, None, None, None), (None, "", "en", None, 0), (2, "x " * 60, None, "s", 3), (2, "x " * 60, None, "s", 3), (None, "word " * 5, "en", "s", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf), name)
        assert docs.count() == 0  # none has 50 words that do not repeat
    docs = spark.createDataFrame(rows, schema)
    # Only cutting repeats drops one: the text that has nothing but blanks.
    assert {name: stage(spark, docs, sf).count() for name, stage in corpus_pipeline.STAGES[1:]} == {"near_duplicates": 5, "suffix_dedup": 4, "decontamination": 5, "packing": 5}


def test_stages_take_columns_under_any_names(spark, sf):
    """Columns called like the stages' own, beside those of the documents."""
    docs = table(spark, sf, "documents").limit(60)
    names = ["__row", "__ROW_", "kept", "contaminated", "id", "parts", "__of", "__id", "n_words", "component_id", "spot", "shard"]
    docs = stored(docs.selectExpr("*", *[f"'{n}' as `{n}`" for n in names]), "wide")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == columns and docs.where("`__row` <> '__row' or `__of` <> '__of'").count() == 0
    assert docs.count() > 0


def good(text):
    """The base rules and the bands of whole text and chunks."""
    w, bands, z = BLANK.findall(text or ""), quality.Bands(), zstandard.ZstdCompressor(level=3)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {p + d for p in range(len(w) - 2) if seen[tuple(w[p : p + 3])] > 1 for d in range(3)}
    if len(w) < 50 or 100 * len(inside) > 50 * len(w):
        return False
    raw, limits = text.encode(), lambda n, rows: [(lo, hi) for at, lo, hi in rows if n >= at][-1:]
    ratio = lambda part: len(z.compress(part)) / len(part)
    if not limits(len(raw), bands.whole):
        return True
    step = 1024
    while step >= 256 and len(raw) < 2 * step:
        step //= 2
    cuts = [k for k in range(0, len(raw), step) if k == 0 or len(raw) - k >= 128] + [len(raw)]
    (lo, hi), bad = limits(len(raw), bands.whole)[0], 0
    for a, b in itertools.pairwise(cuts):
        (low, high) = limits(b - a, bands.chunk)[0]
        bad += 0 if low <= ratio(raw[a:b]) <= high else b - a
    return lo <= ratio(raw) <= hi and bad < 0.3 * len(raw)


def without_repeats(rows, length=50):
    first, out = {}, []
    for i, t in sorted(rows):
        raw = t.encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], i)
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            gone[p : p + length] |= first[raw[p : p + length]] < i
        ends = np.cumsum([0, *(len(c.encode()) for c in t)])
        left = "".join(c for c, a, b in zip(t, ends, ends[1:], strict=False) if not gone[a:b].any())
        if BLANK.search(left):
            out.append((i, left))
    return out


def clean(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    windows = {tuple(w[k : k + min(window, len(w))]) for w in map(words, items) if w for k in range(len(w) - min(window, len(w)) + 1)}
    sizes, out = {len(x) for x in windows}, []
    for i, t in rows:
        w = words(t)
        if not any(tuple(w[p : p + m]) in windows for m in sizes for p in range(len(w) - m + 1)):
            out.append((i, t))
    return out


@pytest.fixture(scope="module")
def small_corpus(spark, sf, tmp_path_factory):
    """Documents of the driver's, and copies, near copies, a shared passage, benchmark passages and junk among them."""
    rng, folder = random.Random(12), str(tmp_path_factory.mktemp("corpus"))
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").where("length(text) BETWEEN 400 AND 3000").orderBy("doc_id").limit(70).collect()]
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    most = max(i for i, _ in docs)
    passage = " ".join(rng.choice(docs)[1].split()[:60])
    for k, (_, t) in enumerate(rng.sample(docs, 24)):
        w = t.split(" ")
        kind = k % 6
        made = [t, " ".join(["changed", *w[1:]]), f"{t}\n{passage} ü€", f"{t} {rng.choice(items)}", "spam " * 200, " ".join(w[: len(w) // 2]) + " " + rng.choice(docs)[1]][kind]
        docs.append((most + 1 + k, made))
    docs.append((most + 40, None))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rng.sample(rows, len(rows)), table(spark, sf, "documents").schema).write.parquet(f"{folder}/documents.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_pipeline_is_its_stages_by_hand(spark, small_corpus):
    folder, rows, items = small_corpus
    want = {"quality": [(i, t) for i, t in rows if good(t)]}
    _, find = components_by_hand(want["quality"], 5, 80)
    want["near_duplicates"] = [(i, t) for i, t in want["quality"] if find(i) == i]
    want["suffix_dedup"] = without_repeats(want["near_duplicates"])
    want["decontamination"] = clean(want["suffix_dedup"], items)
    sizes = [len(rows), *(len(v) for v in want.values())]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] and sizes[3] > sizes[4] > 30
    assert dict(want["suffix_dedup"]) != {i: t for i, t in want["near_duplicates"] if i in dict(want["suffix_dedup"])}  # something was cut

    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(want[name]), name
        assert all(r.n_chars == len(r.text) for r in got)

    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens, r.sequence_id * 4096 + r.offset))
    left = want["decontamination"]
    ids = {i: [*x, 2] for (i, _), x in zip(left, ids_by_hand(word_json.__wrapped__() if hasattr(word_json, "__wrapped__") else word_json(), [t for _, t in left]), strict=True)}
    assert set(pieces) == set(ids)
    taken = []
    for i, found in pieces.items():
        found.sort()
        assert [s for s, *_ in found] == [0, *itertools.accumulate(n for _, n, *_ in found)][:-1] and sum(n for _, n, *_ in found) == len(ids[i]) == found[0][2]
        taken += [(at, at + n) for _, n, _, at in found]
        assert all(at // 4096 == (at + n - 1) // 4096 for _, n, _, at in found)
    taken.sort()
    assert taken[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(taken))  # one line without holes
