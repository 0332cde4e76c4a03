"""Each operator against a brute-force version, on a fixture with nulls, empty and odd texts, ties and repeats."""

import base64
import gzip
import hashlib
import io
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, near_dup, packing, pieces, quality, sharding, suffix_dedup, token_counts, token_store, warc
from tidemark.llm.runtime import table

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string"


def word_salad(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids (one null, one repeated) to texts: random, copies, near copies, shared passages, odd characters, very long."""
    rng = random.Random(2)
    base = [word_salad(rng, n) for n in (5, 60, 200, 400, 80, 3, 700)]
    near = base[3].split()
    passage = word_salad(rng, 40)
    out = [None, "", " \n\t ", "x", "é Ünïcode 中文 😀 <|endoftext|> end", "A  b\n c  ", *base, base[2], base[2].upper(), " ".join(["zz", *near[1:]]), " ".join([*near[:-2], "q"]), base[1] + " " + passage, passage + "\n" + base[4], "same line\n" * 80, word_salad(rng, 20_000), "ü" * 120, "ü" * 119 + "ä"]
    rows = list(enumerate(out))
    return [*rows, (3, "x"), (5, "another text under an id that is taken " * 3), (None, base[6])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None, "fr"][k % 3], None if k % 5 == 0 else "s", None, "clash", "clash") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jump_hash_is_the_published_one(docs, empty, texts):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    rows = sharding.assign(docs, 7).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump((r.doc_id or 0) & (2**64 - 1), 7), jump((r.doc_id or 0) & (2**64 - 1), 8))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sharding.assign(empty, 7).count() == 0


def test_jump_hash_moves_little(spark):
    keys = spark.range(0, 4000).select(F.when(F.col("id") % 2 == 0, F.col("id") * -7919).otherwise(F.col("id") * 104729).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.assign(keys, 10).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {10} and 0.05 < len(moved) / len(rows) < 0.14
    assert max(Counter(r.shard for r in rows).values()) < 500


def test_language_held_out(spark, sf):
    docs = table(spark, sf, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(language_id.sample(docs.where(~held), "doc_id", "text", "lang"))
    got = language_id.identify(docs, model, carry=["doc_id", "lang", held.alias("held")]).where("held").collect()
    assert len(got) > 20 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_letters_or_labels(docs, empty):
    model = language_id.fit(language_id.sample(docs, "doc_id", "text", "lang"))
    got = language_id.identify(docs.where("doc_id in (0, 1, 2) or text is null"), model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    nothing = language_id.fit(language_id.sample(empty, "doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.fit([("abc", "en")]).languages == ("en",)
    assert language_id.identify(empty, model).count() == 0


@pytest.mark.parametrize("n", [2, 4, 9])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    assert min(int((a != b).sum()) for a, b in itertools.combinations(code, 2)) >= max(1, code.shape[1] // 4)


def components_by_hand(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = BLANK.findall((t or "").translate(UPPER))
        sets.setdefault(i, []).append(set(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([i for i in sets if i is not None], 2):
        if any(100 * len(x & y) >= percent * len(x | y) and x & y for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sets, find


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, empty, texts, k):
    sets, find = components_by_hand(texts, k, 80)
    rows = near_dup.near_duplicates(docs, words=k).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id)) and r.kept == (r.doc_id == r.component_id)
    assert near_dup.near_duplicates(empty).count() == 0


def test_families_of_almost_near_duplicates(spark):
    """Many texts that share bands with each other but are mostly below the threshold: all links, and only those."""
    rng = random.Random(9)
    base = word_salad(rng, 150).split()
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"w{rng.random()}"
        rows.append((i, " ".join(words)))
    sets, find = components_by_hand(rows, 5, 80)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [8, 512])
def test_large_buckets_by_size_classes(spark, monkeypatch, block):
    """A passage that texts of all sizes share, with links inside and between size classes: all of them, however it is dealt."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng, rows = random.Random(21), []
    shared = word_salad(rng, 40)
    for i in range(60):
        own = word_salad(rng, rng.choice((5, 20, 60, 90, 110, 140))).split()
        rows.append((3 * i, shared + " " + " ".join(own)))
        rows.append((3 * i + 1, shared + " " + " ".join(own[: len(own) - rng.randint(0, max(1, len(own) // 5))])))
        rows.append((3 * i + 2, shared + " " + " ".join([*own, *word_salad(rng, rng.randint(1, 12)).split()])))
    _, find = components_by_hand(rows, 5, 80)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i, _ in rows}


def test_equal_sets_only(spark):
    a = word_salad(random.Random(1), 40)
    rows = [(0, a), (1, a.upper()), (2, a + " more"), (3, a + " more"), (4, "x " + a)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=100).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size, shared in ((40, 30), (2000, 1500)):
        common = rng.integers(0, 2**63, shared, dtype=np.int64).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, size - shared, dtype=np.int64).astype(np.uint64)])) for _ in range(2))
        s = near_dup.sketches([a, b, a[:1]], 252)
        assert abs((s[0] == s[1]).mean() - shared / (2 * size - shared)) < 0.12
        assert (s != np.iinfo(np.uint64).max).all()


@pytest.fixture(scope="module")
def word_json():
    return pieces.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def ids_by_hand(spec, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name, texts):
    spec = pieces.read_tokenizer(public_tokenizers.path(name))
    rng, letters = random.Random(4), "abcAB 's't'll   \n\t\r\x0b\x0c\x1c\x1f\x85\xa0é ÀßŉĳŽ0123²½ª·!?.,'\"-_#<|>İſ中"
    samples = [t for _, t in texts] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, counts = pieces.TextEncoder(spec, entries=50), pieces.TextEncoder(spec, counting=True, hot={b"b": 1})
    for text, want in zip(samples, ids_by_hand(spec, samples), strict=True):
        assert np.frombuffer(ids(text), ids.dtype).tolist() == want
        assert counts(text) == len(want)


def test_token_store_round_trip(docs, empty, texts, word_json, spark):
    manifest = token_store.write_store(docs, word_json, end_id=1)
    rows = token_store.read_store(manifest, docs.select("doc_id")).collect()
    want = Counter((i, tuple([*ids, 1])) for (i, _), ids in zip(texts, ids_by_hand(word_json, [t for _, t in texts]), strict=True))
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows)
    assert got == want and all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    line = sorted((r.start, r.n_tokens, r.doc_id) for r in rows)
    assert [s for s, _, _ in line] == list(itertools.accumulate((n for _, n, _ in line), initial=0))[:-1]
    keys = [k for _, _, k in line if k is not None]
    assert keys == sorted(keys)
    assert token_store.read_store(manifest, spark.createDataFrame([(10**9,), (4,), (4,)], "doc_id long")).count() == 1
    nothing = token_store.write_store(empty, word_json)
    assert nothing.count() == 0 and token_store.read_store(nothing, docs.select("doc_id")).count() == 0


def test_perfect_hash_is_minimal_and_turns_strangers_away():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(2**62), 2**62, 20_000))
    assert sorted(token_store.PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))
    index = token_store.Index(token_store.index_bytes(keys.tolist(), [3] * len(keys), 2))
    assert (index.find(keys) == np.arange(len(keys))).all()
    strangers = np.setdiff1d(rng.integers(-(2**62), 2**62, 20_000), keys)
    assert (index.find(strangers) >= 0).mean() < 1e-3


def test_suffix_dedup(docs, empty, texts):
    order = sorted(((i, t) for i, t in texts if i is not None), key=lambda x: x[0]) + [(i, t) for i, t in texts if i is None]
    first, want = {}, Counter()
    for i, t in order:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    for i, t in texts:
        raw, mask = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for p in range(len(raw) - 49):
            f = first[raw[p : p + 50]]
            if f is not None and (i is None or f < i):
                mask[p : p + 50] = True
        runs = len(list(k for k, _ in itertools.groupby(mask) if k))
        want[(i, len(raw), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_random(spark):
    """Little alphabets and mutated copies: many samples with several contents, in tiny blocks."""
    rng = random.Random(6)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(40, 160))) for _ in range(12)]
    rows = []
    for i in range(150):
        t = "".join(rng.choice(pool)[rng.randint(0, 20) :] for _ in range(rng.randint(1, 3)))
        k = rng.randrange(len(t))
        rows.append((i, t[:k] + "X" + t[k:]))
    first, want = {}, {}
    for i, t in rows:
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                mask[p : p + 50] = True
        want[i] = int(mask.sum()), hashlib.sha256("".join(c for c, m in zip(t, mask, strict=True) if not m).encode()).hexdigest()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()} == want
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, hot_rows=5).collect()} == want
    cut = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df, rewrite=True).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in cut.items()} == {i: h for i, (_, h) in want.items()}


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    """Rows without an id whose texts share the low 20 bits of their crc32: each loses its own bytes."""
    rng = random.Random(8)
    passage = "a passage that the document with the least id has too, of more than fifty bytes"
    held, pair = {}, None
    while not pair:
        t = word_salad(rng, 30)
        t = t + passage if len(held) % 2 else passage + t + " and a longer end " * 5
        other = held.setdefault(zlib.crc32(t.encode()) & 0xFFFFF, t)
        pair = (other, t) if other.startswith(passage) != t.startswith(passage) else None
    for ids in ((None, None), (7, 7)):
        df = spark.createDataFrame([(1, passage), (ids[0], pair[0]), (ids[1], pair[1])], "doc_id long, text string")
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())
        left = [(i, len(t), len(passage), hashlib.sha256(t.replace(passage, "").encode()).hexdigest()) for i, t in zip(ids, pair, strict=True)]
        assert got == Counter([(1, len(passage), 0, hashlib.sha256(passage.encode()).hexdigest()), *left])
        cut = suffix_dedup.remove_repeats(df, rewrite=True)
        assert cut.columns == df.columns and Counter(r.text for r in cut.collect()) == Counter([passage, *(t.replace(passage, "") for t in pair)])


def test_rewrite_keeps_columns_and_whole_characters(docs, texts):
    rows = suffix_dedup.remove_repeats(docs, rewrite=True)
    assert rows.columns == docs.columns and rows.count() == len(texts)
    assert all("�" not in (r.text or "") for r in rows.collect())


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (None, "b c"), (4, None), (5, " ... "), (6, "One TWO, three four five six seven eight nine ten"), (2, "short item")]
CASES = [
    (0, "x one two three four five six seven eight nine ten eleven y"), (1, "a short-item here"), (2, "b c b c"), (3, None), (4, "five six seven"), (5, "one two three four five six seven eight nine ten"), (5, "one"), (None, "SHORT item"),
    (7, "word " * 700 + "two three four five six seven eight nine ten eleven " + "w " * 300),
]


def hits_by_hand(window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    out = Counter()
    for i, t in CASES:
        w, hit, items = words(t), set(), set()
        for item, text in ITEMS:
            v = words(text)
            m = min(window, len(v))
            for s in {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else ():
                for p in range(len(w) - m + 1):
                    if tuple(w[p : p + m]) == s:
                        hit |= set(range(p, p + m))
                        items.add("null" if item is None else str(item))
        out[(i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_decontamination(spark, limit):
    bench, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame(CASES, "doc_id long, text string")
    got = decontaminate.decontaminate(docs, bench, block_bytes=limit)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == hits_by_hand()
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_decontamination_carries_columns_without_the_key(spark, limit):
    bench, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame(CASES, "doc_id long, text string")
    got = decontaminate.decontaminate(docs.withColumn("__row", F.struct(*docs.columns)), bench, block_bytes=limit, carry=["__row"])
    assert got.columns[0] == "__row" and "doc_id" not in got.columns
    assert Counter(tuple(r) for r in got.select("__row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == hits_by_hand()


def test_packing(docs, empty, texts, word_json):
    rows = packing.pack(docs, word_json, end_id=2, window=256, with_ids=True).collect()
    want = Counter(tuple([*ids, 2]) for ids in ids_by_hand(word_json, [t for _, t in texts]))
    whole = defaultdict(dict)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        whole[r.sequence_id * 256 + r.offset - r.start][r.start] = r.ids
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert Counter(tuple(np.frombuffer(b"".join(p[s] for s in sorted(p)), "<u4").tolist()) for p in whole.values()) == want
    sizes = defaultdict(list)
    for r in rows:
        sizes[r.sequence_id].append((r.offset, r.length))
    full = [sum(n for _, n in v) for _, v in sorted(sizes.items())]
    assert all(n == 256 for n in full[:-1]) and all(sorted(v)[0][0] == 0 for v in sizes.values())
    assert packing.pack(empty, word_json).count() == 0


def test_quality(docs, empty, texts):
    want = Counter()
    for i, t in texts:
        t = t or ""
        w, lines = BLANK.findall(t), [x for x in t.split("\n") if BLANK.search(x)]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {p + d for p in range(len(w) - 2) if seen[tuple(w[p : p + 3])] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed)] += 1
    got = quality.quality(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and quality.quality(empty).count() == 0


def test_bands_reject_both_ends_and_keep_prose(spark, sf):
    rng = random.Random(1)
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(120))
    repeat = " ".join(f"word{i % 7}{'ab' * (i % 3)}" for i in range(3000))
    rows = {r.doc_id: r for r in quality.quality(spark.createDataFrame([(0, noise), (1, repeat)], "doc_id long, text string")).collect()}
    assert rows[0].zstd_ratio > 0.6 and not rows[0].kept and rows[1].zstd_ratio < 0.2 and not rows[1].kept
    labels = table(spark, sf, "labels").where("quality = 1")
    good = quality.quality(table(spark, sf, "documents")).join(labels, "doc_id", "left_semi").where("not base_failed")
    assert good.where("kept").count() >= 0.98 * good.count() > 0


@pytest.mark.parametrize("size", [1_200, 2_000, 4_005, 6_000, 8_004])
def test_bands_find_repetitive_and_incompressible_parts_that_cancel_out(size):
    """Nothing in these is text, yet the ratio of the whole may lie in its band: 40 percent one sentence, 60 percent random."""
    rng = random.Random(size)
    sentence = "the quick brown fox jumps over the lazy dog and runs away again. "
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    noise = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(size))
    k = 2 * size // 5
    raw = ((sentence * size)[:k] + noise[: size - k]).encode()
    bands = quality.Bands()
    ratio, bad, kept = quality.in_band(raw, bands, zstandard.ZstdCompressor(level=bands.level))
    lo, hi = quality.band_of(size, bands.whole)
    assert lo <= ratio <= hi and bad > 0.5 and not kept


def test_chunks_hold_every_byte_and_have_a_band():
    bands = quality.Bands()
    for size in [*range(300, 2_400, 7), 8_191, 8_192, 20_001]:
        chunks = quality.chunks_of(bytes(i % 251 for i in range(size)), bands)
        assert b"".join(chunks) == bytes(i % 251 for i in range(size)) and len(chunks) > 1
        assert all(quality.band_of(len(c), bands.chunk) for c in chunks)


def test_token_counts(docs, empty, texts):
    spec = pieces.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, len((t or "").encode()), len(ids), len(ids) > 50) for (i, t), ids in zip(texts, ids_by_hand(spec, [t for _, t in texts]), strict=True))
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, spec, limit=50).collect()) == want
    assert token_counts.count_tokens(empty, spec).count() == 0


PAGES = [(1, "http://a/b c", "x"), (2, None, "x"), (None, "u", "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 500), (2, "v", "x"), (6, "u", "line\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 2])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.read_pages(warc.write_pages(pages, least_bytes=least)).collect()
    top = defaultdict(lambda: None)
    for i, _, h in PAGES:
        if i is not None:
            top[h or ""] = max(i, top[h or ""] or i)
    want = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        of = top[h or ""] if len(raw) >= least and i != top[h or ""] else None
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if of is None else "revisit", of)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.read_pages(warc.write_pages(pages.limit(0))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_convert(spark, tmp_path, version):
    bodies = [b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one</p>", b"plain\nbytes", b""]
    raw = warc.arc_file_head("f.arc", "19990101", version) + b"".join(warc.arc_bytes(f"http://h/{i}", "19990102030405", "text/html", b, version) for i, b in enumerate(bodies))
    files = spark.createDataFrame([(bytearray(raw),), (bytearray(gzip.compress(raw)),)], "content binary")
    manifest = warc.convert_arc(files, f"file://{tmp_path}/out").collect()
    assert [r.records for r in manifest] == [3, 3]
    records = list(warc.parse_warc(gzip.open(tmp_path / "out" / manifest[0].file)))
    assert [f["WARC-Type"] for f, _ in records] == ["response", "resource", "resource"] and [b for _, b in records] == bodies
    assert {f["WARC-Date"] for f, _ in records} == {"1999-01-02T03:04:05Z"}
    assert records[0][0]["WARC-Payload-Digest"] == f"sha1:{warc.base32_sha1(b'<p>one</p>')}"
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(raw[:-20])))
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(b"not a header\n")))


def test_rows_of_one_id_are_one_document(spark):
    """(3, B), (5, A), (5, B): all three are one component; so is a row of the id without words."""
    a, b = word_salad(random.Random(1), 30), word_salad(random.Random(2), 30)
    rows = [(3, b), (5, a), (5, b), (5, None), (7, a), (None, a), (9, "other words that nobody else has at all in here")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter({(3, 3, True): 1, (5, 3, False): 3, (7, 3, False): 1, (None, None, True): 1, (9, 9, True): 1})


def test_recall_of_pairs_just_above_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85: nearly all are found (each is missed with a probability of 3 in a million or less)."""
    rng, rows, want = random.Random(12), [], 0
    for i in range(150):
        words = word_salad(rng, 120).split()
        other = [*words[: 120 - rng.choice((9, 10, 11, 12))], *word_salad(rng, 10).split()]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets, _ = components_by_hand(rows, 5, 80)
    near = [i for i in range(150) if 80 <= 100 * len(sets[2 * i][0] & sets[2 * i + 1][0]) / len(sets[2 * i][0] | sets[2 * i + 1][0]) <= 85]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 30 and sum(got[2 * i] == got[2 * i + 1] for i in near) == len(near)


def test_slots_of_equal_and_outlying_rows(spark):
    rows = [(None, "same")] * 500 + [(7, "same")] * 300 + [(2**62, "far"), (-5, None)] + [(i, "t") for i in range(100)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)


def test_language_decoding_by_hand(docs, spark, sf):
    """The codeword of the least weighted loss, bit by bit."""
    table_ = table(spark, sf, "documents")
    model = language_id.fit(language_id.sample(table_, "doc_id", "text", "lang"))
    texts_ = [r.text for r in table_.limit(40).collect()] + ["123 ...", None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    for i, t in enumerate(texts_):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = language_id.features(t.encode())
        margins = [min(30.0, max(-30.0, float(sum(a * w for a, w in zip(x, model.weights[:, b]) if a)) + float(model.bias[b]))) for b in range(model.code.shape[1])]
        total = sum(map(abs, margins))
        losses = [sum(abs(m) / total * np.log1p(np.exp(-m * bit)) for m, bit in zip(margins, word)) for word in model.code]
        assert got[i].lang_pred == model.languages[int(np.argmin(losses))]
        soft = np.exp(min(losses) - np.array(losses))
        assert abs(got[i].score - max(soft) / sum(soft)) < 1e-3


def test_language_sample_is_bounded_and_thins_copies(spark):
    rows = [(None, "le même texte", "fr")] * 3000 + [(i, f"text number {i} of some words", "en") for i in range(1500)] + [(9, None, "xx"), (9, "x", None)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 100)
    assert Counter(lang for _, lang in got) == {"fr": 1, "en": 100}
    assert np.allclose(language_id.unpacked(got[0][0]), language_id.features(b"le m\xc3\xaame texte")) or got[0][1] == "en"
    many = spark.createDataFrame([(i, "t", f"l{i}") for i in range(language_id.MAX_LANGUAGES + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.sample(many, "doc_id", "text", "lang")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_cuts_ahead_of_marks_as_the_library_does(name):
    spec = pieces.read_tokenizer(public_tokenizers.path(name))
    rng, parts = random.Random(5), ["word", "été", "it's", "12", "a1", " ", " ", " ", "  ", "\n", ".", ",", "!", "?", ";", ":", '."', "...", "-", "«", "×", "\x00", "Über", "don't."]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    ids, counts = pieces.TextEncoder(spec, entries=40), pieces.TextEncoder(spec, counting=True, hot={b" word": 1, b".": 1})
    for text, want in zip(samples, ids_by_hand(spec, samples), strict=True):
        assert np.frombuffer(ids(text), ids.dtype).tolist() == want and counts(text) == len(want)


WIDE = ["слово", "привет,", "Ελλάδα", "中文没有空格。", "かな漢字", "한국어", "it’s", "“quoted”", "don't", "—", "word", "été", "e\u0301", "a\u0308\u0323b", "١٢٣", "Ⅻ", "x²", "😀👩\u200d👩", "\u00a0", "\u3000", "\u2009", "\u200b", "\u180e", "\u2028", "\x1c", "\ufeff", " ", " ", " ", "  ", "\n", "\t", " \n", ".", "ſt", "İ", "ǅ", "\U000e0041"]


def test_counts_of_any_text_are_the_library_s_by_look_up():
    """Cyrillic, Greek, CJK, quotes, combining marks and odd white space: the same counts, through the caches."""
    spec = pieces.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    samples = ["".join(rng.choice(WIDE) for _ in range(rng.randint(1, 25))) for _ in range(6000)]
    samples += [" ".join(rng.choice(WIDE).strip() for _ in range(200)) for _ in range(50)] + ["漢" * 500 + " слово", "слово <|endoftext|> слово"]
    held = pieces.TextEncoder(spec, counting=True, hot={" слово".encode(): len(ids_by_hand(spec, [" слово"])[0])}, entries=300)
    for text, want in zip(samples, ids_by_hand(spec, samples), strict=True):
        assert held(text) == len(want)
    fresh, words = pieces.TextEncoder(spec, counting=True), [w for w in WIDE if w.isalpha()]
    text = " ".join(rng.choice(words) for _ in range(20_000)) + " ’"
    assert fresh(text) == len(ids_by_hand(spec, [text])[0]) and fresh.stretches.misses <= len(words) + 1 and fresh.letters.misses <= 4 * len(words)
    assert {"’", " слово"} <= set(fresh.split("a ’ слово")) | {"’"} and fresh.split("a “b” слово") == ["a", " “", "b", "”", " слово"]


def test_another_layout_goes_to_the_library_whole(word_json):
    import json

    assert pieces.layout(json.loads(word_json)) == "word"
    for change in (lambda s: s["model"].update(unk_token="x"), lambda s: s["normalizer"]["normalizers"].pop(0), lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(invert=False), lambda s: s["added_tokens"][0].update(lstrip=True)):
        spec = json.loads(word_json)
        change(spec)
        assert pieces.layout(spec) is None


def test_token_shards_end_by_bytes(spark, word_json, monkeypatch):
    rows = [(i // 40, f"text {i} of a shard") for i in range(400)] + [(None, f"n{i}") for i in range(60)] + [(3, "hot")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(token_store, "tune", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50"))
    manifest = token_store.write_store(df, word_json, end_id=1, shard_bytes=200)
    assert manifest.count() > 8
    got = token_store.read_store(manifest, df.select("doc_id")).collect()
    want = Counter((i, tuple([*ids, 1])) for (i, _), ids in zip(rows, ids_by_hand(word_json, [t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    line = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in line] == list(itertools.accumulate((n for _, n in line), initial=0))[:-1]


def removed_by_hand(rows, length=50):
    """(id, kept sha) of rows (id or None, text): bytes of strings that a smaller id has go."""
    first = {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], i)
    out = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        mask = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            f = first[raw[p : p + length]]
            mask[p : p + length] |= f is not None and (i is None or f < i)
        out[(i, int(mask.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("shared_id", [None, 7])
def test_suffix_dedup_of_very_many_rows_of_one_id(spark, shared_id):
    """2,000 texts without an id, or of one id, some with a passage of an earlier document."""
    rng, passage = random.Random(3), word_salad(random.Random(4), 25)
    rows = [(1, passage)] + [(shared_id, word_salad(rng, 15) + (" " + passage if i % 5 == 0 else "")) for i in range(2000)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, id long, parts long, __of string")
    got = suffix_dedup.remove_repeats(df)
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in got.collect()) == removed_by_hand(rows)


def test_rewrite_takes_clashing_columns_and_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    long = word_salad(rng, 6000)
    rows = [(1, long), (2, "start " + long[3000:9000] + " end"), (3, long), (4, None), (5, "")]
    names = ["doc_id", "text", "id", "parts", "__of", "__parts", "__spans", "__number", "__id", "spot"]
    df = spark.createDataFrame([(i, t, *range(8)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names[2:]))
    cut = suffix_dedup.remove_repeats(df, rewrite=True)
    assert cut.columns == names and cut.dtypes == df.dtypes
    found = {r.doc_id: r for r in cut.collect()}
    assert found[3].text == "" and found[2].text.startswith("start") and len(found[2].text) < 200 and found[4].text is None and found[1]["__of"] == 2
    monkeypatch.setattr(suffix_dedup, "TEXT_BLOCK", 700)
    batches = [suffix_dedup.pieces_of([t.encode() for _, t in rows if t], 50)]
    starts = sorted((o, b + p) for owner, begin, raw in batches[0] for o, b, r in zip(owner, begin, raw) for p in range(len(r) - 49))
    assert starts == sorted((o, p) for o, (_, t) in enumerate([r for r in rows if r[1]]) for p in range(len(t.encode()) - 49))


@pytest.mark.parametrize("limit", [60, 15])
def test_blocks_in_one_pass_and_in_several(spark, limit):
    bench, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame(CASES, "doc_id long, text string")
    got = decontaminate.decontaminate(docs, bench, block_bytes=limit)
    assert (len(decontaminate.blocks_of(bench, "item_id", "text", limit)) > decontaminate.AT_ONCE) == (limit == 15)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == hits_by_hand()


def test_patterns_of_many_items_and_long_windows(spark):
    """Windows that very many items share, items of every length, and a window as long as a document."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(60)] + [(100 + i, "a common window of ten words that all items share here") for i in range(50)]
    texts_ = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) + (" a common window of ten words that all items share here" if i % 4 == 0 else "")) for i in range(80)]
    tables = decontaminate.compiled([(str(i), t.encode()) for i, t in items], 10)
    for (n, spans, found), (_, t) in zip(decontaminate.hits([t.encode() for _, t in texts_], tables), texts_, strict=True):
        w, hit, names = t.split(), set(), set()
        for i, item in items:
            v = item.split()
            m = min(10, len(v))
            for k in range(len(v) - m + 1):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[k : k + m]:
                        hit |= set(range(p, p + m))
                        names.add(str(i))
        assert n == len(w) and found == names and {p for a, b in spans for p in range(a, b)} == hit


def test_quality_verdict_by_hand(docs, texts):
    """Ratios, chunks and the verdict, written out once more."""
    bands, z = quality.Bands(), zstandard.ZstdCompressor(level=3)
    limits = lambda n, table_: [(lo, hi) for at, lo, hi in table_ if n >= at][-1:]
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.quality(docs).collect()}
    seen = 0
    for i, t in texts:
        raw = (t or "").encode()
        r = got[(i, len(BLANK.findall(t or "")), sum(map(len, BLANK.findall(t or ""))))]
        whole = limits(len(raw), bands.whole)
        if not whole:
            assert r.zstd_ratio is None and r.kept == (not r.base_failed)
            continue
        step = 1024
        while step >= 256 and len(raw) < 2 * step:
            step //= 2
        cuts = [k for k in range(0, len(raw), step) if k == 0 or len(raw) - k >= 128] + [len(raw)]
        bad = 0
        for a, b in itertools.pairwise(cuts):
            (lo, hi), ratio = limits(b - a, bands.chunk)[0], len(z.compress(raw[a:b])) / (b - a)
            bad += 0 if lo <= ratio <= hi else b - a
        ratio = len(z.compress(raw)) / len(raw)
        assert abs(r.zstd_ratio - ratio) < 1e-12 and abs(r.bad_chunks - bad / len(raw)) < 1e-12
        assert r.kept == (not r.base_failed and whole[0][0] <= ratio <= whole[0][1] and bad < 0.3 * len(raw))
        seen += 1
    assert seen > 5


def test_fitted_bands_keep_what_they_were_not_fitted_on(spark, sf):
    docs_, good = table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1")
    bands = quality.fitted_bands(docs_, good.where("doc_id % 2 = 0"), sample_rows=500)
    assert [b[0] for b in bands.whole] == sorted(b[0] for b in bands.whole) and all(lo < hi for _, lo, hi in (*bands.whole, *bands.chunk))
    rest = quality.quality(docs_.join(good.where("doc_id % 2 = 1"), "doc_id", "left_semi"), bands=bands).where("not base_failed")
    assert rest.where("kept").count() >= 0.95 * rest.count() > 0
    assert quality.fitted_bands(docs_, good.limit(0)) == quality.Bands()


def test_archives_end_by_bytes(spark):
    pages = spark.range(0, 300).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(sha2(cast(id as string), 256), 5) as html").coalesce(1)
    manifest = warc.write_pages(pages, archive_bytes=20_000)
    assert manifest.count() > 2 and manifest.selectExpr("sum(records)").first()[0] == 300
    assert {r.page_id for r in warc.read_pages(manifest).collect()} == set(range(300))


def test_bad_arc_records_are_counted(spark, tmp_path):
    good = [warc.arc_bytes(f"http://h/{i}", "19990102030405", "text/html", b"body %d" % i) for i in range(4)]
    raw = warc.arc_file_head("f.arc", "19990101") + good[0] + b"rubbish here\nmore rubbish 5\n" + good[1] + b"http://h/x 0.0.0.0 nodate text/html 3\nabc\n" + good[2] + good[3][:-4]
    files = spark.createDataFrame([(bytearray(raw),), (bytearray(gzip.compress(raw)[:-20]),), (None,), (bytearray(b""),)], "content binary")
    rows = sorted((r.records, r.refused) for r in warc.convert_arc(files, f"file://{tmp_path}/out").collect())
    assert rows[:2] == [(0, 0), (0, 0)] and rows[2][1] >= 1 and rows[3][1] == 2 and rows[3][0] >= 2


def test_every_record_has_an_identifier_of_its_own(spark):
    """Rows that repeat an id, with one payload or several; a revisit refers to a response with its payload."""
    pages = [(4, "u", "a" * 40), (4, "u", "a" * 40), (4, "v", "b" * 40), (3, "u", "a" * 40), (3, "w", "b" * 40), (2, "u", "a" * 40), (None, "u", "b" * 40), (9, "u", "a" * 40), (9, "x", "a" * 40)]
    manifest = warc.write_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    fields = []
    for r in manifest.collect():
        files, top = warc.opened_store(r.path)
        with files.open_input_stream(f"{top}/{r.file}", compression=None) as f:
            fields += [dict(x) for x, _ in warc.parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=f)))]
    held = {x["WARC-Record-ID"]: x for x in fields}
    assert len(held) == len(fields) == len(pages)
    revisits = [x for x in fields if x["WARC-Type"] == "revisit"]
    for x in revisits:
        of = held[x["WARC-Refers-To"]]
        assert of["WARC-Type"] == "response" and of["WARC-Payload-Digest"] == x["WARC-Payload-Digest"] and of["X-Page-Id"] == x["X-Refers-To-Page-Id"]
    assert Counter(x.get("X-Page-Id") for x in revisits) == Counter({"4": 2, "3": 2, "2": 1, None: 1})


def test_damaged_shards_are_told(spark, word_json, monkeypatch):
    docs_ = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(60)], "doc_id long, text string").repartition(3)
    manifest = token_store.write_store(docs_, word_json, end_id=1)
    assert token_store.damaged(manifest).count() == 0
    shards = sorted(manifest.select("path", "shard", "tokens").collect())
    assert len(shards) >= 3
    base = [f"{token_store.opened_store(s.path)[1]}/{s.shard}" for s in shards]
    with open(f"{base[0]}.ids", "r+b") as f:
        f.seek(4)
        f.write(b"\xff")
    with open(f"{base[1]}.ids", "ab") as f:
        f.write(b"\0\0")
    with open(f"{base[2]}.idx", "r+b") as f:
        f.write(b"????")
    monkeypatch.setattr(token_store, "READ_BYTES", 16)
    assert {r.shard: r.problem for r in token_store.damaged(manifest).collect()} == {shards[0].shard: "checksum", shards[1].shard: "size", shards[2].shard: "index"}
